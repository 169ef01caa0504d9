"""The trie of conversation beginnings, with subtree totals by parallel tree contraction.

A turn is known by 128 bits over its place and its content, a beginning by the exclusive or of its turns. So a prefix
sum inside each conversation names every node, however long the conversation; texts are read once, hashed and left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.llm.common import written

# How a conversation is put together again.
FAMILY = 5
HEADS = 9
IDS_PER_CHUNK = 1000
MANY_CHILDREN = 1000  # at most so many nodes can each have more than this fraction of all nodes as children

_START = Window.unboundedPreceding


def head_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string")) % HEADS


def _mark(place: Column) -> list[Column]:
    """128 bits of a turn at a place, as two longs."""
    return [F.xxhash64(place, "role_key", "text_key"), F.xxhash64("text_key", place, "role_key", F.lit(1))]


def _xor_of(turns: Column, field: str) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda a, turn: a.bitwiseXOR(turn[field]))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, nth`` (place inside the part, from 0), content keys and text bytes of every turn.

    Turns are dealt by ranges of (conversation, order), so a long conversation is cut into several parts, each smaller
    than a range; equal turns are told apart by their row and may be cut as well.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(role)).alias("role_key"), F.unhex(F.md5(text)).alias("text_key"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), "role_key", "text_key", "row"]
    dealt = turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    return dealt.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1).drop("turn", "row")


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their number of turns and last node, their turns with node, parent node and bytes).

    Every conversation begins with the first turns of its family's first one, their number given by ``head_turns``,
    and goes on with its own turns after as many.
    """
    turns = written(ordered_turns(conversations))
    parts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(_START, -1)
    whole = Window.partitionBy("conv_id")
    parts = written(parts.select("conv_id", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"), F.sum("n").over(whole).alias("own")))

    heads = turns.join(parts.filter(F.col("from") < HEADS - 1), ["conv_id", "part"]).withColumn("place", F.col("from") + F.col("nth") + 1)
    heads = heads.filter((F.col("place") < HEADS) & (F.col("conv_id") % FAMILY == 0))
    heads = heads.select("conv_id", "place", "bytes", *[m.alias(f"e{i}") for i, m in enumerate(_mark(F.col("place")))])
    heads = heads.groupBy(F.col("conv_id").alias("family")).agg(F.sort_array(F.collect_list(F.struct("place", "bytes", "e0", "e1"))).alias("heads"))

    convs = parts.groupBy("conv_id").agg(F.max("own").alias("own")).withColumn("skipped", head_turns(F.col("conv_id")))
    convs = convs.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "family", "left")
    convs = convs.withColumn("heads", F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), 1, F.col("skipped").cast("int")))
    convs = written(convs.select(
        "conv_id", "own", "skipped", "heads", F.size("heads").cast("long").alias("taken"),
        *[_xor_of(F.col("heads"), f"e{i}").alias(f"base{i}") for i in (0, 1)]))

    xor = lambda a, b: a.bitwiseXOR(b)
    head = convs.select("conv_id", F.posexplode("heads").alias("at", "turn"), "heads").select(
        "conv_id", F.col("turn.place").alias("depth"), F.col("turn.bytes").alias("bytes"),
        *[F.col(f"turn.e{i}").alias(f"e{i}") for i in (0, 1)],
        *[_xor_of(F.slice("heads", 1, F.col("at") + 1), f"e{i}").alias(f"n{i}") for i in (0, 1)])

    # Own turns: the running exclusive or inside a part, then what the parts before it and the taken turns give.
    tails = parts.join(convs.select("conv_id", "skipped", "taken", "base0", "base1"), "conv_id")
    own = turns.join(tails.select("conv_id", "part", "from", "skipped", "taken"), ["conv_id", "part"]).withColumn("place", F.col("from") + F.col("nth"))
    own = own.filter(F.col("place") >= F.col("skipped")).withColumn("depth", F.col("place") - F.col("skipped") + F.col("taken") + 1)
    own = own.select("conv_id", "part", "depth", "bytes", *[m.alias(f"e{i}") for i, m in enumerate(_mark(F.col("depth")))])
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(_START, 0)
    own = written(own.select("*", *[F.bit_xor(f"e{i}").over(inside).alias(f"x{i}") for i in (0, 1)]))
    sums = own.groupBy("conv_id", "part").agg(*[F.bit_xor(f"e{i}").alias(f"s{i}") for i in (0, 1)]).join(tails.select("conv_id", "part", "base0", "base1"), ["conv_id", "part"])
    carried = sums.select("conv_id", "part", *[xor(F.col(f"base{i}"), F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0))).alias(f"c{i}") for i in (0, 1)])
    tail = own.join(carried, ["conv_id", "part"]).select("conv_id", "depth", "bytes", "e0", "e1", *[xor(F.col(f"x{i}"), F.col(f"c{i}")).alias(f"n{i}") for i in (0, 1)])
    turns = head.unionByName(tail).select("conv_id", "depth", "bytes", "n0", "n1", *[xor(F.col(f"n{i}"), F.col(f"e{i}")).alias(f"p{i}") for i in (0, 1)])
    turns = written(turns)
    return convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("skipped"), F.lit(0))).alias("length")), turns


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal nodes, in order: ids joined by commas, some of them to a row."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        rows, low = [], 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or i - low == IDS_PER_CHUNK or columns[0][i] != columns[0][low] or columns[1][i] != columns[1][low]:
                rows.append((columns[0][low], columns[1][low], columns[2][low], ",".join(map(str, columns[2][low:i]))))
                low = i
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["n0", "n1", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every node's chunks, taken one after the other."""
    node, digest = None, None

    def row(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0][0] for d in done], pa.int64()), pa.array([d[0][1] for d in done], pa.int64()),
                                           pa.array([d[1].hexdigest() for d in done], pa.string())], ["n0", "n1", "ends_sha256"])

    for batch in batches:
        done = []
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (a, b) != node:
                done += [(node, digest)] if node else []
                node, digest = (a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        yield row(done)
    if node:
        yield row([(node, digest)])


def digests_of_members(ends: DataFrame) -> DataFrame:
    """``n0, n1, ends_sha256``: the hash of each node's ascending ids (``n0, n1, conv_id``), joined by commas.

    Sorting and joining the ids is dealt by ranges, a node's ids to several tasks if it has many. Only the finished
    chunks of a node, a thousandth of its ids in number, pass one task one by one, as the hash itself asks for.
    """
    dealt = ends.select("n0", "n1", "conv_id").repartitionByRange("n0", "n1", "conv_id").sortWithinPartitions("n0", "n1", "conv_id")
    chunks = dealt.mapInArrow(_chunks, "n0 long, n1 long, first long, ids string")
    return chunks.repartition("n0", "n1").sortWithinPartitions("n0", "n1", "first").mapInArrow(_digests, "n0 long, n1 long, ends_sha256 string")


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """``id`` and the sum of each of ``values`` over the subtree of every node; ``tree`` has ``id, parent`` (null: root).

    Each round rakes all leaves into their parents, whose sums take what the leaf holds, and splices out nodes
    with one child that is neither a leaf nor chosen itself (chosen by a coin from id and round): the child moves up and carries on its edge what the node held. When only raked
    nodes are left, the spliced nodes get their totals back, last round first, from the child they were left for. The rounds grow with the
    logarithm of the number of nodes, chains included; a node's children are summed before the shuffle.
    """
    up = [f"up_{v}" for v in values]
    alive = written(tree.select("id", "parent", *[F.col(v).cast("long").alias(v) for v in values], *[F.lit(0).cast("long").alias(u) for u in up]))
    raked, spliced = [], []
    while True:
        kids = alive.filter("parent is not null").groupBy(F.col("parent").alias("__k")).agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("child"))
        coin = F.xxhash64("id", F.lit(len(raked))).bitwiseAND(F.lit(1)) == 1
        may = (F.col("__n") == 1) & F.col("parent").isNotNull() & coin
        marked = written(alive.join(kids, F.col("id") == F.col("__k"), "left").withColumn(
            "act", F.when(F.col("__n").isNull(), "rake").when(may, "may").otherwise("stay")).drop("__k", "__n"))
        raked.append(marked.filter("act = 'rake'").select("id", "parent", *values, *up))
        acts = dict(marked.groupBy("act").count().toArrow().to_pandas().itertuples(index=False, name=None))
        if not acts.keys() - {"rake"}:
            break
        sums = raked[-1].groupBy(F.col("parent").alias("__k")).agg(*[F.sum(F.col(v) + F.col(f"up_{v}")).alias(f"__{v}") for v in values])
        stay = marked.filter("act <> 'rake'").join(sums, F.col("id") == F.col("__k"), "left")
        above, edge = F.col("parent"), {v: F.col(f"up_{v}") for v in values}
        spliced.append(None)
        if "may" in acts:
            below = marked.filter("act = 'stay'").select(F.col("id").alias("__u"), *[F.col(u).alias(f"__{u}") for u in up])
            out = spliced[-1] = written(marked.filter("act = 'may'").join(below, F.col("child") == F.col("__u")).select(
                "id", "parent", "child", *[(F.col(v) + F.col(f"__up_{v}")).alias(f"add_{v}") for v in values],
                *[(F.col(v) + F.col(f"up_{v}")).alias(f"edge_{v}") for v in values]))
            moved = out.select(F.col("child").alias("__c"), F.col("parent").alias("__p"), *[f"edge_{v}" for v in values])
            stay = stay.join(out.select(F.col("id").alias("__s")), F.col("id") == F.col("__s"), "left_anti").join(moved, F.col("id") == F.col("__c"), "left")
            above, edge = F.coalesce("__p", "parent"), {v: F.col(f"up_{v}") + F.coalesce(f"edge_{v}", F.lit(0)) for v in values}
        alive = written(stay.select(
            "id", above.alias("parent"), *[(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values],
            *[edge[v].alias(f"up_{v}") for v in values]))
    known = raked[-1].select("id", *values)
    for nodes, leaves in zip(reversed(spliced), reversed(raked[:-1])):
        if nodes is not None:
            total = known.select(F.col("id").alias("__t"), *[F.col(v).alias(f"__{v}") for v in values])
            found = nodes.join(total, F.col("child") == F.col("__t")).select("id", *[(F.col(f"__{v}") + F.col(f"add_{v}")).alias(v) for v in values])
            known = known.unionByName(written(found))
        known = known.unionByName(leaves.select("id", *values))
    return known


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent`` (id) and ``parent_conv_id``, null at the root.

    Nodes with very many children are few, whatever the input: they are broadcast, so their children need no shuffle.
    """
    most = nodes.count() // MANY_CHILDREN + 1
    busy = nodes.groupBy("p0", "p1").agg(F.count(F.lit(1)).alias("n_children")).filter(F.col("n_children") > most).select("p0", "p1")
    above = nodes.select(F.col("n0").alias("p0"), F.col("n1").alias("p1"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    busy = written(above.join(busy, ["p0", "p1"]))
    lone = nodes.join(F.broadcast(busy.select("p0", "p1")), ["p0", "p1"], "left_anti").join(above, ["p0", "p1"], "left")
    return nodes.join(F.broadcast(busy), ["p0", "p1"]).unionByName(lone)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: distinct beginnings of the rebuilt conversations, the root without turns included.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Turns are ordered by
    ``turn``, null first; those of equal ``turn`` by the MD5 of role, then of text. A null role or text is empty.
    Repeated rows are turns of their own. Rows without a conversation take no part. A conversation of no turns
    after rebuilding is a member of the root only. An empty table has no node. Other columns are not read. Nodes are told
    apart by 128 bits of hash.
    """
    convs, turns = rebuilt_conversations(conversations)
    no = F.lit(0).cast("long")
    ends = turns.join(convs, "conv_id").filter(F.col("depth") == F.col("length")).select("conv_id", "n0", "n1")
    ends = ends.unionByName(convs.filter("length = 0").select("conv_id", no.alias("n0"), no.alias("n1")))
    nodes = turns.groupBy("n0", "n1").agg(
        F.max("p0").alias("p0"), F.max("p1").alias("p1"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    none = F.lit(None).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(
        no.alias("n0"), no.alias("n1"), none.alias("p0"), none.alias("p1"), no.alias("depth"), no.alias("bytes"), "n_convs", "conv_id")
    kids = nodes.groupBy(F.col("p0").alias("n0"), F.col("p1").alias("n1")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.unionByName(root).join(kids, ["n0", "n1"], "left").withColumn("n_children", F.coalesce("n_children", no))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()))
    nodes = written(_with_parents(nodes))
    own = nodes.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    nothing = hashlib.sha256(b"").hexdigest()
    out = nodes.join(totals, "id").join(digests_of_members(ends), ["n0", "n1"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def oracle_sql() -> str:
    """The same rows from whole lists of turns; the checksum is built digit by digit."""
    return """WITH RECURSIVE step(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc(conv_id, k, v) AS (
  SELECT DISTINCT conv_id, 0, 4294967295::bigint FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, crc.k + 1, xor(v >> 8, c) FROM crc JOIN step
    ON step.k = 8 AND i = xor(v & 255, ascii(substr(conv_id::varchar, crc.k + 1, 1))) WHERE crc.k < length(conv_id::varchar)),
h AS (SELECT conv_id, cast(xor(v, 4294967295) % 9 AS integer) AS h FROM crc WHERE k = length(conv_id::varchar)),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(coalesce(role, '')), md5(coalesce(text, ''))) AS l
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (SELECT o.conv_id, list_concat(coalesce(list_slice(b.l, 1, h), []), list_slice(o.l, h + 1, len(o.l))) AS l
          FROM own o JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
member AS (SELECT conv_id, unnest(range(len(l) + 1)) AS d, l FROM built),
path AS (SELECT conv_id, d, list_slice(l, 1, d) AS p, d = len(l) AS ends FROM member),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(strlen(p[d].t), 0) AS bytes,
                sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM path GROUP BY p, d),
linked AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM node c WHERE c.d = n.d + 1 AND list_slice(c.p, 1, n.d) = n.p) AS n_children
           FROM node n LEFT JOIN node u ON u.d = n.d - 1 AND u.p = list_slice(n.p, 1, n.d - 1))
SELECT a.conv_id, cast(a.d AS bigint) AS depth, a.parent_conv_id, a.n_convs, a.n_children, cast(count(*) FILTER (b.n_children = 0) AS bigint) AS n_leaves,
       cast(sum((b.n_convs - 1) * b.bytes) AS bigint) AS saved_tokens, a.ends_sha256
FROM linked a JOIN linked b ON list_slice(b.p, 1, a.d) = a.p AND b.d >= a.d
GROUP BY a.p, a.d, a.conv_id, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256"""
