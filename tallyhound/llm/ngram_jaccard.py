"""N-gram Jaccard join by vertical partitioning.

Documents are sets of hashed word n-grams; equal sets form one class. The n-grams are ordered by how many
classes hold them, rare ones first, and this order is cut into fragments twice:

1. To find candidates, n-grams are dealt out by hash range. A fragment counts the classes of each of its
   n-grams and hands back, per class, the n-grams that others hold as well. A class whose shared n-grams,
   summed over the fragments, are fewer than the similarity needs can link with nothing and leaves.
2. To verify, the sets of the two classes of a candidate pair are cut at fixed frequencies; each fragment's
   overlap is counted by itself and the partial overlaps are summed per pair.

Candidates come from the rare end of the order alone (prefix filter), and only if what is left of both sets
after the shared n-gram could still reach the similarity (position filter). Within a group of near copies
not all pairs are compared: first every class is compared with the most central class of each of its n-grams'
lists. Then only pairs whose classes are not yet connected remain, and these are all compared. Both steps
keep every connected component exactly as the full join would give it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import written
from tallyhound.llm.graph import components
from tallyhound.llm.hashing import Words, set_id, shingle_sets, slabs

N = 5
PERCENT = 75
KEYS_PER_FRAGMENT = 1_000_000
FRAGMENTS = 64  # at least
CUTS = np.array([4, 16, 64])  # frequencies that cut the global order into the fragments of the verification


def _members(text: str, keep: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slabs(batch, text):
                sets = list(shingle_sets(Words(data, offsets, lower=True), n))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in keep], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())],
                    [*keep, "n_shingles", "class"])

    return run


def _deal(text: str, n: int, fragments: int):
    """Per slab and fragment one row: the classes, how many n-grams each has there, their sizes, and the n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slabs(batch, text):
                sets = {}
                for s in shingle_sets(Words(data, offsets, lower=True), n):
                    if len(s):
                        sets.setdefault(set_id(s), s)
                if not sets:
                    continue
                ids = np.array(list(sets), np.int64)
                sizes = np.array([len(s) for s in sets.values()], np.int64)
                values = np.concatenate(list(sets.values()))
                fragment = ((values >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.uint16 if fragments < 65536 else np.int64)
                owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
                order = np.argsort(fragment, kind="stable")
                values, owner = values[order], owner[order]
                cut = np.searchsorted(fragment[order], np.arange(fragments + 1))
                columns: list[list] = [[], [], [], [], []]
                for f in np.flatnonzero(np.diff(cut)):
                    own, count = np.unique(owner[cut[f] : cut[f + 1]], return_counts=True)
                    for column, x in zip(columns, (int(f), ids[own].tobytes(), sizes[own].astype("<i4").tobytes(), count.astype("<i4").tobytes(), values[cut[f] : cut[f + 1]].tobytes()), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["fragment", "ids", "sizes", "counts", "grams"])

    return run


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _shared(group: pa.Table) -> pa.Table:
    """Per class of a fragment its n-grams that other classes hold, with their frequencies."""
    ids, sizes, counts = (_joined(group.column(c), k) for c, k in (("ids", "<i8"), ("sizes", "<i4"), ("counts", "<i4")))
    grams = _joined(group.column("grams"), "<u8")
    _, first = np.unique(ids, return_index=True)  # a class comes from every slab that holds a copy
    once = np.zeros(len(ids), bool)
    once[first] = True
    grams = grams[np.repeat(once, counts)]
    ids, sizes, counts = ids[once], sizes[once], counts[once]
    owner = np.repeat(np.arange(len(ids)), counts)
    _, at, frequency = np.unique(grams, return_inverse=True, return_counts=True)
    frequency = frequency[at]
    common = frequency > 1
    grams, owner, frequency = grams[common], owner[common], frequency[common]
    own, start = np.unique(owner, return_index=True)
    ends = [*start[1:], len(owner)]
    grams = grams.view(np.int64)
    return pa.table({
        "class": pa.array(ids[own]), "n": pa.array(sizes[own].astype(np.int32)),
        "grams": pa.array([grams[a:b] for a, b in zip(start, ends, strict=True)], pa.list_(pa.int64())),
        "frequency": pa.array([frequency[a:b].astype(np.int32) for a, b in zip(start, ends, strict=True)], pa.list_(pa.int32())),
    })


def _prefixes(percent: int):
    """Per class the n-grams of its prefix: position, and the largest partner that the position still allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for c, n, grams, frequency in zip(*[batch.column(x).to_pylist() for x in ("class", "n", "grams", "frequency")], strict=True):
                grams, frequency = np.array(grams, np.int64), np.array(frequency)
                order = np.lexsort((grams, frequency))
                at = np.arange(n - len(grams), n)  # those that nobody else holds come first
                # percent * (n + m - o) <= 100 * o, where o <= n - at
                largest = (100 + percent) * (n - at) // percent - n
                use = 100 * largest >= percent * n
                out[0].append(grams[order][use])
                out[1].append(np.full(use.sum(), c))
                out[2].append(np.full(use.sum(), n))
                out[3].append(largest[use])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["gram", "class", "n", "largest"])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        classes, cuts, sets = [], [], []
        for c, grams, frequency in zip(*[batch.column(x).to_pylist() for x in ("class", "grams", "frequency")], strict=True):
            grams, where = np.array(grams, np.int64), np.searchsorted(CUTS, np.array(frequency), side="right")
            for f in np.unique(where):
                classes.append(c)
                cuts.append(f)
                sets.append(np.sort(grams[where == f]))
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(cuts, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["class", "fragment", "grams"])


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that reach the similarity: partial overlaps per fragment, summed per pair."""
    left = segments.select(F.col("class").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("class").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"])
    partial = partial.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("o"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return summed.filter(F.lit(100) * F.col("o") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def class_links(docs: DataFrame, classes: int, text: str, n: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that connect exactly what the full join connects; ``classes``: all their n-grams."""
    fragments = max(FRAGMENTS, -(-classes // KEYS_PER_FRAGMENT))
    dealt = docs.select(text).mapInArrow(_deal(text, n, fragments), "fragment int, ids binary, sizes binary, counts binary, grams binary")
    shared = dealt.groupBy("fragment").applyInArrow(_shared, "class long, n int, grams array<long>, frequency array<int>")
    whole = shared.groupBy("class", "n").agg(F.flatten(F.collect_list("grams")).alias("grams"), F.flatten(F.collect_list("frequency")).alias("frequency"))
    able = written(whole.filter(F.lit(100) * F.size("grams") >= F.lit(percent) * F.col("n")))
    segments = written(able.mapInArrow(_segments, "class long, fragment int, grams array<long>"))
    prefix = written(able.mapInArrow(_prefixes(percent), "gram long, class long, n long, largest long"))
    # The central class of a list: the one with most left after this n-gram, that is, with the fewest rare ones before
    centre = prefix.groupBy("gram").agg(F.max(F.struct(F.expr("largest - n").alias("room"), F.col("class").alias("b"), F.col("n").alias("nb"), F.col("largest").alias("lb"))).alias("c"), F.count(F.lit(1)).alias("held"))
    centre = centre.filter("held > 1").select("gram", "c.b", "c.nb", "c.lb")
    spokes = prefix.join(centre, "gram").filter("class <> b and n <= lb and nb <= largest").select(F.col("class").alias("a"), "b", F.col("n").alias("na"), "nb")
    spokes = spokes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, na, nb)").alias("na"), F.expr("if(a < b, nb, na)").alias("nb")).distinct()
    stars = written(_verified(spokes, segments, percent))
    roots = components(stars)
    marked = prefix.join(roots, F.col("class") == F.col("node"), "left").select("gram", "class", "n", "largest", F.coalesce("root", "class").alias("root"))
    mixed = marked.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("gram")
    marked = written(marked.join(mixed, "gram", "left_semi"))
    x, y = marked.alias("x"), marked.alias("y")
    open_pairs = x.join(y, F.expr("x.gram = y.gram and x.root <> y.root and x.class < y.class and x.n <= y.largest and y.n <= x.largest"))
    open_pairs = open_pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    return stars.union(_verified(open_pairs, segments, percent))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per document: key, ``n_shingles`` and ``component_id``, the smallest key that its links reach.

    Two documents link when their sets' intersection is at least ``percent`` hundredths of their union. A text
    of fewer than ``n`` words has all its words as its only n-gram; null texts and texts without words are empty
    and link with nothing. Equal sets are one class and never paired with each other. Repeated keys give a row
    each; a null key takes part in links but is no component's smallest key unless all its members are null.
    Sets of two documents are told apart by 64-bit hashes.
    """
    members = written(docs.select(key, text).mapInArrow(_members(text, [key], n), f"`{key}` {docs.schema[key].dataType.simpleString()}, n_shingles long, class long"))
    full = members.filter("n_shingles > 0")
    classes = written(full.groupBy("class").agg(F.min(key).alias("least"), F.max("n_shingles").alias("n")))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(class_links(docs, total, text, n, percent))
    rooted = classes.join(roots, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(smallest, "root").select(F.col("class").alias("__class"), "component_id"))
    linked = full.join(named, F.col("class") == F.col("__class")).select(key, "n_shingles", "component_id")
    return linked.unionByName(members.filter("n_shingles = 0").select(key, "n_shingles", F.col(key).alias("component_id")))
