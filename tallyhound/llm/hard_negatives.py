"""Hard negatives of anchor vectors by exact integer scores, from products of several candidates packed in one number.

Components become integers, are raised by a bias so that none is negative, and those of k candidates are put into
separate fields of one wide number. One multiplication per anchor component then serves k candidates; a field is wide
enough for the whole sum, so no carry crosses it, and the biases are taken off again afterwards. Numbers of up to 53
bits are multiplied as doubles, which hold such integers exactly; wider ones as Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.llm.common import buckets_for, written

BLOCK_ROWS = 4096  # candidates of a block
ANCHOR_ROWS = 1024  # anchors of a block
MOST_BLOCKS = 64  # candidate blocks that one task takes one after the other
DOUBLE_BITS = 53
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _wide(a: np.ndarray, c: np.ndarray, bits: int, at_once: int = 64) -> np.ndarray:
    """Products of non-negative integers through Python's integers, ``at_once`` candidates in each."""
    out = np.empty((len(a), len(c)), object)
    mask = (1 << bits) - 1
    for low in range(0, len(c), at_once):
        part = c[low : low + at_once]
        packed = [sum(int(x) << (bits * k) for k, x in enumerate(column)) for column in part.T]
        for i, row in enumerate(a):
            total = sum(int(x) * w for x, w in zip(row, packed))
            for k in range(len(part)):
                out[i, low + k] = (total >> (bits * k)) & mask
    return out


def packed_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products (int64) of the rows of ``a`` with the rows of ``c``, both integer.

    A product beyond 64 bits becomes the nearest 64-bit integer.
    """
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)), np.int64)
    low_a, low_c, width = int(a.min()), int(c.min()), a.shape[1]
    bits = max(1, (width * (int(a.max()) - low_a) * (int(c.max()) - low_c)).bit_length())
    fields = DOUBLE_BITS // bits
    if not fields:
        a, c = a.astype(object) - low_a, c.astype(object) - low_c
        exact = _wide(a, c, bits) + low_c * a.sum(axis=1)[:, None] + low_a * c.sum(axis=1)[None, :] + width * low_a * low_c
        return np.clip(exact, _LOW, _HIGH).astype(np.int64)
    a, c = a.astype(np.int64) - low_a, c.astype(np.int64) - low_c
    wide = np.zeros((-(-len(c) // fields), width))
    for k in range(fields):
        part = c[k::fields]
        wide[: len(part)] += part * float(1 << (bits * k))
    product = (a.astype(np.float64) @ wide.T).astype(np.int64)
    out = np.empty((len(a), len(c)), np.int64)
    for k in range(fields):
        n = len(range(k, len(c), fields))
        out[:, k::fields] = (product[:, :n] >> (bits * k)) & ((1 << bits) - 1)
    out += low_c * a.sum(axis=1)[:, None] + (low_a * c.sum(axis=1) + width * low_a * low_c)[None, :]
    return out


def best_hits(group: np.ndarray, score: np.ndarray, ident: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the first ``most`` hits of each group: higher scores first, ties by smaller id."""
    order = np.lexsort((ident, np.invert(score), group))
    g = group[order]
    first = np.searchsorted(g, g, side="left")
    return order[np.arange(len(g)) - first < most]


_BLOCK = "block long, n long, width long, kind string, ids binary, labels binary, q binary"


def _to_block(key: tuple, rows: pa.Table) -> pa.Table:
    """One row for a block of vectors, in order of label and id; short vectors are filled with zeros."""
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    q = rows["q"].combine_chunks()
    sizes = q.value_lengths().to_numpy()
    width = int(sizes.max())
    values = np.zeros((len(ids), width), np.int64)
    values[np.arange(width) < sizes[:, None]] = q.flatten().to_numpy()
    order = np.lexsort((ids, labels))
    values = values[order]
    kind = np.promote_types(np.min_scalar_type(values.min(initial=0)), np.min_scalar_type(values.max(initial=0)))
    kind = kind if kind.kind == "i" else np.dtype(np.int64)
    columns = [key[0], len(ids), width, kind.str, ids[order].tobytes(), labels[order].tobytes(), values.astype(kind).tobytes()]
    return pa.table({c.split()[0]: [v] for c, v in zip(_BLOCK.split(", "), columns)}, schema=pa.schema([
        ("block", pa.int64()), ("n", pa.int64()), ("width", pa.int64()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("q", pa.binary())]))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64),
            np.frombuffer(row["q"], row["kind"]).reshape(row["n"], row["width"]))


def _same_width(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], c.shape[1])
    fill = lambda x: x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return fill(a), fill(c)


class _Best:
    """The best hits of each group so far; blocks of candidates are added one by one."""

    def __init__(self, most: int):
        self.most, self.kept = most, np.zeros((3, 0), np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        hits = np.concatenate([self.kept, np.stack([group, score, ident]).astype(np.int64)], axis=1)
        self.kept = hits[:, best_hits(*hits, self.most)]


_POSITIVE = "a long, at long, score long, vec_id long"
_FOUND = "a long, at long, nth long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _table(schema: str, columns: list[np.ndarray]) -> pa.Table:
    return pa.table({c.split()[0]: pa.array(v, pa.int64()) for c, v in zip(schema.split(", "), columns)})


def _positives_of(most: int):
    def work(key: tuple, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        best = _Best(most)
        for row in anchors.to_pylist():
            ids, labels, q = _unpacked(row)
            for other in candidates.to_pylist():
                c_ids, c_labels, c = _unpacked(other)
                a_q, c_q = _same_width(q, c)
                for label in np.intersect1d(labels, c_labels):
                    (a0, a1), (c0, c1) = np.searchsorted(labels, [label, label + 1]), np.searchsorted(c_labels, [label, label + 1])
                    score = packed_products(a_q[a0:a1], c_q[c0:c1])
                    other_row = c_ids[c0:c1][None, :] != ids[a0:a1][:, None]
                    ranked = np.where(other_row, score, _LOW)
                    least = np.partition(ranked, -min(most, c1 - c0), axis=1)[:, -min(most, c1 - c0)] if c1 > c0 else None
                    i, j = np.nonzero(other_row & (score >= least[:, None]))
                    best.add(i + a0, score[i, j], c_ids[c0 + j])
        at, score, ident = best.kept
        return _table(_POSITIVE, [np.full(len(at), key[0]), at, score, ident])

    return work


def _negatives_of(most: int, positives: int):
    def work(key: tuple, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        for row in anchors.to_pylist():
            best = _Best(most)
            ids, labels, q = _unpacked(row)
            at, nth, high, whom = (np.frombuffer(row[c], np.int64) for c in ("p_at", "p_nth", "p_score", "p_id"))
            upper, lower = (np.full((len(ids), positives), v, np.int64) for v in (_LOW, _HIGH))
            upper[at, nth], lower[at, nth] = high, high - high // 5  # four fifths of the positive's score, rounded up
            low, top = lower.min(axis=1), upper.max(axis=1)
            for other in candidates.to_pylist():
                c_ids, c_labels, c = _unpacked(other)
                score = packed_products(*_same_width(q, c))
                i, j = np.nonzero((score >= low[:, None]) & (score <= top[:, None]) & (labels[:, None] != c_labels))
                found, ident = score[i, j], c_ids[j]
                for k in range(positives):
                    fits = (found >= lower[i, k]) & (found <= upper[i, k])
                    best.add(i[fits] * positives + k, found[fits], ident[fits])
            of = np.zeros((2, len(ids) * positives), np.int64)
            of[:, at * positives + nth] = whom, high
            group, score, ident = best.kept
            i, k = np.divmod(group, positives)
            out.append(_table(_FOUND, [np.full(len(i), key[0]), i, k, ids[i], *of[:, group], ident, score]))
        return pa.concat_tables(out) if out else _table(_FOUND, [np.zeros(0)] * 8)

    return work


def _pack_positives(key: tuple, rows: pa.Table) -> pa.Table:
    columns = {f"p_{name}": [rows[c].to_numpy().astype(np.int64).tobytes()] for name, c in (("at", "at"), ("nth", "nth"), ("score", "score"), ("id", "vec_id"))}
    return pa.table({"a": pa.array([key[0]], pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in columns.items()})


def usable_vectors(embeddings: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """Rows with an id, a label and a whole finite vector: ``vec_id, label, q`` (long components)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding"))
    rows = rows.filter("vec_id is not null and label is not null and embedding is not null").filter(~F.exists("embedding", bad))
    return rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def mine_hard_negatives(embeddings: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 5,
                        block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """Hard negatives of every anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors meet all rows block against block; a task takes some candidate blocks of one anchor block in turn and keeps
    only the best hits of each anchor, so its memory does not grow with the data or with a label's share. ``label`` and
    ``is_anchor`` are expressions over ``vec_id`` and ``label``.

    Rows whose id, label or vector is null, or that hold a null or non-finite component, take no part. Vectors of
    unlike lengths are compared as if filled with zeros, an empty one scores 0. Components and scores beyond 64 bits
    count as the nearest 64-bit integer. Every row stands for itself: repeated rows take a place each, a repeated anchor
    gives its result as often; a row with the anchor's id is none of its positives. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    vectors = usable_vectors(embeddings, label).withColumn("__row", F.monotonically_increasing_id())
    rows = embeddings.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("m")).first()
    n_blocks, n_anchor_blocks = buckets_for(rows["n"], block_rows), buckets_for(rows["m"], anchor_rows)
    dealt = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("__row"), F.lit(n)).cast("long")).groupBy("block").applyInArrow(_to_block, _BLOCK)
    together = max(1, min(MOST_BLOCKS, n_blocks // (4 * spark.sparkContext.defaultParallelism)))
    runs = -(-n_blocks // together)
    blocks = written(dealt(vectors, n_blocks))
    anchors = written(dealt(vectors.filter(is_anchor), n_anchor_blocks).withColumnRenamed("block", "a"))
    cells = blocks.withColumn("s", F.floor(F.col("block") / together)).withColumn("a", F.explode(_numbers(n_anchor_blocks)))

    def met(side: DataFrame, work, schema: str) -> DataFrame:
        spread = side.withColumn("s", F.explode(_numbers(runs)))
        return spread.groupBy("a", "s").cogroup(cells.groupBy("a", "s")).applyInArrow(work, schema)

    ahead = Window.partitionBy("a", "at").orderBy(F.desc("score"), "vec_id")
    near = met(anchors, _positives_of(positives), _POSITIVE).withColumn("nth", F.row_number().over(ahead) - 1).filter(F.col("nth") < positives)
    near = near.groupBy("a").applyInArrow(_pack_positives, "a long, p_at binary, p_nth binary, p_score binary, p_id binary")
    found = met(written(anchors.join(near, "a")), _negatives_of(negatives, positives), _FOUND)
    place = Window.partitionBy("a", "at", "nth").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle_sql() -> str:
    """The same rows by comparing every anchor with every row."""
    return """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::double)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.r, a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, cast(list_dot_product(a.q, b.q) AS bigint) AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
pos AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth
        FROM p WHERE label = own AND vec_id <> anchor_id QUALIFY nth <= 5)
SELECT anchor_id, positive_id, cast(row_number() OVER (PARTITION BY r, nth ORDER BY score DESC, vec_id) AS integer) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (r, anchor_id) WHERE label <> own AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""
