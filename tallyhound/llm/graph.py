"""Connected components of links, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import written

_SCHEMA = "a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of each batch by links (a, b) from its members a to the smallest member b of their component."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up] if up in parent else up
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        pairs = [(x, find(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a long, b long) that is not the smallest of its component, with that smallest.

    Alternates the two star operations: larger neighbours are hung on the smallest neighbour (large star),
    then all smaller neighbours and the node itself (small star), until no link changes. Minima are combined
    before the shuffle and joined back, so a node with very many links is no group anywhere.
    """
    cut = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    now = written(cut.mapInArrow(_forest, _SCHEMA).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        small = down.join(low, F.col("a") == F.col("v"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        now = written(small.filter("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
