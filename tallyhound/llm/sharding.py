"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes from groups that may not be divided."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import buckets_for, gapless_rank, written

BLOCK_GROUPS = 100_000  # groups that one task combines
MOST_BLOCKS = 4096  # partial partitions that meet at the driver, each of n_shards sums


def differencing(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (one row of sums each) into one by the differencing rule.

    The two with the largest spread are added in opposite order, until one is left. Returns the final sums
    and, per row and column, the part in which it ends.
    """
    rows, n = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    held = np.take_along_axis(sums, order, axis=1)
    heap = [(-int(held[i, 0] - held[i, -1]), i) for i in range(rows)]
    heapq.heapify(heap)
    parts = {i: held[i] for i in range(rows)}
    joined: list[tuple[int, int, np.ndarray]] = []  # (left, right, order of the sum): node rows + k
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = parts.pop(a) + parts.pop(b)[::-1]
        turn = np.argsort(-both, kind="stable")
        node = rows + len(joined)
        joined.append((a, b, turn))
        parts[node] = both[turn]
        heapq.heappush(heap, (-int(parts[node][0] - parts[node][-1]), node))
    last = heap[0][1]
    place = {last: np.arange(n)}  # of a node's sorted parts, the final part
    for k in range(len(joined) - 1, -1, -1):
        a, b, turn = joined[k]
        mine = np.empty(n, np.int64)
        mine[turn] = place.pop(rows + k)
        place[a], place[b] = mine, mine[::-1]
    out = np.empty((rows, n), np.int64)
    for i in range(rows):
        out[i, order[i]] = place[i]
    return parts[last], out


def _partial(n: int):
    """Per block of groups: the part of each group, and the sums of the parts."""

    def run(group: pa.Table) -> pa.Table:
        size = group.column("bytes").to_numpy()
        order = np.argsort(-size, kind="stable")
        rows = -(-len(size) // n)
        padded = np.zeros(rows * n, np.int64)
        padded[: len(size)] = size[order]
        sums, place = differencing(padded.reshape(rows, n))
        part = np.empty(len(size), np.int64)
        part[order] = place.reshape(-1)[: len(size)]
        block = group.column("block")
        return pa.table({"block": block, "gid": group.column("gid"), "part": part.astype(np.int32), "part_bytes": sums[part]})

    return run


def shard_by_bytes(docs: DataFrame, n_shards: int, text: str = "text", group_rows: int = BLOCK_GROUPS) -> DataFrame:
    """Add size, text_crc32, shard, slot: documents with equal texts go to one shard, shards get near equal bytes.

    A document weighs the UTF-8 bytes of its text plus 8; a null text has none and forms one group with the
    other null texts, apart from the empty texts. Groups are summed before anything is shuffled by them, so a
    text with a third of all rows is one group row. Blocks of groups are differenced in tasks of their own;
    their partial partitions, n_shards sums each and at most MOST_BLOCKS of them, are differenced at the driver.
    A group above the mean load makes its shard larger, since it may not be divided. Repeated rows are kept,
    an empty table gives an empty result. Columns of ``docs`` that are named like an added one are replaced.
    """
    added = ["size", "text_crc32", "shard", "slot"]
    bytes_of = F.coalesce(F.octet_length(text), F.lit(0)) + 8
    gid = F.xxhash64(F.lit(1), F.coalesce(F.sha2(text, 256), F.lit("")))
    marked = docs.drop(*added).select("*", bytes_of.cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), gid.alias("__gid"))
    groups = written(marked.groupBy(F.col("__gid").alias("gid")).agg(F.sum("size").alias("bytes")))
    count = groups.count()
    if not count:
        return marked.select(*docs.drop(*added).columns, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    blocks = min(MOST_BLOCKS, buckets_for(count, group_rows, 8))
    dealt = groups.withColumn("block", F.pmod("gid", F.lit(blocks)).cast("int"))
    partial = written(dealt.groupBy("block").applyInArrow(_partial(n_shards), "block int, gid long, part int, part_bytes long"))
    sums = np.zeros((blocks, n_shards), np.int64)
    for row in partial.groupBy("block", "part").agg(F.first("part_bytes").alias("s")).collect():
        sums[row["block"], row["part"]] = row["s"]
    _, place = differencing(sums)
    flat = F.array(*[F.lit(int(x)) for x in place.reshape(-1)]) if blocks * n_shards <= 2048 else None
    if flat is not None:
        shard = F.element_at(flat, F.col("block") * n_shards + F.col("part") + 1)
        settled = partial.select("gid", shard.alias("shard"))
    else:
        table = docs.sparkSession.createDataFrame([(b, p, int(place[b, p])) for b in range(blocks) for p in range(n_shards)], "block int, part int, shard int")
        settled = partial.join(table, ["block", "part"]).select("gid", "shard")
    out = marked.join(settled.withColumnRenamed("gid", "__gid"), "__gid").drop("__gid")
    return gapless_rank(out, ["shard"], ["size", "text_crc32", *[c for c in ("doc_id",) if c in docs.columns]], "slot", docs.count())

