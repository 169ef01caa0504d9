"""Mixing sources to target weights: exact block quotas split over output shards, permuted blocks drawn without overlap."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.llm.common import buckets_for, written

BLOCK_WORDS = 1 << 16
MOST_PASSES = 2
_WORD = r"[^\x20\x09-\x0D]+"


def targets_for(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST_PASSES) -> list[float]:
    """Share ``total`` by weight; none gets above ``most`` times its size, and the excess is shared anew by weight."""
    got = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in free:
                got[i] = weights[i] * unit
            break
        for i in full:
            got[i] = float(most * sizes[i])
            left -= got[i]
        free = [i for i in free if i not in full]
    return got


def split_quotas(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many blocks of each source a shard gets; columns add up to ``blocks`` exactly.

    A binary tree over the shards: a node's blocks are divided between its children by a draw from the
    multivariate hypergeometric distribution, each child getting its shards' part of the total.
    """
    out = np.zeros((shards, len(blocks)), np.int64)

    def split(low: int, high: int, have: np.ndarray) -> None:
        if high - low == 1:
            out[low] = have
            return
        middle = (low + high) // 2
        draw = np.random.Generator(np.random.PCG64([seed, low, high]))
        want, rest, left = int(have.sum()) * (middle - low) // (high - low), int(have.sum()), np.zeros_like(have)
        for k, n in enumerate(have):  # one source after the other, so that numpy's limit on the sum does not matter
            rest -= int(n)
            left[k] = n if not rest and want >= n else draw.hypergeometric(int(n), rest, want) if want and rest + n < 10**9 else min(int(n), want * int(n) // max(1, rest + int(n)))
            want -= int(left[k])
        if want:  # only after the rounding of very large nodes
            for k in np.argsort(have - left)[::-1]:
                more = min(want, int(have[k] - left[k]))
                left[k] += more
                want -= more
        split(low, middle, left)
        split(middle, high, have - left)

    split(0, shards, np.asarray(blocks, np.int64))
    return out


def _coprime(n: int, seed: int, i: int) -> tuple[int, int]:
    """Factor and offset of a permutation of 0 … n - 1."""
    draw = np.random.Generator(np.random.PCG64([seed, i, n]))
    while math.gcd(factor := int(draw.integers(1, max(2, n))), n) != 1:
        pass
    return factor, int(draw.integers(0, max(1, n)))


def _rank(seed: int, key: str, text: str) -> Column:
    return F.xxhash64(F.lit(seed), F.xxhash64(key), F.xxhash64(text))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, shards: int = 16, seed: int = 11,
                text: str = "text", source: str = "source", key: str = "doc_id", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Draw words from every source towards its target. Returns (draws, documents with size, source_size, target).

    A document's size is its number of words. Sources are ordered by code point, null last; ``weights`` repeat
    over them; together the targets are ``share`` times all words, none above MOST_PASSES times its source.
    The documents of a source, permuted by hash, form one long line of words that is walked as often as the
    target needs, so nothing is drawn a further time before all was drawn once, and only the last document can
    be drawn in part. The walk is cut into blocks of ``block_words``; a splitting tree gives every output shard
    its exact number of blocks per source, and shards take disjoint ranges of a permutation of the blocks.

    ``draws`` has one row per document, pass and block it lies in: ``__row`` (the document's row in the second
    result), ``pass`` (0 or 1), ``from_word``, ``to_word`` (in the document), ``source``, ``block``, ``shard`` and
    ``place`` (order in the shard). Null texts and texts without words have size 0 and are never drawn; repeated
    rows and null keys count as documents of their own. Only the sources, not the documents, reach the driver.
    """
    words = F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(_WORD), F.lit(0))), F.lit(0)).cast("long")
    columns = list(dict.fromkeys(c for c in (key, source) if c in docs.columns))
    sized = written(docs.select(*columns, words.alias("size"), _rank(seed, key, text).alias("__rank")).withColumn("__row", F.monotonically_increasing_id()))
    per_source = sized.groupBy(source).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    per_source.sort(key=lambda r: (r[source] is None, (r[source] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["n"] for r in per_source]
    got = targets_for(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes))
    takes = [int(round(x)) for x in got]
    blocks = np.array([-(-t // block_words) for t in takes], np.int64)
    quotas = split_quotas(blocks, shards, seed) if len(blocks) else np.zeros((shards, 0), np.int64)
    spark = docs.sparkSession
    plan = [(r[source], sizes[i], got[i], takes[i], int(max(1, blocks[i])), *_coprime(int(max(1, blocks[i])), seed, i), [int(x) for x in np.cumsum(quotas[:, i])]) for i, r in enumerate(per_source)]
    schema = "__source string, source_size long, target double, take long, blocks long, factor long, offset long, until array<long>"
    sources = spark.createDataFrame(plan, schema)
    # Where each document starts in its source's line: sums per bucket of ranks, then inside the bucket
    n = buckets_for(sum(r["rows"] for r in per_source), 20_000, 256)
    lined = sized.withColumn("__b", F.pmod(F.shiftrightunsigned("__rank", 20), F.lit(n)).cast("int"))
    inside = Window.partitionBy(source, "__b").orderBy("__rank", "__row").rowsBetween(Window.unboundedPreceding, -1)
    totals = lined.groupBy(F.col(source).alias("__s"), F.col("__b").alias("__sb")).agg(F.sum("size").alias("__t"))
    upto = Window.partitionBy("__s").orderBy("__sb").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__s", "__sb", F.coalesce(F.sum("__t").over(upto), F.lit(0)).alias("__before"))
    placed = lined.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(totals, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__sb")))
    placed = written(placed.withColumn("__at", F.col("__before") + F.col("__in")).drop("__s", "__sb", "__before", "__in", "__b"))
    placed = placed.join(sources, F.col(source).eqNullSafe(F.col("__source")))
    walk = placed.filter("size > 0 and take > 0").withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(MOST_PASSES)])))
    walk = walk.withColumn("__from", F.col("pass") * F.col("source_size") + F.col("__at"))
    walk = walk.withColumn("__to", F.least(F.col("__from") + F.col("size"), F.col("take"))).filter("__to > `__from`")
    walk = walk.withColumn("block", F.explode(F.expr(f"sequence(`__from` div {block_words}, (`__to` - 1) div {block_words})")))
    low = F.greatest(F.col("__from"), F.col("block") * block_words)
    high = F.least(F.col("__to"), (F.col("block") + 1) * block_words)
    permuted = F.expr("cast((cast(block as decimal(38,0)) * factor + offset) % blocks as long)")
    draws = walk.select(
        "__row", key, source, "pass", (low - F.col("__from")).alias("from_word"), (high - F.col("__from")).alias("to_word"), "block",
        permuted.alias("__p"), "until", "__rank",
    )
    draws = draws.withColumn("shard", F.expr("size(filter(until, x -> x <= `__p`))"))
    draws = draws.withColumn("place", F.xxhash64(F.lit(seed), "shard", "block", "pass", "__rank", "__row")).drop("until", "__p", "__rank")
    return draws, placed.select("__row", "__rank", *columns, "size", "source_size", "target")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, shards: int = 16, seed: int = 11,
                    text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The drawn documents themselves, a row per document and pass, with all columns, ``shard`` and ``place``.

    A document in two blocks stands in the shard of the first. A document drawn in part keeps its text up to the
    end of its last drawn word. Rows that are equal in key and text count as one draw each.
    """
    draws, sized = mix_sources(docs, weights, share, shards, seed, text, source, key)
    where = F.min(F.struct("block", "shard", "place"))
    taken = draws.groupBy("__row", F.col("pass").alias("__pass")).agg(F.max("to_word").alias("__words"), where.alias("__where"))
    # Rows that share all of rank and source are told apart by their number; which of them gets which does not matter
    numbered = sized.select(
        "__row", F.col("size").alias("__size"), F.col("__rank").alias("__r"), F.col(source).alias("__source"),
        F.row_number().over(Window.partitionBy("__rank", source).orderBy("__row")).alias("__n"),
    )
    wanted = taken.join(numbered, "__row").drop("__row")
    held = docs.withColumn("__rank", _rank(seed, key, text))
    held = held.withColumn("__nth", F.row_number().over(Window.partitionBy("__rank", source).orderBy("__rank")))
    same = (F.col("__rank") == F.col("__r")) & (F.col("__nth") == F.col("__n")) & F.col(source).eqNullSafe(F.col("__source"))
    words = F.regexp_extract_all(text, F.lit(rf"{_WORD}[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.when(F.col("__words") < F.col("__size"), F.array_join(F.slice(words, F.lit(1), F.col("__words").cast("int")), "")).otherwise(F.col(text))
    rest = [F.col(c) for c in docs.columns if c not in (text, "pass", "shard", "place")]
    return held.join(wanted, same).select(*rest, cut.alias(text), F.col("__pass").alias("pass"), F.col("__where.shard").alias("shard"), F.col("__where.place").alias("place"))
