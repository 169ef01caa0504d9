"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

OWN_FOLDER = "/tmp/checkpoints"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MARKS = 1 << 26  # bits of a broadcast bitmap of keys


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is missing, as in local tests, a folder of our own is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = OWN_FOLDER
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it as Parquet to the shared folder and go on from there.

    A lost executor then costs its running tasks only, and plans that share ``df`` read the columns they need.
    Spark removes the shuffle files of the write when it has ended, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(df: DataFrame, key: str) -> np.ndarray:
    """MARKS bits, those at the low bits of ``key`` set; its size does not depend on the input."""
    low = F.col(key).bitwiseAND(F.lit(MARKS - 1))
    words = df.select(F.shiftright(low, 6).alias("word"), F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MARKS >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def in_bitmap(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (MARKS - 1)
    return (marks[at >> 6] >> (at & 63)) & 1 == 1


def buckets_for(rows: int, per_bucket: int, least: int = 1) -> int:
    """How many buckets keep each at about ``per_bucket`` rows."""
    return max(least, -(-rows // per_bucket))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str | Column], name: str, rows: int,
                 rows_per_bucket: int = 200_000) -> DataFrame:
    """Add ``name``: 0, 1, 2 … inside each ``keys``, in the order of a hashed bucket and then of ``order``.

    ``rows`` is about the number of rows. A key of any size is cut into buckets by the hash of its order columns. Rows are numbered inside their
    bucket; the buckets' counts, one row each, give where a bucket starts. Rows equal in all of ``order`` may
    take their numbers in either way, so write the result before it is used twice.
    """
    n = buckets_for(rows, rows_per_bucket, 64)
    marked = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = marked.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"__k_{k}") for k in [*keys, "__b"]], F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s")
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    numbered = marked.withColumn("__r", F.row_number().over(inside) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in [*keys, "__b"]]
    return numbered.join(starts, on).select(*df.columns, (F.col("__s") + F.col("__r")).cast("long").alias(name))
