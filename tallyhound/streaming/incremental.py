"""Files that keep arriving, loaded by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyhound.sources.relational import KeyedTables


def incremental_load(spark: SparkSession, source: str, schema: T.StructType, store: KeyedTables, table: str,
                     checkpoint: str, fmt: str = "parquet", files_per_batch: int | None = None,
                     key: list[str] | None = None, order: list[str] | None = None):
    """Load the files that arrived since the last run into ``table`` and stop; returns the finished query.

    Every micro-batch is put in by key, so records that arrive late or twice end up as in one full load,
    and a batch repeated after a failure changes nothing. ``key`` stands in for the table's own; with ``order`` the
    latest row of a key stays whichever batch it came in.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.load({table: batch}, f"{source}#{number}", keys={table: key} if key else None, order={table: order or []})

    query = (
        reader.load(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
