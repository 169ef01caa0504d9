"""Reading and writing whole datasets of named tables."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def load_dataset(spark: SparkSession, directory: str, schemas: dict[str, T.StructType | None],
                 fmt: str = "parquet") -> dict[str, DataFrame | None]:
    """The tables of a directory by name; a table that is not there is None, and rules that need it are skipped.

    CSV is read with the declared schema; nothing is inferred.
    """
    out: dict[str, DataFrame | None] = {}
    for name, schema in schemas.items():
        path = f"{directory}/{name}.{fmt}"
        if not path_exists(spark, path):
            out[name] = None
            continue
        reader = spark.read if schema is None else spark.read.schema(schema)
        out[name] = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return out


def filter_in(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose columns hold one of the wanted values; an empty list or an absent column filters nothing."""
    for column, values in wanted.items():
        if values and column in df.columns:
            df = df.filter(F.col(column).isin(values))
    return df


def write_dataset(tables: dict[str, DataFrame | None], directory: str, fmt: str = "parquet") -> None:
    """Write the tables that exist, their data dictionary and a note of when and what was written."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    fields = []
    for name, df in tables.items():
        if df is None:
            continue
        df.write.mode("overwrite").option("header", True).format(fmt).save(f"{directory}/{name}.{fmt}")
        fields += [(name, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    dictionary = spark.createDataFrame(fields, "table string, position int, column string, type string, nullable boolean")
    dictionary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{directory}/dictionary.csv")
    note = [(datetime.now(timezone.utc).isoformat(timespec="seconds"), json.dumps(sorted({f[0] for f in fields})))]
    spark.createDataFrame(note, "written_at string, tables string").coalesce(1).write.mode("overwrite").json(
        f"{directory}/metadata.json")


def write_alerts(alerts: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write alerts partitioned by rule, so that one rule is read without the others."""
    alerts.write.mode("overwrite").partitionBy("rule").format(fmt).save(path)
