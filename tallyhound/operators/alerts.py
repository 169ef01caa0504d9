"""The alert record every rule returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.operators.skew import first_by

ALERT_COLUMNS = ["record_id", "anomaly_type", "rule", "detail", "measure"]


def _column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def alerts(df: DataFrame, record_id: Column, anomaly_type: Column | str, rule: Column | str,
           detail: Column | str = "", measure: Column | None = None, extra: list[str] | None = None) -> DataFrame:
    """One alert per row of ``df``; ``measure`` is the number the rule decided on."""
    return df.select(
        record_id.cast("string").alias("record_id"),
        _column(anomaly_type).alias("anomaly_type"),
        _column(rule).alias("rule"),
        _column(detail).cast("string").alias("detail"),
        (F.lit(None) if measure is None else measure).cast("double").alias("measure"),
        *(extra or []),
    )


def alerts_of_each_row(df: DataFrame, record_id: Column,
                       candidates: list[tuple[Column, str, str, Column | str, Column | None]]) -> DataFrame:
    """Several rules over one pass: (condition, type, rule, detail, measure) for each.

    A condition that is null does not raise an alert.
    """
    items = [
        F.when(condition, F.struct(
            F.lit(kind).alias("anomaly_type"), F.lit(rule).alias("rule"),
            _column(detail).cast("string").alias("detail"),
            (F.lit(None) if measure is None else measure).cast("double").alias("measure"),
        ))
        for condition, kind, rule, detail, measure in candidates
    ]
    raised = df.select(record_id.cast("string").alias("record_id"), F.array_compact(F.array(*items)).alias("__a"))
    return raised.filter(F.size("__a") > 0).select("record_id", F.inline("__a"))


def union_alerts(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_records(alerts: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Alerts with the fields of the record that they are about, whichever table holds it.

    ``tables`` gives each table and its key, in order of precedence; tables of unlike columns are filled with nulls. An id that
    several tables or rows hold gets the fields of the first table, there of the row that ``first_by`` puts first. Adds
    ``record_table``; an alert without a record keeps null fields.
    """
    parts = []
    for place, (name, (df, key)) in enumerate(tables.items()):
        fields = [F.col(c) for c in df.columns if c != key]
        one = first_by(df.select(F.col(key).cast("string").alias("record_id"), *fields).filter(F.col("record_id").isNotNull()), ["record_id"], [c for c in df.columns if c != key])
        parts.append(one.withColumns({"record_table": F.lit(name), "__place": F.lit(place)}))
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if len(parts) > 1:
        records = first_by(records, ["record_id"], ["__place"])
    return alerts.join(records.drop("__place"), "record_id", "left")
