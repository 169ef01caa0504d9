"""Typing of the operational records: dates, instants and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.dates import instant, parse_date2
from tallyhound.functions.text import as_number

# Fixed values of the sources.
OFF_NETWORK = "ESTACION AJENA"
FALLBACK = "CONTINGENCIA"
PERSONAL = "DNI"


def _date(df: DataFrame):
    return parse_date2(F.col("date")) if dict(df.dtypes)["date"] == "string" else F.col("date").cast("date")


def typed_refuels(refuels: DataFrame) -> DataFrame:
    """Refuels with ``date`` as a date and ``instant``; a missing time counts as midnight."""
    df = refuels.withColumn("date", _date(refuels))
    time = F.col("time") if "time" in df.columns else F.lit(None).cast("string")
    return df.withColumn("instant", instant(F.col("date"), time))


def typed_requests(requests: DataFrame) -> DataFrame:
    """Requests with typed date, ``instant`` and the flags ``is_settled`` and ``is_voided``."""
    df = requests.withColumn("date", _date(requests))
    yes = lambda c: F.coalesce(F.upper(F.col(c).cast("string")) == "SI", F.lit(False))
    return df.withColumns({
        "instant": instant(F.col("date"), F.col("time")),
        "is_settled": yes("settled"),
        "is_voided": yes("voided"),
    })


def off_network_refuels(requests: DataFrame | None) -> DataFrame | None:
    """Refuels at stations of another network, known only from settled requests that were not voided."""
    if requests is None or "station" not in requests.columns:
        return None
    typed = requests if "is_settled" in requests.columns else typed_requests(requests)
    litres = F.coalesce(as_number(F.col("loaded")), as_number(F.col("authorised")))
    return typed.filter(
        (F.col("station") == OFF_NETWORK) & F.col("is_settled") & ~F.col("is_voided") & F.col("vehicle_id").isNotNull()
    ).select(
        F.concat(F.lit("FUERA-"), F.col("id").cast("string")).alias("id"), "vehicle_id", "date", "instant",
        as_number(F.col("odometer")).alias("odometer"), litres.alias("litres"),
    ).filter(F.col("date").isNotNull() & F.col("litres").isNotNull())
