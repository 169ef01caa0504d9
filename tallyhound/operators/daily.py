"""Refuels summed per vehicle and day, with the distance since the refuelling day before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.operators.sequence import with_off_network, without
from tallyhound.operators.skew import group_quantiles


def _track_intervals(days: DataFrame, tracks: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Track km and days between consecutive refuelling days (first excluded, last included).

    Each track day belongs to the next refuelling day on or after it, so one pass over both, ordered by
    date, adds up every interval. Groups hold the calendar days of one vehicle.
    """
    owner = vehicles.select("vehicle_id", "plate").filter(F.col("plate").isNotNull()).distinct()
    tracked = tracks.select("plate", F.col("date").cast("date").alias("date"), "km").join(owner, "plate").drop("plate")
    both = tracked.withColumn("__end", F.lit(None).cast("date")).unionByName(
        days.select("vehicle_id", "date", F.lit(None).cast("double").alias("km"), F.col("date").alias("__end"))
    )
    ahead = Window.partitionBy("vehicle_id").orderBy("date").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    days_dates = both.withColumn("__end", F.first("__end", ignorenulls=True).over(ahead))
    return days_dates.filter(F.col("km").isNotNull() & F.col("__end").isNotNull()).groupBy(
        "vehicle_id", F.col("__end").alias("date")
    ).agg(F.sum("km").alias("__km"), F.count(F.lit(1)).alias("__days"))


def daily_refuels(
    refuels: DataFrame,
    vehicles: DataFrame,
    excluded: DataFrame | None = None,
    tracks: DataFrame | None = None,
    off_network: DataFrame | None = None,
) -> DataFrame:
    """One row per vehicle and day with a refuel of the report.

    Off-network refuels add their litres and close the intervals, but a day with nothing else is not
    returned. Each km per litre is compared with the vehicle's own median and with its type's median; the
    medians are taken before days without a refuel of the report are dropped. Members of a day are not
    collected: rules join back by vehicle and date.
    """
    columns = ["id", "vehicle_id", "date", "litres", "odometer"]
    typed = without(refuels, excluded).withColumn("odometer", F.col("odometer").cast("double"))
    base = with_off_network(typed, off_network, columns).filter(F.col("vehicle_id").isNotNull() & F.col("date").isNotNull())
    days = base.groupBy("vehicle_id", "date").agg(
        F.coalesce(F.sum("litres"), F.lit(0.0)).alias("litres"), F.count("id").alias("refuels"),
        F.max("odometer").alias("odometer"),
        F.count(F.when(~F.col("off_network"), F.col("id"))).alias("report_refuels"),
    )
    # From here on a group is the refuelling days of one vehicle: bounded by the calendar.
    by_vehicle = Window.partitionBy("vehicle_id").orderBy("date")
    last_reading = F.last("odometer", True).over(by_vehicle.rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumns({"previous_day": F.lag("date").over(by_vehicle), "odometer_km": F.col("odometer") - last_reading})
    days = days.withColumn("odometer_rate", F.when(F.col("odometer_km") >= 0, F.try_divide("odometer_km", "litres")))
    facts = vehicles.groupBy("vehicle_id").agg(
        F.min("tank_capacity").alias("tank_capacity"), F.min("vehicle_type").alias("vehicle_type")
    )
    days = days.join(facts, "vehicle_id", "left")

    if tracks is None:
        days = days.withColumns({"track_km": F.lit(None).cast("double"), "track_complete": F.lit(False)})
    else:
        sums = _track_intervals(days, tracks, vehicles)
        reporting = vehicles.join(tracks.select("plate").distinct(), "plate", "left_semi").select(
            "vehicle_id", F.lit(True).alias("__tracked")).distinct()
        dates = tracks.select(F.col("date").cast("date").alias("d"))
        first = dates.agg(F.date_sub(F.min("d"), 1)).scalar()
        last = dates.agg(F.max("d")).scalar()
        known = F.col("__tracked") & F.col("previous_day").isNotNull() & F.col("date").between(first, last)
        days = days.join(sums, ["vehicle_id", "date"], "left").join(reporting, "vehicle_id", "left")
        km = F.when(known, F.coalesce("__km", F.lit(0.0)))
        complete = km.isNotNull() & (F.coalesce("__days", F.lit(0)) == F.datediff("date", "previous_day"))
        days = days.withColumns({"track_km": km, "track_complete": F.coalesce(complete, F.lit(False))}).drop(
            "__km", "__days", "__tracked")
    days = days.withColumn("track_rate", F.when(F.col("track_complete"), F.try_divide("track_km", "litres")))

    own = Window.partitionBy("vehicle_id")
    for rate in ("odometer", "track"):
        days = days.withColumn(f"{rate}_relative", F.try_divide(F.col(f"{rate}_rate"), F.median(f"{rate}_rate").over(own)))
    # A type holds a large share of all days, so its medians are taken without bringing its days together.
    long = days.filter(F.col("vehicle_type").isNotNull()).select(
        "vehicle_type", F.explode(F.array(*[
            F.struct(F.lit(r).alias("__rate"), F.col(f"{r}_rate").alias("__value")) for r in ("odometer", "track")
        ])).alias("__s"),
    ).select("vehicle_type", "__s.__rate", "__s.__value")
    medians = group_quantiles(long, ["vehicle_type", "__rate"], "__value", {"__m": 0.5}, hot_rows=0)
    typical = medians.groupBy("vehicle_type").agg(*[
        F.max(F.when(F.col("__rate") == r, F.col("__m"))).alias(f"__{r}") for r in ("odometer", "track")
    ])
    days = days.join(typical, "vehicle_type", "left").withColumns({
        f"{r}_vs_type": F.try_divide(F.col(f"{r}_rate"), F.col(f"__{r}")) for r in ("odometer", "track")
    }).drop("__odometer", "__track")
    return days.filter(F.col("report_refuels") > 0)


def members(refuels: DataFrame, days: DataFrame, excluded: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """The report's refuels of the given days, one row per refuel."""
    rows = without(refuels, excluded).select("id", "vehicle_id", "date")
    return rows.join(days.select("vehicle_id", "date", *(keep or [])), ["vehicle_id", "date"])


def tracked_intervals(refuels: DataFrame, days: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Track km since the refuelling day before, per refuel."""
    return members(refuels, days, excluded, ["track_km", "track_complete"]).filter(F.col("id").isNotNull())


def best_relative() -> Column:
    return F.coalesce("track_relative", "odometer_relative")
