"""One row of model features per refuel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.operators import daily, linkage, matching, sequence
from tallyhound.operators.prepare import off_network_refuels
from tallyhound.operators.rules import charges, place, quality, volume
from tallyhound.operators.settle import settle
from tallyhound.operators.skew import first_by, group_quantiles

RATIO_CAP = 5.0  # fixed value: relative figures are cut here
BASE = ["tank_ratio", "km", "excess_km"]
CONTEXT = ["litres_vs_usual", "back_km", "relative_rate", "day_refuels", "day_tanks", "zone_distance", "track_distance",
           "no_track", "inactive", "exempt", "no_request", "litres_vs_authorised"]


def _or(column: str, value: float) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(value))


def excluded_ids(refuels: DataFrame) -> DataFrame:
    """Exact duplicates and double charges: not refuels of their own. ``refuels`` is typed."""
    plain = refuels.drop("instant")
    return quality.exact_duplicates(plain).select(F.col("record_id").alias("id")).unionByName(
        charges.double_charges(refuels).select(F.col("record_id").alias("id"))).distinct()


def build_features(
    vehicles: DataFrame,
    refuels: DataFrame,
    stations: DataFrame | None = None,
    tracks: DataFrame | None = None,
    requests: DataFrame | None = None,
    exemptions: DataFrame | None = None,
    excluded: DataFrame | None = None,
    pairs: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """The features of every refuel with an id; where nothing can be said a neutral 0 or 1 stands.

    ``refuels`` and ``requests`` are typed. ``excluded`` and ``pairs`` can be handed over when the rules
    have them already. A repeated id keeps its first refuel only.
    """
    base = first_by(refuels.filter(F.col("id").isNotNull()), ["id"], ["instant", "vehicle_id", "litres"])
    excluded = settle(excluded_ids(base)) if excluded is None else excluded
    off = off_network_refuels(requests) if requests is not None else None
    steps = sequence.odometer_sequence(base, excluded, off, hot_rows=hot_rows).filter(~F.col("off_network"))
    out = volume.with_capacity(base, vehicles).withColumn("tank_ratio", F.try_divide("litres", "tank_capacity"))
    out = out.join(steps.select("id", "km", (F.col("km") - F.col("expected_km")).alias("excess_km")), "id", "left")
    out = out.withColumns({"km": _or("km", 0), "excess_km": _or("excess_km", 0)})
    if "state_date" not in vehicles.columns:
        return out.select("id", *BASE)

    usual = group_quantiles(base.filter(F.col("vehicle_id").isNotNull()), ["vehicle_id"], "litres", {"__usual": 0.5}, hot_rows)
    days = daily.daily_refuels(base, vehicles, excluded, tracks, off).select(
        "vehicle_id", "date", daily.best_relative().alias("relative_rate"), F.col("refuels").alias("day_refuels"),
        F.try_divide("litres", "tank_capacity").alias("day_tanks"))
    counted = base.select("id", "vehicle_id", "date").join(excluded, "id", "left_anti").join(days, ["vehicle_id", "date"]).select(
        "id", "relative_rate", "day_refuels", "day_tanks")
    idle = vehicles.filter((F.col("state") != volume.IN_SERVICE) & F.col("state_date").isNotNull()).groupBy("vehicle_id").agg(
        F.min(F.col("state_date").cast("date")).alias("__since"))
    exempt = linkage.exempt_refuels(base, vehicles, exemptions).withColumn("exempt", F.lit(1.0))
    out = out.join(usual, "vehicle_id", "left").join(counted, "id", "left").join(idle, "vehicle_id", "left").join(exempt, "id", "left")
    out = out.withColumns({
        "litres_vs_usual": F.try_divide("litres", "__usual"),
        "back_km": F.when(F.col("km") < 0, -F.col("km")).otherwise(0.0),
        "relative_rate": F.least(_or("relative_rate", 1), F.lit(RATIO_CAP)),
        "day_refuels": _or("day_refuels", 1), "day_tanks": F.coalesce("day_tanks", "tank_ratio"),
        "inactive": F.coalesce((F.col("date") >= F.col("__since")).cast("double"), F.lit(0.0)), "exempt": _or("exempt", 0),
    })
    names = [*BASE, "litres_vs_usual", "back_km", "relative_rate", "day_refuels", "day_tanks"]
    if stations is not None:
        zone = place.distance_to_usual_zone(base, stations).select("id", F.col("zone_km").alias("zone_distance"))
        out = out.join(zone, "id", "left").withColumn("zone_distance", _or("zone_distance", 0))
        names.append("zone_distance")
        if tracks is not None:
            line = place.distance_to_track(base, vehicles, stations, tracks).select("id", F.col("track_km").alias("track_distance"))
            out = out.join(line, "id", "left").withColumns({
                "no_track": F.col("track_distance").isNull().cast("double"), "track_distance": _or("track_distance", 0)})
            names += ["track_distance", "no_track"]
    names += ["inactive", "exempt"]
    if requests is not None and "settled" in requests.columns:
        if pairs is None:
            pairs = settle(matching.context_pairs(base, requests, vehicles, excluded, hot_rows))
        asked = pairs.join(requests.select(F.col("id").alias("request_id"), F.col("authorised").cast("double").alias("authorised")),
                           "request_id").select(F.col("refuel_id").alias("id"), "authorised")
        ratio = F.try_divide("litres", "authorised")
        out = out.join(asked, "id", "left").withColumns({
            "no_request": F.col("authorised").isNull().cast("double"),
            "litres_vs_authorised": F.least(F.coalesce(ratio, F.lit(1.0)), F.lit(RATIO_CAP))})
        names += ["no_request", "litres_vs_authorised"]
    return out.select("id", *names)
