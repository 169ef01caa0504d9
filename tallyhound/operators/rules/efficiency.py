"""Splitting a tank over several refuels, refuels close in time, and poor distance per litre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.operators.alerts import alerts
from tallyhound.operators.daily import best_relative, members
from tallyhound.operators.sequence import without
from tallyhound.operators.skew import OrderedGroups, per_heat

# Fixed values.
SPLIT_TANKS = 1.05
SPLIT_MINIMUM_RATE = 0.75
MULTIPLE_HOURS = 6
MINIMUM_RATE = 0.32
MINIMUM_TANK_SHARE = 0.3
SOURCE_MINIMUM_RATE = 0.7
SOURCE_MAXIMUM_KM = 2_000


def split_tank(refuels: DataFrame, days: DataFrame, excluded: DataFrame | None = None, by_distance: bool = False) -> DataFrame:
    """``fraccionamiento_diario``: two or more refuels of a day exceed the tank together.

    ``fraccionamiento_sin_recorrido`` also asks that the distance does not justify the fuel; an unknown
    distance keeps the alert.
    """
    flagged = days.filter((F.col("refuels") >= 2) & (F.col("litres") > F.col("tank_capacity") * SPLIT_TANKS))
    rule = "fraccionamiento_diario"
    if by_distance:
        rule = "fraccionamiento_sin_recorrido"
        flagged = flagged.filter(~F.coalesce(best_relative() >= SPLIT_MINIMUM_RATE, F.lit(False)))
    flagged = flagged.withColumn("tanks", F.try_divide("litres", "tank_capacity"))
    return alerts(members(refuels, flagged, excluded, ["refuels", "tanks"]), F.col("id"), "FRACCIONAMIENTO", rule,
                  F.format_string("%d refuels, %.2f tanks in the day", "refuels", "tanks"), F.col("tanks"))


def refuels_close_in_time(refuels: DataFrame, duplicates: DataFrame | None = None, hours: int = MULTIPLE_HOURS,
                          hot_rows: int | None = None) -> DataFrame:
    """``cargas_menos_de_6_horas``: another refuel of the vehicle less than ``hours`` before or after."""
    groups = OrderedGroups(["vehicle_id"], ["instant", "id"])
    rows = without(refuels, duplicates).filter(F.col("vehicle_id").isNotNull() & F.col("instant").isNotNull()).select(
        "id", "vehicle_id", "instant")
    second = F.unix_seconds("instant")

    def body(part: DataFrame, hot: bool) -> DataFrame:
        return groups.neighbours(part, {"__before": (second, 1), "__after": (second, -1)}, hot)

    near = per_heat(rows, ["vehicle_id"], body, hot_rows)
    gap = F.least(second - F.col("__before"), F.col("__after") - second)
    return alerts(near.filter(gap < hours * 3600), F.col("id"), "FRACCIONAMIENTO", "cargas_menos_de_6_horas",
                  f"another refuel of the vehicle within {hours} hours", gap)


def _enough_litres():
    return F.col("litres") >= F.col("tank_capacity") * MINIMUM_TANK_SHARE


def _drop_days_with(days: DataFrame, refuels: DataFrame, excluded: DataFrame | None, ids: DataFrame | None) -> DataFrame:
    """Days none of whose refuels is among ``ids``: the rate belongs to the day, not to one refuel."""
    if ids is None:
        return days
    touched = without(refuels, excluded).join(ids.select("id").distinct(), "id", "left_semi")
    return days.join(touched.select("vehicle_id", "date").distinct(), ["vehicle_id", "date"], "left_anti")


def low_rate(refuels: DataFrame, days: DataFrame, source: str, excluded: DataFrame | None = None,
             without_reading: DataFrame | None = None, explained: DataFrame | None = None,
             minimum: float = MINIMUM_RATE) -> DataFrame:
    """``rendimiento_bajo_odometro`` / ``rendimiento_bajo_gps``: far below the vehicle's own median.

    By the track, the odometer stands in where the track is not complete. Days with a refuel another rule
    explains, or without a usable reading, are dropped as a whole.
    """
    relative = best_relative() if source == "gps" else F.col("odometer_relative")
    flagged = days.withColumn("relative", relative).filter(_enough_litres() & (F.col("relative") < minimum))
    flagged = _drop_days_with(_drop_days_with(flagged, refuels, excluded, explained), refuels, excluded, without_reading)
    return alerts(members(refuels, flagged, excluded, ["relative"]), F.col("id"), "CONSUMO_ATIPICO",
                  f"rendimiento_bajo_{source}", F.format_string("%.2f times the usual rate", "relative"), F.col("relative"))


def low_rate_by_type(refuels: DataFrame, days: DataFrame, source: str = "odometro", excluded: DataFrame | None = None,
                     without_reading: DataFrame | None = None, explained: DataFrame | None = None,
                     minimum: float = SOURCE_MINIMUM_RATE, maximum_km: float = SOURCE_MAXIMUM_KM) -> DataFrame:
    """``rendimiento_fuente``: below 0.7 of the type's median; longer stretches count as typing errors."""
    relative, km = F.col("odometer_vs_type"), F.col("odometer_km")
    if source == "gps":
        relative, km = F.coalesce("track_vs_type", relative), F.coalesce("track_km", km)
    flagged = days.withColumns({"relative": relative, "stretch": km}).filter(
        _enough_litres() & (F.col("relative") < minimum) & (F.col("stretch") <= maximum_km)
    )
    flagged = _drop_days_with(_drop_days_with(flagged, refuels, excluded, explained), refuels, excluded, without_reading)
    return alerts(members(refuels, flagged, excluded, ["relative"]), F.col("id"), "CONSUMO_ATIPICO", "rendimiento_fuente",
                  F.format_string("%.2f times the median of its type", "relative"), F.col("relative"))
