"""Refuels far from where the vehicle usually is, or was that day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.geo import segment_distance_km
from tallyhound.operators.alerts import alerts
from tallyhound.operators.linkage import lookup

MAXIMUM_KM = 50  # fixed value


def with_station(refuels: DataFrame, stations: DataFrame) -> DataFrame:
    coords = stations.groupBy(F.col("code").alias("station")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return refuels.join(coords, "station", "left")


def distance_to_usual_zone(refuels: DataFrame, stations: DataFrame) -> DataFrame:
    """Adds ``zone_km``: distance to the median position of the vehicle's stations.

    The medians go over at most as many distinct values as there are stations, so the built-in percentile
    holds them easily however many refuels a vehicle has.
    """
    located = with_station(refuels, stations)
    zone = located.filter(F.col("vehicle_id").isNotNull()).groupBy("vehicle_id").agg(
        F.median("lat").alias("__lat"), F.median("lon").alias("__lon"))
    joined = located.join(zone, "vehicle_id", "left")
    here = [F.col("__lat"), F.col("__lon")]
    return joined.withColumn("zone_km", segment_distance_km(F.col("lat"), F.col("lon"), *here, *here)).drop("__lat", "__lon")


def distance_to_track(refuels: DataFrame, vehicles: DataFrame, stations: DataFrame, tracks: DataFrame) -> DataFrame:
    """Adds ``track_km``: distance to the line between the first and last position of the day; null without a track."""
    plates = lookup(vehicles, F.col("vehicle_id"), F.col("plate"), "vehicle_id", "__plate")
    located = with_station(refuels, stations).join(plates, "vehicle_id", "left")
    line = tracks.select(F.col("plate").alias("__plate"), F.col("date").cast("date").alias("date"),
                         *[F.col(c).alias(f"__{c}") for c in ("lat0", "lon0", "lat1", "lon1")])
    joined = located.join(line, ["__plate", "date"], "left")
    distance = segment_distance_km(F.col("lat"), F.col("lon"), *[F.col(f"__{c}") for c in ("lat0", "lon0", "lat1", "lon1")])
    return joined.withColumn("track_km", distance).drop("__plate", "__lat0", "__lon0", "__lat1", "__lon1")


def far_from_zone(refuels: DataFrame, stations: DataFrame, km: float = MAXIMUM_KM) -> DataFrame:
    """``carga_lejos_de_base``."""
    far = distance_to_usual_zone(refuels, stations).filter(F.col("zone_km") > km)
    return alerts(far, F.col("id"), "CARGA_FUERA_DE_ZONA", "carga_lejos_de_base",
                  F.format_string("%.0f km from its usual zone", "zone_km"), F.col("zone_km"))


def far_from_track(refuels: DataFrame, vehicles: DataFrame, stations: DataFrame, tracks: DataFrame,
                   km: float = MAXIMUM_KM) -> DataFrame:
    """``carga_lejos_del_gps``."""
    far = distance_to_track(refuels, vehicles, stations, tracks).filter(F.col("track_km") > km)
    return alerts(far, F.col("id"), "CARGA_FUERA_DE_ZONA", "carga_lejos_del_gps",
                  F.format_string("%.0f km from the day's track", "track_km"), F.col("track_km"))
