"""Plane and sphere distances in kilometres."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilometres per degree and the reference latitude of the plane projection.
KM_PER_LON_DEGREE = 111.32
KM_PER_LAT_DEGREE = 110.57
REFERENCE_LATITUDE = -34.65
EARTH_RADIUS_KM = 6371.0


def plane_km(lat: Column, lon: Column, reference_latitude: float = REFERENCE_LATITUDE) -> tuple[Column, Column]:
    """East and north kilometres on a local plane; good for tens of kilometres."""
    return lon * F.lit(KM_PER_LON_DEGREE * cos(radians(reference_latitude))), lat * F.lit(KM_PER_LAT_DEGREE)


def segment_distance_km(lat, lon, lat0, lon0, lat1, lon1, reference_latitude: float = REFERENCE_LATITUDE) -> Column:
    """Distance from a point to the segment between two others; a segment of no length is a point."""
    px, py = plane_km(lat, lon, reference_latitude)
    ax, ay = plane_km(lat0, lon0, reference_latitude)
    bx, by = plane_km(lat1, lon1, reference_latitude)
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    along = F.when(length2 > 0, F.try_divide((px - ax) * dx + (py - ay) * dy, length2)).when(length2 == 0, F.lit(0.0))
    t = F.when(along < 0, 0.0).when(along > 1, 1.0).otherwise(along)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def haversine_km(lat0, lon0, lat1, lon1) -> Column:
    h = (
        F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2)
        + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))
