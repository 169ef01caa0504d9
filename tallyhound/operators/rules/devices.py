"""Devices still installed or transmitting on vehicles being written off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.operators.alerts import alerts
from tallyhound.operators.linkage import link_identifiers
from tallyhound.operators.rules.links import DEPOT_GROUP

SILENT_DAYS = 7  # fixed value: days without contact that raise the alarm
ACTIVE = "DISPOSITIVO_ACTIVO_EN_BAJA"


def last_contact(devices: DataFrame) -> Column:
    if dict(devices.dtypes)["last_contact"] == "string":
        return F.col("last_contact").try_cast("timestamp")
    return F.col("last_contact").cast("timestamp")


def written_off_devices(vehicles: DataFrame, devices: DataFrame) -> DataFrame:
    """Devices whose plate, however written, or engine suffix leads to a vehicle in a BAJA state."""
    off = vehicles.filter(F.col("state").contains("BAJA")).select(F.col("vehicle_id").alias("linked_vehicle")).distinct()
    return link_identifiers(devices, "plate", vehicles).join(off, "linked_vehicle", "left_semi").withColumn(
        "contact_at", last_contact(devices)
    )


def written_off_with_device(vehicles: DataFrame, devices: DataFrame) -> DataFrame:
    """``baja_con_dispositivo``: a written-off vehicle has a device."""
    return alerts(written_off_devices(vehicles, devices), F.col("alias"), ACTIVE, "baja_con_dispositivo",
                  F.concat_ws(" ", F.lit("written-off vehicle, device in group"), F.col("device_group")))


def written_off_unreadable(vehicles: DataFrame, devices: DataFrame) -> DataFrame:
    """Devices of written-off vehicles whose last contact cannot be read: to be checked by hand."""
    return written_off_devices(vehicles, devices).filter(F.col("contact_at").isNull())


def still_transmitting(vehicles: DataFrame, devices: DataFrame, days: int = SILENT_DAYS) -> DataFrame:
    """Devices of written-off vehicles in contact within ``days`` (included) of the latest contact of any device."""
    latest = devices.select(last_contact(devices).alias("at")).agg(F.max("at")).scalar()
    silent = F.unix_seconds(latest) - F.unix_seconds("contact_at")
    return written_off_devices(vehicles, devices).withColumn("silent_seconds", silent).filter(
        F.col("silent_seconds") <= days * 86_400
    )


def active_device(vehicles: DataFrame, devices: DataFrame, days: int = SILENT_DAYS) -> DataFrame:
    """``dispositivo_activo_en_baja``: a written-off vehicle's device still transmits, in whatever group it is."""
    stale = F.when(F.col("device_group") == DEPOT_GROUP, F.lit(" (group out of date)")).otherwise(F.lit(""))
    found = still_transmitting(vehicles, devices, days)
    return alerts(found, F.col("alias"), ACTIVE, "dispositivo_activo_en_baja",
                  F.concat(F.lit("written-off vehicle, device transmitting"), stale),
                  F.floor(F.col("silent_seconds") / 86_400))
