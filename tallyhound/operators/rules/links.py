"""Records that belong to no vehicle of the register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.text import normalise_id
from tallyhound.operators.alerts import alerts
from tallyhound.operators.linkage import cumulative_links, is_personal, refuel_links, request_links

INVALID = "DOMINIO_INVALIDO"
DEPOT_GROUP = "BAJA / REEMPLAZOS"  # fixed value: group of withdrawn devices


def unknown_plate(refuels: DataFrame, vehicles: DataFrame, normalised: bool = False) -> DataFrame:
    """``dominio_sin_vinculo``: the plate is not in the register; a missing plate is not either.

    With ``normalised`` spelling does not count and cards of a person are left out.
    """
    if not normalised:
        known = vehicles.select("plate").distinct()
        return alerts(refuels.join(known, "plate", "left_anti"), F.col("id"), INVALID, "dominio_sin_vinculo",
                      F.concat_ws(" ", F.lit("unknown plate"), F.col("plate")))
    known = vehicles.select(normalise_id(F.col("plate")).alias("__norm")).distinct()
    rest = refuels.filter(~is_personal(refuels)).withColumn("__norm", normalise_id(F.col("plate")))
    return alerts(rest.join(known, "__norm", "left_anti"), F.col("id"), INVALID, "dominio_sin_vinculo_normalizado",
                  F.concat_ws(" ", F.lit("plate unknown however it is written:"), F.col("plate")))


def unlinked_refuel(refuels: DataFrame, vehicles: DataFrame) -> DataFrame:
    """``carga_sin_movil_identificado``: neither plate, engine nor card lead to a vehicle."""
    rest = refuel_links(refuels, vehicles).filter(~F.col("link_card") & ~F.col("personal"))
    return alerts(rest, F.col("id"), INVALID, "carga_sin_movil_identificado", "no vehicle by plate, engine or card")


def unlinked_request(requests: DataFrame, vehicles: DataFrame) -> DataFrame:
    """``pedido_sin_movil_identificado``: neither plate, engine nor vehicle id lead to a vehicle."""
    rest = request_links(requests, vehicles).filter(~F.col("link_vehicle"))
    return alerts(rest, F.col("id"), INVALID, "pedido_sin_movil_identificado", "no vehicle by plate, engine or id")


def unlinked_device(devices: DataFrame, vehicles: DataFrame) -> DataFrame:
    """``dispositivo_sin_movil_identificado``: an installed device whose plate leads to no vehicle."""
    installed = devices
    if "device_group" in devices.columns:
        installed = devices.filter(~F.col("device_group").eqNullSafe(F.lit(DEPOT_GROUP)))
    rest = cumulative_links(installed, "plate", vehicles).filter(~F.col("link_engine"))
    return alerts(rest, F.col("alias"), INVALID, "dispositivo_sin_movil_identificado", "the plate leads to no vehicle")
