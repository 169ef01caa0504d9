"""Rules on the odometer sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.operators.alerts import alerts
from tallyhound.operators.sequence import MILD_KM, RESET_KM, is_reading_typo

# Fixed values.
JUMP_KM, JUMP_DAYS = 500, 7
HISTORY_EXCESS_KM = 1_000
SOURCE_ADVANCE_KM = 5


def _regressions(rows: DataFrame, rule: str) -> DataFrame:
    kind = F.when(F.col("km") > -MILD_KM, "ODOMETRO_REGRESIVO_LEVE").otherwise("ODOMETRO_REGRESIVO")
    return alerts(rows, F.col("id"), kind, rule, F.format_string("goes back %d km", (-F.col("km")).cast("long")), F.col("km"))


def decreases(sequence: DataFrame) -> DataFrame:
    """``odometro_disminuye``: reads less than at the refuel before."""
    return _regressions(sequence.filter(F.col("km") < 0), "odometro_disminuye")


def decreases_in_context(sequence: DataFrame) -> DataFrame:
    """``retroceso_con_contexto``: no new odometer, no typo, no exemption, not of another network."""
    rows = sequence.filter(
        (F.col("km") < 0) & (F.col("odometer") >= RESET_KM) & ~is_reading_typo() & ~F.col("off_network") & ~F.col("exempt")
    )
    return _regressions(rows, "retroceso_con_contexto")


def jump_fixed(sequence: DataFrame, km: int = JUMP_KM, days: int = JUMP_DAYS) -> DataFrame:
    """``salto_umbral_fijo``: more than ``km`` within ``days``."""
    rows = sequence.filter((F.col("km") > km) & (F.col("days") <= days))
    return alerts(rows, F.col("id"), "ODOMETRO_SALTO", "salto_umbral_fijo",
                  F.format_string("%d km in %d days", F.col("km").cast("long"), "days"), F.col("km"))


def _excess():
    return F.col("km") - F.col("expected_km")


def jump_by_history(sequence: DataFrame, excess_km: int = HISTORY_EXCESS_KM) -> DataFrame:
    """``salto_historial_vehiculo``: far more than the vehicle usually does in those days."""
    rows = sequence.filter(_excess() > excess_km)
    return alerts(rows, F.col("id"), "ODOMETRO_SALTO", "salto_historial_vehiculo",
                  F.format_string("%.0f km more than usual", _excess()), _excess())


def jump_in_context(sequence: DataFrame, tracked: DataFrame | None = None, excess_km: int = HISTORY_EXCESS_KM) -> DataFrame:
    """``salto_con_contexto``: no typo, no exemption before or now, and no full track that confirms the distance.

    ``tracked`` has ``id``, ``track_km`` and ``track_complete`` per refuel.
    """
    rows = sequence.filter(
        (_excess() > excess_km) & ~is_reading_typo() & ~F.col("off_network") & ~F.col("exempt") & ~F.col("after_exempt")
    )
    if tracked is not None:
        confirmed = F.col("track_complete") & (F.col("km") - F.col("track_km") <= excess_km)
        rows = rows.join(tracked.select("id", "track_km", "track_complete"), "id", "left").filter(
            ~F.coalesce(confirmed, F.lit(False))
        )
    return alerts(rows, F.col("id"), "ODOMETRO_SALTO", "salto_con_contexto",
                  F.format_string("%.0f km more than usual, not backed by the track", _excess()), _excess())


_STILL = "ODOMETRO_SIN_AVANCE"


def no_advance(sequence: DataFrame) -> DataFrame:
    """``odometro_sin_avance``: the same reading as at the refuel before."""
    return alerts(sequence.filter((F.col("km") == 0) & ~F.col("off_network")), F.col("id"), _STILL, "odometro_sin_avance",
                  "no advance since the refuel before")


def small_advance(sequence: DataFrame, exempt_today: DataFrame, km: int = SOURCE_ADVANCE_KM) -> DataFrame:
    """``avance_menor_a_5_km``: from 0 to under ``km``, unless the register exempts the vehicle today."""
    rows = sequence.filter((F.col("km") >= 0) & (F.col("km") < km) & ~F.col("off_network"))
    rows = rows.join(exempt_today.select("id").distinct(), "id", "left_anti")
    return alerts(rows, F.col("id"), _STILL, "avance_menor_a_5_km",
                  F.format_string("advanced %d km", F.col("km").cast("long")), F.col("km"))


def no_advance_without_exemption(sequence: DataFrame) -> DataFrame:
    """``sin_avance_sin_excepcion``: the same reading on a later day and no exemption in force."""
    rows = sequence.filter((F.col("km") == 0) & (F.col("days") > 0) & ~F.col("exempt") & ~F.col("off_network"))
    return alerts(rows, F.col("id"), _STILL, "sin_avance_sin_excepcion", "no advance and no exemption in force")
