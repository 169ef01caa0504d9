"""The odometer sequence of each vehicle and what its neighbours tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.operators.skew import OrderedGroups, group_quantiles, per_heat

# Fixed values.
TYPO_KM = 500
RESET_KM = 10_000
MILD_KM = 1_000


def without(records: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Records whose id is not in ``excluded`` (one ``id`` column)."""
    return records if excluded is None else records.join(excluded.select("id").distinct(), "id", "left_anti")


def with_off_network(refuels: DataFrame, off_network: DataFrame | None, columns: list[str]) -> DataFrame:
    """The refuels with those of another network interleaved, told apart by ``off_network``."""
    own = refuels.select(*columns, F.lit(False).alias("off_network"))
    if off_network is None:
        return own
    return own.unionByName(off_network.select(*columns, F.lit(True).alias("off_network")))


def odometer_sequence(
    refuels: DataFrame,
    excluded: DataFrame | None = None,
    off_network: DataFrame | None = None,
    skip_repeats: bool = False,
    exempt: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Each reading against the valid reading before it.

    Empty readings and ``excluded`` ids are dropped first. Adds ``km``, ``days``, ``km_per_day`` (the
    vehicle's median), ``expected_km``, the two readings before and the one after, and whether the reading
    is exempt or follows an exempt one. With ``skip_repeats`` a reading equal to the one before does not
    count. The first reading of a vehicle has nothing to compare with and is left out.
    """
    columns = ["id", "vehicle_id", "date", "instant", "odometer"]
    typed = without(refuels, excluded).withColumn("odometer", F.col("odometer").cast("double"))
    data = with_off_network(typed, off_network, columns).filter(
        F.col("odometer").isNotNull() & F.col("vehicle_id").isNotNull() & F.col("instant").isNotNull()
    )
    if exempt is None:
        data = data.withColumn("exempt", F.lit(False))
    else:
        flags = exempt.select("id").distinct().withColumn("exempt", F.lit(True))
        data = data.join(flags, "id", "left").withColumn("exempt", F.coalesce("exempt", F.lit(False)))
    groups = OrderedGroups(["vehicle_id"], ["instant", "id"])

    def body(rows: DataFrame, hot: bool) -> DataFrame:
        reading = F.col("odometer")
        if skip_repeats:
            rows = groups.neighbours(rows, {"__before": (reading, 1)}, hot)
            rows = rows.filter(F.col("__before").isNull() | (F.col("__before") != reading)).drop("__before")
        rows = groups.neighbours(rows, {
            "previous": (reading, 1), "previous2": (reading, 2), "following": (reading, -1),
            "__date": (F.col("date"), 1), "__exempt": (F.col("exempt"), 1),
        }, hot)
        km, days = reading - F.col("previous"), F.datediff("date", "__date")
        rate = F.when(days > 0, F.when(km < 0, F.lit(0.0)).otherwise(km / days))
        rows = rows.withColumns({"km": km, "days": days, "__rate": rate})
        if hot:
            medians = group_quantiles(rows, ["vehicle_id"], "__rate", {"km_per_day": 0.5}, hot_rows=0)
            rows = rows.join(medians, "vehicle_id", "left")
        else:
            rows = rows.withColumn("km_per_day", F.median("__rate").over(Window.partitionBy("vehicle_id")))
        return rows

    out = per_heat(data, ["vehicle_id"], body, hot_rows)
    # The first reading is not part of the result, so a reading after it does not count as after an exemption.
    after = F.coalesce(F.col("__exempt"), F.lit(False)) & F.col("previous2").isNotNull()
    return out.filter(F.col("km").isNotNull()).select(
        *columns, "off_network", "exempt", after.alias("after_exempt"), "previous", "previous2", "following", "km", "days",
        "km_per_day", (F.col("km_per_day") * F.col("days")).alias("expected_km"),
    )


def _holds(condition: Column) -> Column:
    """A comparison with a missing neighbour does not hold."""
    return F.coalesce(condition, F.lit(False))


def _far() -> Column:
    return F.abs(F.col("previous") - F.col("odometer")) > TYPO_KM


def is_reading_typo() -> Column:
    """A change of the odometer that one mistyped reading explains.

    A hole (far below, and the next reading is back), a return after a peak, a peak (the next reading falls
    back) or a return after a hole.
    """
    km, reading = F.col("km"), F.col("odometer")
    hole = _holds((km < 0) & (F.col("following") >= F.col("previous")) & _far())
    after_peak = _holds((km < 0) & (F.col("previous2") <= reading) & _far())
    peak = _holds((km > 0) & (F.col("following") < reading))
    after_hole = _holds((km > 0) & (F.col("previous") < F.col("previous2")))
    return hole | after_peak | peak | after_hole


def regression_shapes(sequence: DataFrame) -> DataFrame:
    """Every reading below the one before, with its ``shape`` and ``sub_shape``."""
    after_jump = _holds((F.col("previous2") <= F.col("odometer")) & _far())
    isolated = _holds((F.col("following") >= F.col("previous")) & _far())
    shape = F.when(after_jump, "tras_un_salto").when(isolated, "lectura_baja_aislada").otherwise("otro")
    detail = (
        F.when(~_far(), "leve")
        .when(F.col("following").isNull() | F.col("previous2").isNull(), "sin_vecinos")
        .when(F.col("following") < F.col("previous"), "se_queda_abajo")
        .otherwise("otro_patron")
    )
    return sequence.filter(F.col("km") < 0).withColumn("shape", shape).withColumn(
        "sub_shape", F.when(F.col("shape") == "otro", detail).otherwise(F.col("shape"))
    )
