"""Exploratory summaries of the fleet, its refuels and the coverage between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.bands import bounded_count, share
from tallyhound.functions.text import normalise_id
from tallyhound.operators.linkage import is_personal

# Completeness of a month.
COMPLETE_SHARE = 0.9
LAST_DAYS = 3


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each category; a missing one is ``Sin dato``."""
    label = F.coalesce(F.col(column).cast("string"), F.lit("Sin dato"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("n")).withColumn("pct", share(F.col("n"), total))


def fleet_coverage(vehicles: DataFrame, devices: DataFrame) -> DataFrame:
    """Vehicles by state and whether any device carries their plate."""
    plates = devices.select(normalise_id(F.col("plate")).alias("__p")).filter(F.col("__p").isNotNull()).distinct().withColumn(
        "__d", F.lit(True))
    rows = vehicles.withColumn("__p", normalise_id(F.col("plate"))).join(plates, "__p", "left")
    return rows.groupBy("state", F.when(F.col("__d"), "Con").otherwise("Sin").alias("device")).agg(
        F.count(F.lit(1)).alias("n"))


def litres_by_type(refuels: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Refuels, total and median litres per vehicle type."""
    from tallyhound.operators.skew import group_quantiles

    types = vehicles.groupBy("vehicle_id").agg(F.min("vehicle_type").alias("vehicle_type"))
    typed = refuels.join(types, "vehicle_id", "left").select(F.coalesce("vehicle_type", F.lit("Sin dato")).alias("vehicle_type"), "litres")
    sums = typed.groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("refuels"), F.round(F.sum("litres"), 2).alias("litres_total"))
    return sums.join(group_quantiles(typed, ["vehicle_type"], "litres", {"litres_median": 0.5}, hot_rows=0), "vehicle_type", "left")


def percentiles(df: DataFrame, columns: list[str], points: dict[str, float]) -> DataFrame:
    """Percentiles of several columns in long form; exact, from counts per distinct value."""
    from tallyhound.operators.skew import group_quantiles

    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(items).alias("i")).select("i.variable", "i.x")
    wide = group_quantiles(long, ["variable"], "x", points, hot_rows=0)
    return wide.select("variable", F.explode(F.array(*[
        F.struct(F.lit(p).alias("percentile"), F.col(p).alias("value")) for p in points])).alias("i")).select(
        "variable", "i.percentile", "i.value")


def time_profile(refuels: DataFrame) -> DataFrame:
    """Refuels and litres per month, weekday (1 is Monday) and hour, from one aggregation by day and hour."""
    base = refuels.groupBy(F.col("date"), F.hour("instant").alias("hour"), F.col("time").isNotNull().alias("timed")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("litres").alias("l"))
    keys = F.array(
        F.struct(F.lit("month").alias("section"), F.date_format("date", "yyyy-MM").alias("key")),
        F.struct(F.lit("weekday").alias("section"), (F.weekday("date") + 1).cast("string").alias("key")),
        F.struct(F.lit("hour").alias("section"), F.when(F.col("timed"), F.col("hour").cast("string")).alias("key")))
    long = base.select(F.explode(keys).alias("k"), "n", "l").filter(F.col("k.key").isNotNull())
    return long.groupBy("k.section", "k.key").agg(F.sum("n").alias("refuels"), F.round(F.sum("l"), 2).alias("litres"))


def link_quality(refuels: DataFrame, vehicles: DataFrame) -> DataFrame:
    """How plates match the register: personal card, exact, only once normalised, or not at all."""
    exact = vehicles.select("plate").distinct().withColumn("__e", F.lit(True))
    norm = vehicles.select(normalise_id(F.col("plate")).alias("__n")).distinct().withColumn("__m", F.lit(True))
    rows = refuels.withColumns({"__personal": is_personal(refuels), "__n": normalise_id(F.col("plate"))})
    rows = rows.groupBy("plate", "__n", "__personal").agg(F.count(F.lit(1)).alias("__c")).join(exact, "plate", "left").join(
        norm, "__n", "left")
    kind = F.when(F.col("__personal"), "Tarjeta personal").when(F.col("__e"), "Coincide exactamente").when(
        F.col("__m"), "Coincide solo normalizado").otherwise("Sin vínculo con la flota")
    total = refuels.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.groupBy(kind.alias("match")).agg(F.sum("__c").alias("n")).withColumn("pct", share(F.col("n"), total))


def leg_coverage(refuels: DataFrame, vehicles: DataFrame, pairs: DataFrame | None, tracks: DataFrame | None,
                 lines: DataFrame | None) -> DataFrame:
    """Share of refuels with a request, with a track that day and with an invoice line."""
    rows = refuels.select("id", "vehicle_id", "date")
    legs = []
    if pairs is not None:
        asked = pairs.select(F.col("refuel_id").alias("id"), F.lit(True).alias("__asked")).distinct()
        rows = rows.join(asked, "id", "left")
        legs.append(("Pedido → carga", "__asked"))
    if tracks is not None:
        plates = vehicles.groupBy("vehicle_id").agg(F.min(normalise_id(F.col("plate"))).alias("__p"))
        days = tracks.select(normalise_id(F.col("plate")).alias("__p"), F.col("date").cast("date").alias("date")).distinct()
        rows = rows.join(plates, "vehicle_id", "left").join(days.withColumn("__tracked", F.lit(True)), ["__p", "date"], "left")
        legs.append(("Carga → GPS diario", "__tracked"))
    if lines is not None:
        billed = lines.select(F.col("refuel_ref").cast("string").alias("id")).distinct().withColumn("__billed", F.lit(True))
        rows = rows.join(billed, "id", "left")
        legs.append(("Carga → línea facturada", "__billed"))
    sums = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count(flag).alias(flag) for _, flag in legs])
    return sums.select("total", F.explode(F.array(*[
        F.struct(F.lit(name).alias("leg"), F.col(flag).alias("covered")) for name, flag in legs])).alias("i")).select(
        "i.leg", "i.covered", "total", share(F.col("i.covered"), F.col("total")).alias("pct"))


def complete_months(dates: DataFrame, column: str = "date") -> DataFrame:
    """Months covered from start to end: data on 90 % of the days and within the last three."""
    days = dates.select(F.col(column).cast("date").alias("d")).filter(F.col("d").isNotNull()).distinct()
    months = days.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("days"), F.max(F.dayofmonth("d")).alias("last"), F.max(F.dayofmonth(F.last_day("d"))).alias("length"))
    return months.filter((F.col("days") >= F.col("length") * COMPLETE_SHARE) & (F.col("last") > F.col("length") - LAST_DAYS)).select(
        "month", "days")


def device_state_table(vehicles: DataFrame, devices: DataFrame, days: int = 7) -> DataFrame:
    """Vehicles per state by the worst category of their devices; counts bounded for publishing."""
    names = ["sin_dispositivo", "deposito_sin_transmitir", "deposito_transmite", "otro_grupo_sin_transmitir",
             "otro_grupo_transmite"]
    at = F.col("last_contact").try_cast("timestamp")
    latest = devices.select(at.alias("at")).agg(F.max("at")).scalar()
    sends = F.coalesce(F.unix_seconds(latest) - F.unix_seconds(at) <= days * 86_400, F.lit(False))
    depot = F.coalesce(F.upper("device_group").rlike("BAJA|REEMPLAZ|DEPOSITO|DEPÓSITO"), F.lit(False))
    rank = F.when(depot & ~sends, 1).when(depot, 2).when(~sends, 3).otherwise(4)
    worst = devices.select(normalise_id(F.col("plate")).alias("__p"), rank.alias("r")).filter(F.col("__p").isNotNull()).groupBy(
        "__p").agg(F.max("r").alias("r"))
    rows = vehicles.withColumn("__p", normalise_id(F.col("plate"))).join(worst, "__p", "left").withColumn(
        "r", F.coalesce("r", F.lit(0)))
    state = F.coalesce(F.upper(F.trim("state")), F.lit("SIN ESTADO"))
    counts = rows.groupBy(state.alias("state")).agg(
        F.count(F.lit(1)).alias("__all"), *[F.count_if(F.col("r") == i).alias(n) for i, n in enumerate(names)])
    return counts.select("state", bounded_count(F.col("__all")).alias("vehicles"), *[bounded_count(F.col(n)).alias(n) for n in names])


def table_stats(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells of a table."""
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(nulls).alias("nulls")).withColumn("columns", F.lit(len(df.columns)))


def column_quality(df: DataFrame, source: str) -> DataFrame:
    """Completeness and uniqueness of every column of a source."""
    from tallyhound.operators.profile import value_counts

    present = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    sums = value_counts(df).groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(present).alias("__p"), F.count("value").alias("distinct_values"))
    return sums.select(F.lit(source).alias("source"), "column", "rows", share(F.col("__p"), F.col("rows")).alias("complete_pct"),
                       "distinct_values", share(F.col("distinct_values"), F.col("rows")).alias("unique_pct"))


def prevalence(truth: DataFrame, benign: DataFrame, universe: DataFrame) -> DataFrame:
    """Anomalies and benign look-alikes, and the share of records with an anomaly."""
    total = universe.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = truth.select("record_id", F.lit("anomaly").alias("kind")).unionByName(benign.select("record_id", F.lit("benign").alias("kind")))
    sums = rows.groupBy("kind", "record_id").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(
        F.sum("n").alias("cases"), F.count(F.lit(1)).alias("records"))
    return sums.withColumn("prevalence_pct", share(F.col("records"), total))


def compare_percentiles(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Approved percentiles next to those of the current data and their difference."""
    return reference.select("variable", "percentile", F.col("value").alias("approved")).join(
        current.select("variable", "percentile", F.round("value", 3).alias("current")), ["variable", "percentile"]
    ).withColumn("difference", F.round(F.col("current") - F.col("approved"), 3))


def alerts_by_month(alerts: DataFrame, dated: DataFrame) -> DataFrame:
    """Alerts per rule and month, counting each record once; ``dated`` has ``record_id, date``."""
    rows = alerts.select("rule", "record_id").distinct().join(dated, "record_id", "left")
    return rows.groupBy("rule", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("records"))


# Days of the week from Sunday on.
WEEKDAYS = ["Domingo", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado"]


def enriched_refuels(refuels: DataFrame, vehicles: DataFrame, steps: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Every refuel with its vehicle, its time and what is known of its stretch.

    Adds type, tank and fuel of the vehicle, ``tank_share``, ``month``, ``weekday``, ``hour``; with ``steps`` (see
    ``odometer_sequence``) the ``km`` since the reading before, null where it is 0 or there is none; with ``days`` (see
    ``daily_refuels``) ``refuels_that_day`` and ``km_per_litre`` by track, else by odometer, and its ratio to the vehicle's own.
    """
    facts = vehicles.groupBy("vehicle_id").agg(*[F.min(c).alias(c) for c in ("vehicle_type", "tank_capacity", "fuel") if c in vehicles.columns])
    rows = refuels.join(facts, "vehicle_id", "left")
    hour = F.substring("time", 1, 2).try_cast("int") if "time" in refuels.columns else F.lit(None).cast("int")
    rows = rows.withColumns({
        "tank_share": F.try_divide("litres", "tank_capacity"), "month": F.date_format("date", "yyyy-MM"),
        "weekday": F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), F.dayofweek("date") - 1), "hour": hour})
    if steps is not None:
        rows = rows.join(steps.select("id", F.nullif(F.col("km"), F.lit(0.0)).alias("km")), "id", "left")
    if days is not None:
        rows = rows.join(days.select("vehicle_id", "date", F.col("report_refuels").alias("refuels_that_day"),
                                     F.coalesce("track_rate", "odometer_rate").alias("km_per_litre"),
                                     F.coalesce("track_relative", "odometer_relative").alias("relative_rate")), ["vehicle_id", "date"], "left")
    return rows


def correction_rate(defects: DataFrame) -> DataFrame:
    """Share of defects that normalising undoes, by type: ``defect_type, defects, corrected_pct``.

    ``defects`` has ``defect_type, injected_value, original_value``. Texts are compared as normalised identifiers, numbers by their digits; other types
    count as corrected. Two values without any sign left are not equal.
    """
    digits = lambda c: F.nullif(F.regexp_replace(c, r"\D", ""), F.lit(""))
    text = F.nullif(normalise_id(F.col("injected_value")), F.lit("")) == F.nullif(normalise_id(F.col("original_value")), F.lit(""))
    kind = F.col("defect_type")
    corrected = F.when(kind == "TEXT_NORMALIZATION", text).when(kind == "NUMERIC_FORMAT", digits("injected_value") == digits("original_value")).otherwise(True)
    sums = defects.groupBy("defect_type").agg(F.count(F.lit(1)).alias("defects"), F.count_if(F.coalesce(corrected, F.lit(False))).alias("__ok"))
    return sums.select("defect_type", "defects", share(F.col("__ok"), F.col("defects")).alias("corrected_pct"))
