"""What to review first: scores per method, effort curves, queues and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.operators.rules.invoices import line_totals
from tallyhound.operators.rules.volume import UNEXPLAINED

# Rules of each method, of the invoices, and the review budgets.
NAIVE_RULES = ["litros_mayor_a_tanque", "odometro_disminuye", "salto_historial_vehiculo", "fraccionamiento_diario",
               "rendimiento_bajo_odometro", "carga_lejos_de_base", "cruce_por_dominio_y_dia", "odometro_sin_avance"]
CONTEXT_RULES = ["exceso_sin_antecedente", "retroceso_con_contexto", "salto_con_contexto", "fraccionamiento_sin_recorrido",
                 "rendimiento_bajo_gps", "carga_vehiculo_inactivo", "carga_lejos_del_gps", "carga_sin_registro",
                 "carga_de_registro_anulado", "desacuerdo_de_litros", "supera_autorizado_con_tolerancia",
                 "sin_avance_sin_excepcion"]
INVOICE_RULES = ["factura_no_concilia", "pdf_no_concilia", "linea_sin_consumo", "linea_duplicada", "sobreprecio",
                 "precio_de_surtidor", "producto_no_combustible"]
BUDGETS = [25, 50, 100, 200]
METHODS = ["Reglas ingenuas", "Reglas con contexto", "Isolation Forest", "Modelo supervisado", "Combinado"]


def method_scores(universe: DataFrame, alerts: DataFrame, rarity: DataFrame, probability: DataFrame) -> DataFrame:
    """Long table ``method, record_id, score``; ``rarity`` and ``probability`` have ``record_id, score``."""
    flags = alerts.groupBy("record_id").agg(
        F.max(F.col("rule").isin(NAIVE_RULES)).alias("naive"), F.max(F.col("rule").isin(CONTEXT_RULES)).alias("context"))
    wide = (
        universe.select("record_id").join(flags, "record_id", "left")
        .join(rarity.select("record_id", F.col("score").alias("rarity")), "record_id", "left")
        .join(probability.select("record_id", F.col("score").alias("probability")), "record_id", "left")
    )
    as_number = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    values = [as_number("naive"), as_number("context"), F.col("rarity"), F.col("probability"),
              as_number("context") + F.col("probability")]
    items = F.array(*[F.struct(F.lit(m).alias("method"), v.alias("score")) for m, v in zip(METHODS, values)])
    return wide.select("record_id", F.explode(items).alias("s")).select("s.method", "record_id", "s.score")


def explained_records(alerts: DataFrame) -> DataFrame:
    """Records whose alerts with a cause are all explained by a recording error."""
    return alerts.filter(F.col("probable_cause").isNotNull()).groupBy("record_id").agg(
        F.max(F.col("probable_cause") == UNEXPLAINED).alias("__open")).filter(~F.col("__open")).select("record_id")


def documented_records(alerts: DataFrame) -> DataFrame:
    return alerts.filter("documented").select("record_id").distinct()


def top_ranked(scores: DataFrame, limit: int, explained: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` records of every method: explained ones last, higher score first, ties by id.

    The limit is the feature, so each method keeps ``limit`` rows per task before they meet (the window
    with a rank filter is planned as a group limit). Adds ``place``.
    """
    rows = scores
    if explained is not None:
        known = explained.select("record_id").distinct().withColumn("__known", F.lit(True))
        rows = rows.join(known, "record_id", "left")
    else:
        rows = rows.withColumn("__known", F.lit(None).cast("boolean"))
    order = Window.partitionBy("method").orderBy(
        F.coalesce("__known", F.lit(False)).asc(), F.col("score").desc_nulls_last(), F.col("record_id").asc())
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("__known")


def effort_curve(scores: DataFrame, anomalous: DataFrame, benign: DataFrame | None, limit: int,
                 explained: DataFrame | None = None) -> DataFrame:
    """After each reviewed record of each method, up to ``limit``: found, recall, precision, benign reviewed."""
    truth = anomalous.select("record_id").distinct()
    total = truth.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = top_ranked(scores, limit, explained).join(truth.withColumn("__hit", F.lit(1)), "record_id", "left")
    if benign is not None:
        top = top.join(benign.select("record_id").distinct().withColumn("__ok", F.lit(1)), "record_id", "left")
    else:
        top = top.withColumn("__ok", F.lit(None).cast("int"))
    w = Window.partitionBy("method").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    found = F.sum(F.coalesce("__hit", F.lit(0))).over(w)
    return top.select(
        "method", F.col("place").alias("reviewed"), found.alias("found"), F.try_divide(found, total).alias("recall"),
        (found / F.col("place")).alias("precision"), F.sum(F.coalesce("__ok", F.lit(0))).over(w).alias("benign_reviewed"))


def at_budgets(curve: DataFrame, budgets: list[int] | None = None) -> DataFrame:
    return curve.filter(F.col("reviewed").isin(budgets or BUDGETS))


def recall_by_type(scores: DataFrame, truth: DataFrame, budget: int, explained: DataFrame | None = None) -> DataFrame:
    """Share of each anomaly type that each method finds within ``budget`` reviews."""
    kinds = truth.select("record_id", "anomaly_type").distinct()
    sizes = kinds.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("real"))
    top = top_ranked(scores, budget, explained)
    found = top.join(kinds, "record_id").groupBy("method", "anomaly_type").agg(F.count(F.lit(1)).alias("found"))
    methods = scores.select("method").distinct()
    grid = sizes.withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS]))).join(methods, "method", "left_semi")
    return grid.join(found, ["method", "anomaly_type"], "left").select(
        "method", "anomaly_type", "real", F.coalesce("found", F.lit(0)).alias("found"),
        (F.coalesce("found", F.lit(0)) / F.col("real")).alias("recall"))


def reasons(features: DataFrame) -> Column:
    """Spelled-out reasons of a refuel from its features; only the features present are used."""
    have = set(features.columns)
    c = F.col
    pct = lambda name: F.round(c(name) * 100).cast("long")
    km = lambda name: F.round(c(name)).cast("long")
    no_track = (c("no_track") == 1) if "no_track" in have else F.lit(True)
    parts = [
        ("tank_ratio", c("tank_ratio") > 1, F.format_string("%d%% of the tank", pct("tank_ratio"))),
        ("litres_vs_usual", c("litres_vs_usual") > 2, F.format_string("%.1f times its usual refuel", c("litres_vs_usual"))),
        ("day_tanks", (c("day_refuels") >= 2) & (c("day_tanks") > 1.05),
         F.format_string("%d refuels that day (%.1f tanks)", c("day_refuels").cast("long"), c("day_tanks"))),
        ("relative_rate", c("relative_rate") < 0.32, F.format_string("%d%% of its usual distance per litre", pct("relative_rate"))),
        ("back_km", c("back_km") > 0, F.format_string("odometer goes back %d km", km("back_km"))),
        ("inactive", c("inactive") == 1, F.lit("vehicle out of service")),
        ("no_request", c("no_request") == 1, F.lit("no request")),
        ("litres_vs_authorised", c("litres_vs_authorised") > 1.05,
         F.format_string("%d%% of what was authorised", pct("litres_vs_authorised"))),
        ("excess_km", c("excess_km") > 1000, F.format_string("%d km more than usual", km("excess_km"))),
        ("track_distance", c("track_distance") > 50, F.format_string("%d km from the day's track", km("track_distance"))),
        ("zone_distance", (c("zone_distance") > 50) & no_track, F.format_string("%d km from its usual zone", km("zone_distance"))),
    ]
    told = [F.when(condition, text) for name, condition, text in parts if name in have]
    return F.concat_ws("; ", *told)


def review_queue(scores: DataFrame, method: str, refuels: DataFrame, features: DataFrame, alerts: DataFrame,
                 size: int = 50) -> DataFrame:
    """The first ``size`` refuels to review with reasons, rules, cause and outcome; explained or documented ones last."""
    later = explained_records(alerts)
    if "documented" in alerts.columns:
        later = later.unionByName(documented_records(alerts))
    top = top_ranked(scores.filter(F.col("method") == method), size, later)
    own = alerts.join(top.select("record_id"), "record_id", "left_semi")
    cause = F.min(F.when(F.col("probable_cause") != UNEXPLAINED, F.col("probable_cause")))
    outcome = F.min(F.when(F.col("documented"), F.col("outcome"))) if "documented" in alerts.columns else F.lit(None)
    rules = F.array_join(F.sort_array(F.collect_set(F.when(F.col("rule").isin(CONTEXT_RULES), F.col("rule")))), ", ")
    told = own.groupBy("record_id").agg(rules.alias("rules"), cause.alias("probable_cause"), outcome.alias("outcome"))
    about = features.withColumn("reasons", reasons(features)).select(F.col("id").alias("record_id"), "reasons")
    fields = refuels.select(F.col("id").alias("record_id"), "vehicle_id", "date", "station", "litres", "odometer")
    blank = lambda c: F.coalesce(F.replace(F.col(c), F.lit("_"), F.lit(" ")), F.lit(""))
    return top.join(fields, "record_id").join(about, "record_id", "left").join(told, "record_id", "left").select(
        "record_id", "vehicle_id", "date", "station", "litres", "odometer", "reasons",
        F.coalesce("rules", F.lit("")).alias("rules"), blank("probable_cause").alias("probable_cause"),
        blank("outcome").alias("outcome"), F.col("place").alias("priority"), F.bround("score", 3).alias("score"))


def vehicles_to_review(scores: DataFrame, method: str, refuels: DataFrame, size: int = 100,
                       explained: DataFrame | None = None) -> DataFrame:
    """Vehicles by how many of the first ``size`` refuels are theirs."""
    top = top_ranked(scores.filter(F.col("method") == method), size, explained)
    owned = top.join(refuels.select(F.col("id").alias("record_id"), "vehicle_id"), "record_id")
    return owned.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("suspicious"), F.max("score").alias("top_score")
    ).filter(F.col("vehicle_id").isNotNull())


def invoices_to_review(invoices: DataFrame, lines: DataFrame, alerts: DataFrame) -> DataFrame:
    """Invoices with findings: how many, which rules, and the amount at stake (flagged lines plus header gap)."""
    found = alerts.filter(F.col("rule").isin(INVOICE_RULES)).select("record_id", "rule")
    line = lines.groupBy(F.col("line").cast("string").alias("record_id")).agg(
        F.min(F.col("number").cast("string")).alias("__number"), F.min("amount").alias("amount"))
    placed = found.join(line, "record_id", "left").withColumn("number", F.coalesce("__number", "record_id"))
    summed = placed.groupBy("number").agg(
        F.count(F.lit(1)).alias("findings"), F.array_join(F.sort_array(F.collect_set("rule")), "; ").alias("rules"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("__lines"),
        F.max(F.col("rule") == "factura_no_concilia").alias("__header"))
    totals = line_totals(lines).withColumn("number", F.col("number").cast("string"))
    heads = invoices.withColumn("number", F.col("number").cast("string")).join(totals, "number", "left")
    gap = F.coalesce(F.abs(F.round(F.col("total") - F.col("lines_total"), 2)), F.lit(0.0))
    at_stake = F.round(F.col("__lines") + F.when(F.col("__header"), gap).otherwise(0.0), 2)
    return heads.join(summed, "number").select("number", "supplier", "period", "total", "findings", "rules",
                                               at_stake.alias("at_stake"))


def out_of_service_refuels(refuels: DataFrame, vehicles: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Refuels of vehicles out of service; ``without_request`` marks the gravest, to be listed first."""
    idle = vehicles.filter((F.col("state") != "EN SERVICIO") & F.col("state_date").isNotNull()).select(
        "vehicle_id", F.col("plate").alias("register_plate"), "state", "vehicle_type",
        F.col("state_date").cast("date").alias("since"))
    rows = refuels.join(idle, "vehicle_id").filter(F.col("date") >= F.col("since"))
    if pairs is None:
        rows = rows.withColumn("without_request", F.lit(False))
        why = F.lit("vehicle out of service: may not refuel")
    else:
        asked = pairs.select(F.col("refuel_id").alias("id"), F.lit(True).alias("__asked"))
        rows = rows.join(asked, "id", "left").withColumn("without_request", F.col("__asked").isNull())
        why = F.when(F.col("without_request"), "no request: the card was used outside the system").otherwise(
            "with a request: the state changed after it")
    return rows.select("id", "vehicle_id", F.col("register_plate").alias("plate"), "state", "vehicle_type", "date", "station",
                       "litres", F.datediff("date", "since").alias("days_since"), "without_request", why.alias("reason"))


def immediate_withdrawals(vehicles: DataFrame, devices: DataFrame, days: int = 7) -> DataFrame:
    """Devices to withdraw now: still transmitting on written-off vehicles, then those with an unreadable date."""
    from tallyhound.operators.rules.devices import last_contact, written_off_devices
    from tallyhound.operators.rules.links import DEPOT_GROUP

    latest = devices.select(last_contact(devices).alias("at")).agg(F.max("at")).scalar()
    silent = F.unix_seconds(latest) - F.unix_seconds("contact_at")
    rows = written_off_devices(vehicles, devices).filter(F.col("contact_at").isNull() | (silent <= days * 86_400))
    facts = vehicles.select(F.col("vehicle_id").alias("linked_vehicle"), "state", "vehicle_type")
    unreadable = F.col("contact_at").isNull()
    return rows.join(facts, "linked_vehicle").select(
        "alias", F.col("linked_vehicle").alias("vehicle_id"), "plate", "state", "vehicle_type", "device_group", "contact_at",
        F.floor(silent / 86_400).alias("silent_days"), (F.col("device_group") == DEPOT_GROUP).alias("group_out_of_date"),
        unreadable.alias("unreadable_date"),
        F.when(unreadable, "last contact unreadable: check by hand").otherwise("written-off vehicle, device transmitting")
        .alias("reason"))
