"""Feature, model and whole-run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.operators import features, models, ranking
from tallyhound.operators.settle import settle
from tallyhound.plans import derive, queries_ledger, queries_matching  # noqa: F401  their SQL is used below
from tallyhound.plans.queries_links import refuels, requests
from tallyhound.plans.queries_sequence import DAY_VIEWS, DAYS, EXEMPT
from tallyhound.plans.queries_sources import data
from tallyhound.plans.registry import BODIES, ORACLES, Inputs, query
from tallyhound.plans.run import run_rules

_DIMS = [f"e{i}" for i in range(64)]


def embedded(x: Inputs):
    """The 64 dimensions of the embeddings as features, one label against the rest."""
    return x.table("embeddings").select(
        F.col("vec_id").cast("string").alias("id"), (F.col("label") == 0).alias("label"), (F.col("vec_id") % 4).alias("run"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_DIMS)])


@query("ml01_features", ["refuel", "vehicle"])
def _(x: Inputs):
    return features.build_features(x.view("vehicle"), refuels(x), x.view("station"), x.view("daily_track"), requests(x), x.view("exemption"))


@query("ml01_base_features", ["refuel", "vehicle"], """
WITH m AS (SELECT r.id, r.vehicle_id, litres, tank_capacity, median(litres) OVER (PARTITION BY r.vehicle_id) AS usual, state, state_date,
                  cast(date as date) AS d FROM refuel r LEFT JOIN vehicle v ON v.vehicle_id = r.vehicle_id)
SELECT id, round(litres / tank_capacity, 6) AS tank_ratio, CASE WHEN vehicle_id IS NOT NULL THEN round(litres / usual, 6) END AS litres_vs_usual,
       CASE WHEN state <> 'EN SERVICIO' AND d >= state_date THEN 1.0 ELSE 0.0 END::double AS inactive FROM m""")
def _(x: Inputs):
    nobody = refuels(x).select("id").limit(0)
    out = features.build_features(x.view("vehicle"), refuels(x), excluded=nobody)
    return out.select("id", F.round("tank_ratio", 6).alias("tank_ratio"), F.round("litres_vs_usual", 6).alias("litres_vs_usual"), "inactive")


@query("ml02_isolation_forest")
def _(x: Inputs):
    return models.isolation_forest(embedded(x), _DIMS)


@query("ml03_supervised_forest")
def _(x: Inputs):
    rows = embedded(x)
    model = models.train_forest(rows.filter("run < 2"), _DIMS, trees=40)
    return models.probabilities(model, rows.filter("run >= 2"))


@query("ml04_logistic_regression")
def _(x: Inputs):
    rows = embedded(x)
    return models.probabilities(models.train_logistic(rows.filter("run < 2"), _DIMS), rows.filter("run >= 2"))


@query("ml05_feature_importance")
def _(x: Inputs):
    model = models.train_forest(embedded(x), _DIMS, trees=40)
    return x.spark.createDataFrame(models.importances(model), "feature string, importance double")


@query("ml06_permuted_column", [], "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderkey) AS keys FROM orders")
def _(x: Inputs):
    dealt = models.permuted(x.table("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")
    return dealt.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"),
                     F.count_distinct("o_orderkey").alias("keys"))


@query("ml06_permutation_importance")
def _(x: Inputs):
    rows = embedded(x)
    model = models.train_forest(rows.filter("run < 2"), _DIMS)
    return x.spark.createDataFrame(models.permutation_importance(model, rows.filter("run >= 2")), "feature string, loss double")


@query("ml07_methods_over_runs")
def _(x: Inputs):
    rows = embedded(x)
    return models.evaluate_methods(rows.filter("run < 2"), rows.filter("run >= 2"), _DIMS, _DIMS[:4], trees=20)


@query("ml08_method_scores", ["refuel"], """
SELECT 'Reglas ingenuas' AS method, id AS record_id, CASE WHEN litres > 100 THEN 1.0 ELSE 0.0 END::double AS score FROM refuel
UNION ALL SELECT 'Reglas con contexto', id, 0.0 FROM refuel UNION ALL SELECT 'Isolation Forest', id, litres FROM refuel
UNION ALL SELECT 'Modelo supervisado', id, amount FROM refuel UNION ALL SELECT 'Combinado', id, amount FROM refuel""")
def _(x: Inputs):
    r = x.view("refuel").select(F.col("id").alias("record_id"), "litres", "amount")
    alerts = r.filter("litres > 100").select("record_id", F.lit("litros_mayor_a_tanque").alias("rule"))
    return ranking.method_scores(r, alerts, r.select("record_id", F.col("litres").alias("score")), r.select("record_id", F.col("amount").alias("score")))


@query("ml09_ranked_refuels", ["refuel"], """
SELECT record_id, cast(place as int) AS place FROM (SELECT id AS record_id, row_number() OVER (ORDER BY product = 'DIESEL', litres DESC, id) AS place FROM refuel)
WHERE place <= 500""")
def _(x: Inputs):
    r = x.view("refuel")
    scores = r.select(F.lit("litres").alias("method"), F.col("id").alias("record_id"), F.col("litres").alias("score"))
    known = r.filter("product = 'DIESEL'").select(F.col("id").alias("record_id"))
    return ranking.top_ranked(scores, 500, known).select("record_id", "place")


@query("ml11_reasons", ["refuel", "vehicle"], """
SELECT r.id, concat_ws('; ', CASE WHEN litres / tank_capacity > 1 THEN cast(cast(round(litres / tank_capacity * 100) as bigint) as varchar) || '% of the tank' END,
       CASE WHEN state <> 'EN SERVICIO' THEN 'vehicle out of service' END) AS reasons
FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id""")
def _(x: Inputs):
    rows = x.view("refuel").join(x.view("vehicle").select("vehicle_id", "tank_capacity", "state"), "vehicle_id").withColumns({
        "tank_ratio": F.col("litres") / F.col("tank_capacity"), "inactive": (F.col("state") != "EN SERVICIO").cast("double")})
    rows = rows.select("id", "tank_ratio", "inactive")
    return rows.select("id", ranking.reasons(rows).alias("reasons"))


@query("ml10_review_queue")
def _(x: Inputs):
    tables = data(x)
    found = run_rules({k: tables[k] for k in ("vehicle", "refuel")})
    alerts = found.alerts.withColumns({"probable_cause": F.lit(None).cast("string")}) if "probable_cause" not in found.alerts.columns else found.alerts
    alerts = settle(alerts)
    table = settle(features.build_features(tables["vehicle"], found.refuels, excluded=found.excluded))
    names = [c for c in table.columns if c != "id"]
    rarity = models.isolation_forest(table, names, trees=50).select(F.col("id").alias("record_id"), "score")
    scores = ranking.method_scores(table.select(F.col("id").alias("record_id")), alerts, rarity, rarity)
    return ranking.review_queue(scores, "Combinado", found.refuels, table, alerts, 100)


@query("ml14_rules_against_isolation_forest")
def _(x: Inputs):
    rows = embedded(x).withColumnRenamed("id", "record_id")
    rarity = models.isolation_forest(rows, _DIMS, "record_id", trees=50)
    return models.compare_with_rules(rows, rows.filter("e0 > 0.1"), rarity, rows.filter("label"))


# SQL of the single rules, each with what the whole run gives it in place of the plain views.
_KEPT = {"refuel": "SELECT * FROM kept_refuel"}
_SPENT = {"spend": "SELECT id, contract, cast(date as date) AS date, amount FROM every_refuel"}
_BILLED = {"spend": "SELECT id, contract, cast(date as date) AS date, amount FROM every_refuel WHERE id NOT IN (SELECT record_id FROM copy)"}
_LINES = {"part": "SELECT id AS p_partkey, unit_price AS p_retailprice FROM every_refuel",
          "invoice_line": f"SELECT * REPLACE ('R' || lpad(cast(refuel_ref as varchar), 12, '0') AS refuel_ref) FROM ({derive.oracle(derive.VIEWS['invoice_line'])})"}
_OPEN = {"refuel": "SELECT * FROM every_refuel WHERE id NOT IN (SELECT record_id FROM copy)"}
RULE_SQL: dict[str, dict[str, str]] = {
    **dict.fromkeys([
        "r01_exact_duplicates", "r02_missing_mandatory", "r03n_unknown_plate", "r03n_unknown_plate_normalised", "r03c_unlinked_refuel",
        "r03c_unlinked_request", "r03c_unlinked_device", "r04n_over_tank", "r04c_over_tank_with_history", "r11_inactive_vehicle",
        "r12n_far_from_zone", "r12c_far_from_track", "r14a_invoice_header_vs_lines", "r14b_document_vs_debt", "r16n_written_off_with_device",
        "r16c_active_device", "r18n_fallback_refuels", "r18c_double_charges"], {}),
    **dict.fromkeys([
        "r05n_odometer_decreases", "r05c_decrease_in_context", "r06n_jump_fixed", "r06h_jump_by_history", "r06c_jump_in_context",
        "r09c_split_tank_without_distance", "r10s_low_rate_by_type", "r13n_naive_match", "r13c_context_match", "r17n_no_advance", "r17s_small_advance", "r17c_no_advance_without_exemption"], _KEPT),
    "r09n_split_tank": _KEPT | {"request": f"SELECT * FROM ({derive.oracle(derive.VIEWS['request'])}) WHERE false"},  # days of the network alone
    "r09s_refuels_close_in_time": _OPEN, "r14n_month_reconciliation": _BILLED, "r14c_line_irregularities": _LINES,
    "r15n_spend_over_cap": _SPENT, "r15c_quota_irregularities": _SPENT,
}
# Low rates of days without a refuel that another rule accounts for, whose reading is exempt or which stood still.
_ACCOUNTED = ["r04c_over_tank_with_history", "r11_inactive_vehicle", "r09c_split_tank_without_distance", "r12c_far_from_track", "r17c_no_advance_without_exemption"]
_LOW = f"""WITH {DAYS} SELECT id AS record_id, 'CONSUMO_ATIPICO' AS anomaly_type, '{{rule}}' AS rule FROM mem
WHERE litres >= tank_capacity * 0.3 AND {{rate}} < 0.32
  AND NOT EXISTS (SELECT 1 FROM refuel WHERE refuel.vehicle_id = mem.vehicle_id AND cast(refuel.date as date) = mem.date
                  AND ({EXEMPT} OR id IN (SELECT record_id FROM accounted)))"""


def _all_rules() -> str:
    part = {n: f"SELECT cast(record_id as varchar) AS record_id, anomaly_type, rule FROM ({derive.with_views(*BODIES[n], instead)})" for n, instead in RULE_SQL.items()}
    low = [f"SELECT * FROM ({derive.with_views([*DAY_VIEWS, 'exemption'], _LOW.format(rule=rule, rate=rate), _KEPT)})"
           for rule, rate in (("rendimiento_bajo_odometro", "orel"), ("rendimiento_bajo_gps", "coalesce(trel, orel)"))]
    return f"""WITH copy AS (SELECT record_id FROM ({ORACLES['r01_exact_duplicates']})),
every_refuel AS ({derive.oracle(derive.VIEWS['refuel'])}),
kept_refuel AS (SELECT * FROM every_refuel WHERE id NOT IN (SELECT record_id FROM copy UNION SELECT record_id FROM ({ORACLES['r18c_double_charges']}))),
accounted AS ({" UNION ".join(part[n] for n in _ACCOUNTED)}),
alerts AS ({" UNION ALL ".join([*part.values(), *low])})
SELECT rule, anomaly_type, count(*) AS alerts, count(DISTINCT record_id) AS records FROM alerts GROUP BY ALL"""


def all_data(x: Inputs):
    """All tables of the fleet, invoice lines that name their refuels."""
    tables = data(x)
    return tables | {"invoice_line": tables["invoice_line"].withColumn("refuel_ref", F.concat(F.lit("R"), F.lpad(F.col("refuel_ref").cast("string"), 12, "0")))}


@query("r23_all_rules", [], _all_rules())
def _(x: Inputs):
    alerts = run_rules(all_data(x)).alerts
    return alerts.groupBy("rule", "anomaly_type").agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("record_id").alias("records"))
