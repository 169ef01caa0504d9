"""Cause, evaluation and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.operators import causes, evaluate, matching, ranking
from tallyhound.operators.rules import invoices, volume
from tallyhound.operators.settle import settle
from tallyhound.plans.queries_ledger import plain
from tallyhound.plans.queries_links import LINK_CTES, link_sql, refuels, requests
from tallyhound.plans.queries_matching import CONTEXT
from tallyhound.plans.registry import Inputs, query

_METRICS = """tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
       2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1"""


def rounded(df, *columns):
    keep = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, 6) for c in keep})


def _round_sql(sql: str, columns: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM ({sql})"


TRUTH = ["truth", "benign", "alert"]


@query("ev01_metrics_by_type", TRUTH, "WITH p AS (SELECT DISTINCT record_id, anomaly_type FROM alert)," + f"""
g AS (SELECT DISTINCT record_id, anomaly_type FROM truth),
c AS (SELECT coalesce(p.anomaly_type, g.anomaly_type) AS anomaly_type, count(g.record_id) AS real, count(p.record_id) AS alerts,
             count(*) FILTER (WHERE p.record_id IS NOT NULL AND g.record_id IS NOT NULL) AS tp
      FROM p FULL JOIN g ON p.record_id = g.record_id AND p.anomaly_type = g.anomaly_type GROUP BY 1),
d AS (SELECT *, alerts - tp AS fp, real - tp AS fn FROM c)
{_round_sql(f"SELECT *, {_METRICS} FROM d", ["precision", "recall", "f1"])}""")
def _(x: Inputs):
    return rounded(evaluate.by_type(x.view("alert"), x.view("truth")))


@query("ev02_metrics_by_rule", TRUTH, f"""
WITH p AS (SELECT DISTINCT rule, anomaly_type, record_id FROM alert),
g AS (SELECT DISTINCT r.rule, t.anomaly_type, t.record_id FROM truth t JOIN (SELECT DISTINCT rule, anomaly_type FROM p) r
      ON r.anomaly_type = t.anomaly_type AND (t.anomaly_type <> 'VALOR_NULO' OR r.rule = 'nulo_' || t.column_name)),
c AS (SELECT coalesce(p.rule, g.rule) AS rule, coalesce(p.anomaly_type, g.anomaly_type) AS anomaly_type,
             count(g.record_id) AS real, count(p.record_id) AS alerts,
             count(*) FILTER (WHERE p.record_id IS NOT NULL AND g.record_id IS NOT NULL) AS tp
      FROM p FULL JOIN g ON p.rule = g.rule AND p.record_id = g.record_id AND p.anomaly_type = g.anomaly_type GROUP BY 1, 2),
d AS (SELECT *, alerts - tp AS fp, real - tp AS fn FROM c)
{_round_sql(f"SELECT *, {_METRICS} FROM d", ["precision", "recall", "f1"])}""")
def _(x: Inputs):
    return rounded(evaluate.by_rule(x.view("alert"), x.view("truth")))


@query("ev03_errors", TRUTH, """
SELECT 'fp' AS side, record_id FROM alert WHERE anomaly_type = 'EXCESO_VOLUMETRICO'
       AND record_id NOT IN (SELECT record_id FROM truth WHERE anomaly_type = 'EXCESO_VOLUMETRICO')
UNION ALL SELECT 'fn', record_id FROM truth WHERE anomaly_type = 'EXCESO_VOLUMETRICO'
       AND record_id NOT IN (SELECT record_id FROM alert WHERE anomaly_type = 'EXCESO_VOLUMETRICO')""")
def _(x: Inputs):
    fp, fn = evaluate.errors(x.view("alert"), x.view("truth"), "EXCESO_VOLUMETRICO")
    return fp.select(F.lit("fp").alias("side"), "record_id").unionByName(fn.select(F.lit("fn").alias("side"), "record_id"))


@query("ev04_binary_metrics", TRUTH, f"""
WITH u AS (SELECT DISTINCT concat('R', lpad(cast(doc_id as varchar), 12, '0')) AS r FROM documents),
c AS (SELECT count(*) FILTER (WHERE r IN (SELECT record_id FROM truth)) AS real,
             count(*) FILTER (WHERE r IN (SELECT record_id FROM alert)) AS alerts,
             count(*) FILTER (WHERE r IN (SELECT record_id FROM truth) AND r IN (SELECT record_id FROM alert)) AS tp,
             count(*) AS n FROM u),
d AS (SELECT real, alerts, tp, alerts - tp AS fp, real - tp AS fn, n - real - alerts + tp AS tn FROM c)
{_round_sql(f"SELECT *, {_METRICS} FROM d", ["precision", "recall", "f1"])}""")
def _(x: Inputs):
    universe = x.table("documents").select(F.concat(F.lit("R"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("record_id"))
    return rounded(evaluate.binary(x.view("alert"), x.view("truth"), universe))


_UNION = """
a AS (SELECT DISTINCT record_id FROM alert WHERE rule IN ('salto_umbral_fijo', 'salto_con_contexto')),
t AS (SELECT DISTINCT record_id FROM truth WHERE anomaly_type = 'ODOMETRO_SALTO'),
f AS (SELECT record_id FROM a WHERE record_id NOT IN (SELECT record_id FROM t)),
c AS (SELECT (SELECT count(*) FROM t) AS real, (SELECT count(*) FROM a) AS alerts,
             (SELECT count(*) FROM a WHERE record_id IN (SELECT record_id FROM t)) AS tp,
             (SELECT count(*) FROM f WHERE record_id IN (SELECT record_id FROM benign)) AS fp_benign,
             (SELECT count(*) FROM f WHERE record_id IN (SELECT record_id FROM truth)) AS fp_other_anomaly,
             (SELECT count(*) FROM f WHERE record_id NOT IN (SELECT record_id FROM benign)
                     AND record_id NOT IN (SELECT record_id FROM truth)) AS fp_normal),
d AS (SELECT *, alerts - tp AS fp, real - tp AS fn FROM c)"""


@query("ev05_rule_union", TRUTH, f"""WITH {_UNION}
{_round_sql('''SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
               coalesce(2.0 * tp / nullif(alerts + real, 0), 0) AS f1 FROM d''', ["precision", "recall", "f1"])}""")
def _(x: Inputs):
    return rounded(evaluate.rule_union(x.view("alert"), x.view("truth"), x.view("benign"),
                                       ["salto_umbral_fijo", "salto_con_contexto"], ["ODOMETRO_SALTO"]))


@query("ev06_hypotheses", TRUTH, """
WITH s(hypothesis, step, rules) AS (VALUES ('H2c', 0, 'salto_umbral_fijo'), ('H2c', 1, 'salto_historial_vehiculo'),
       ('H2c', 2, 'salto_con_contexto'), ('H3b', 0, 'litros_mayor_a_tanque'), ('H3b', 1, 'exceso_sin_antecedente')),
k(hypothesis, kind) AS (VALUES ('H2c', 'ODOMETRO_SALTO'), ('H3b', 'EXCESO_VOLUMETRICO'), ('H3b', 'CAPACIDAD_MAL_REGISTRADA')),
a AS (SELECT DISTINCT hypothesis, step, record_id FROM s JOIN alert ON rule = rules),
t AS (SELECT DISTINCT hypothesis, record_id FROM k JOIN truth ON anomaly_type = kind),
m AS (SELECT s.hypothesis, s.step, s.rules,
        (SELECT count(*) FROM t WHERE t.hypothesis = s.hypothesis) AS real,
        (SELECT count(*) FROM a WHERE a.hypothesis = s.hypothesis AND a.step = s.step) AS alerts,
        (SELECT count(*) FROM a JOIN t USING (hypothesis, record_id) WHERE a.hypothesis = s.hypothesis AND a.step = s.step) AS tp,
        (SELECT count(*) FROM a ANTI JOIN t USING (hypothesis, record_id) WHERE a.hypothesis = s.hypothesis AND a.step = s.step
            AND record_id IN (SELECT record_id FROM benign)) AS fp_benign
      FROM s)
SELECT hypothesis, step, rules, real, alerts, tp, fp_benign, round(2.0 * tp / (alerts + real), 6) AS f1 FROM m WHERE real > 0""")
def _(x: Inputs):
    out = evaluate.contrast_hypotheses(x.view("alert"), x.view("truth"), x.view("benign"))
    return out.select("hypothesis", "step", "rules", "real", "alerts", "tp", "fp_benign", F.round("f1", 6).alias("f1"))


@query("ev06_verdicts", TRUTH, """
WITH a AS (SELECT rule, count(DISTINCT record_id) AS alerts FROM alert GROUP BY 1),
h AS (SELECT rule, count(DISTINCT t.record_id) AS tp FROM alert a JOIN truth t ON t.record_id = a.record_id
      AND t.anomaly_type = a.anomaly_type GROUP BY 1),
g AS (SELECT anomaly_type, count(DISTINCT record_id) AS real FROM truth GROUP BY 1),
f AS (SELECT a.rule, 2.0 * coalesce(tp, 0) / (alerts + real) AS f1 FROM a LEFT JOIN h USING (rule)
      JOIN g ON g.anomaly_type = CASE WHEN a.rule LIKE 'salto%' THEN 'ODOMETRO_SALTO' ELSE 'EXCESO_VOLUMETRICO' END
      WHERE a.rule NOT LIKE 'nulo%')
SELECT hypothesis, round(n.f1, 6) AS f1_naive, round(c.f1, 6) AS f1_context,
       CASE WHEN c.f1 - n.f1 >= 0.10 THEN 'Se sostiene' ELSE 'No se sostiene' END AS verdict
FROM (VALUES ('H2c', 'salto_umbral_fijo', 'salto_con_contexto'), ('H3b', 'litros_mayor_a_tanque', 'exceso_sin_antecedente')) v(hypothesis, x, y)
JOIN f n ON n.rule = v.x JOIN f c ON c.rule = v.y""")
def _(x: Inputs):
    # H4 and H5 also start from a rule of this table but have no case in the truth, so they are left out.
    out = evaluate.verdicts(evaluate.contrast_hypotheses(x.view("alert"), x.view("truth"), x.view("benign")))
    return out.select("hypothesis", F.round("f1_naive", 6).alias("f1_naive"), F.round("f1_context", 6).alias("f1_context"), "verdict")


_LABELLED = """
lab AS (SELECT l.doc_id, lang AS method, quality = 0 AS real, cast(n_chars % 97 as double) AS score
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def labelled(x: Inputs):
    return x.table("labels").join(x.table("documents").select("doc_id", "lang", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("record_id"), F.col("lang").alias("method"), (F.col("quality") == 0).alias("real"),
        (F.col("n_chars") % 97).cast("double").alias("score"))


_CONFUSION = """
c AS (SELECT method, count(*) FILTER (WHERE real AND score > 48) AS tp, count(*) FILTER (WHERE NOT real AND score > 48) AS fp,
             count(*) FILTER (WHERE real AND NOT score > 48) AS fn, count(*) FILTER (WHERE NOT real AND NOT score > 48) AS tn
      FROM lab GROUP BY 1),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
             coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"""


@query("ev07_confusion", [], f"WITH {_LABELLED}, {_CONFUSION} {_round_sql('SELECT * FROM m', ['precision', 'recall', 'f1'])}")
def _(x: Inputs):
    return rounded(evaluate.confusion(labelled(x).withColumn("predicted", F.col("score") > 48), ["method"]))


@query("ev07_average_precision", [], f"""WITH {_LABELLED},
g AS (SELECT method, score, count(*) AS n, count(*) FILTER (WHERE real) AS tp FROM lab GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct, sum(tp) OVER (PARTITION BY method) AS k FROM g
      WINDOW w AS (PARTITION BY method ORDER BY score DESC))
SELECT method, round(sum(tp / k * ct / cn), 6) AS average_precision FROM r WHERE k > 0 GROUP BY method""")
def _(x: Inputs):
    out = evaluate.ordering_quality(labelled(x), ["method"])
    return out.select("method", F.round("average_precision", 6).alias("average_precision"))


@query("ev07_precision_at_k", [], f"""WITH {_LABELLED},
o AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, md5(doc_id::varchar), doc_id) AS place,
             count(*) FILTER (real) OVER (PARTITION BY method) AS k FROM lab)
SELECT method, round(count(*) FILTER (real AND place <= k) / any_value(k), 6) AS precision_at_k, any_value(k) AS k FROM o WHERE k > 0 GROUP BY method""")
def _(x: Inputs):
    return evaluate.ordering_quality(labelled(x), ["method"]).select("method", F.round("precision_at_k", 6).alias("precision_at_k"), "k")


@query("ev08_over_runs", [], f"""WITH {_LABELLED}, {_CONFUSION},
s AS (SELECT 'all' AS method, cast(sum(tp) as bigint) AS tp, cast(sum(fp) as bigint) AS fp, cast(sum(fn) as bigint) AS fn,
             cast(sum(tn) as bigint) AS tn, avg(f1) AS f1_mean, stddev_pop(f1) AS f1_spread FROM m)
SELECT method, tp, fp, fn, tn, round(f1_mean, 6) AS f1_mean, round(f1_spread, 6) AS f1_spread,
       round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""")
def _(x: Inputs):
    runs = evaluate.confusion(labelled(x).withColumn("predicted", F.col("score") > 48), ["method"])
    out = evaluate.over_runs(runs.withColumn("method", F.lit("all")))
    return rounded(out.select("method", "tp", "fp", "fn", "tn", "f1_mean", "f1_spread", "f1"))


# Scores of three methods for every refuel of the report, per row.
_SCORES = """
sc AS (SELECT id AS record_id, 'Reglas ingenuas' AS method, CASE WHEN litres > 60 THEN 1.0 ELSE 0.0 END::double AS score FROM refuel
       UNION ALL SELECT id, 'Isolation Forest', litres FROM refuel
       UNION ALL SELECT id, 'Combinado', CASE WHEN origin = 'CONTINGENCIA' THEN 1000 ELSE 0 END + litres FROM refuel),
hit AS (SELECT id AS record_id, CASE WHEN amount % 2 < 1 THEN 'ODOMETRO_SALTO' ELSE 'EXCESO_VOLUMETRICO' END AS anomaly_type
        FROM refuel WHERE unit_price >= 107),
ok AS (SELECT id AS record_id FROM refuel WHERE unit_price < 101),
ex AS (SELECT id AS record_id FROM refuel WHERE product = 'DIESEL'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY record_id IN (SELECT record_id FROM ex), score DESC, record_id)
           AS place FROM sc)"""


def scores(x: Inputs):
    r = x.view("refuel")
    items = F.array(
        F.struct(F.lit("Reglas ingenuas").alias("method"), (F.col("litres") > 60).cast("double").alias("score")),
        F.struct(F.lit("Isolation Forest").alias("method"), F.col("litres").alias("score")),
        F.struct(F.lit("Combinado").alias("method"),
                 (F.when(F.col("origin") == "CONTINGENCIA", 1000.0).otherwise(0.0) + F.col("litres")).alias("score")))
    return r.select(F.col("id").alias("record_id"), F.explode(items).alias("s")).select("s.method", "record_id", "s.score")


def hits(x: Inputs):
    kind = F.when(F.col("amount") % 2 < 1, "ODOMETRO_SALTO").otherwise("EXCESO_VOLUMETRICO")
    return x.view("refuel").filter("unit_price >= 107").select(F.col("id").alias("record_id"), kind.alias("anomaly_type"))


def known(x: Inputs):
    return x.view("refuel").filter("product = 'DIESEL'").select(F.col("id").alias("record_id"))


@query("win12_effort_curve", ["refuel"], f"""WITH {_SCORES}
SELECT method, cast(place as int) AS reviewed, cast(sum((record_id IN (SELECT record_id FROM hit))::int) OVER w as bigint) AS found,
       round(sum((record_id IN (SELECT record_id FROM hit))::int) OVER w / (SELECT count(*) FROM hit), 6) AS recall,
       round(sum((record_id IN (SELECT record_id FROM hit))::int) OVER w / place, 6) AS precision,
       cast(sum((record_id IN (SELECT record_id FROM ok))::int) OVER w as bigint) AS benign_reviewed
FROM ranked WHERE place <= 200 WINDOW w AS (PARTITION BY method ORDER BY place)""")
def _(x: Inputs):
    benign = x.view("refuel").filter("unit_price < 101").select(F.col("id").alias("record_id"))
    return rounded(ranking.effort_curve(scores(x), hits(x), benign, 200, known(x)))


@query("ev10_at_budgets", ["refuel"], f"""WITH {_SCORES}
SELECT method, cast(b as int) AS reviewed, (SELECT count(*) FROM ranked r WHERE r.method = m.method AND place <= b
       AND record_id IN (SELECT record_id FROM hit)) AS found
FROM (SELECT DISTINCT method FROM sc) m, (VALUES (25), (50), (100), (200)) v(b)""")
def _(x: Inputs):
    curve = ranking.effort_curve(scores(x), hits(x), None, 200, known(x))
    return ranking.at_budgets(curve).select("method", "reviewed", "found")


@query("ev09_recall_by_type", ["refuel"], f"""WITH {_SCORES},
n AS (SELECT anomaly_type, count(*) AS real FROM hit GROUP BY 1),
f AS (SELECT method, anomaly_type, count(*) AS found FROM ranked JOIN hit USING (record_id) WHERE place <= 100 GROUP BY 1, 2)
SELECT m.method, n.anomaly_type, real, coalesce(found, 0) AS found, round(coalesce(found, 0) / real, 6) AS recall
FROM (SELECT DISTINCT method FROM sc) m CROSS JOIN n LEFT JOIN f ON f.method = m.method AND f.anomaly_type = n.anomaly_type""")
def _(x: Inputs):
    return rounded(ranking.recall_by_type(scores(x), hits(x), 100, known(x)))


@query("ag17_vehicles_to_review", ["refuel"], f"""WITH {_SCORES}
SELECT vehicle_id, count(*) AS suspicious, max(score) AS top_score FROM ranked JOIN refuel ON id = record_id
WHERE method = 'Combinado' AND place <= 100 AND vehicle_id IS NOT NULL GROUP BY vehicle_id""")
def _(x: Inputs):
    return ranking.vehicles_to_review(scores(x), "Combinado", x.view("refuel"), 100, known(x))


@query("ag16_invoices_to_review", ["invoice", "invoice_line"], """
WITH l AS (SELECT number, sum(amount) AS lt FROM invoice_line GROUP BY 1),
h AS (SELECT i.number FROM invoice i LEFT JOIN l ON l.number = i.number
      WHERE abs((total - coalesce(lt, 0)) / greatest(abs(coalesce(lt, 0)), 1)) > 0.005),
o AS (SELECT number, amount FROM invoice_line WHERE concept NOT IN ('COMBUSTIBLE', 'AJUSTE')),
f AS (SELECT number, 'factura_no_concilia' AS rule, 0 AS amount FROM h UNION ALL SELECT number, 'producto_no_combustible', amount FROM o),
g AS (SELECT number, count(*) AS findings, string_agg(DISTINCT rule, '; ' ORDER BY rule) AS rules, sum(amount) AS s,
             bool_or(rule = 'factura_no_concilia') AS hd FROM f GROUP BY 1)
SELECT cast(i.number as varchar) AS number, supplier, period, findings, rules,
       round(s + CASE WHEN hd THEN coalesce(abs(round(total - lt, 2)), 0) ELSE 0 END, 2) AS at_stake
FROM invoice i JOIN g ON g.number = i.number LEFT JOIN l ON l.number = i.number""")
def _(x: Inputs):
    heads, lines = x.view("invoice"), x.view("invoice_line")
    alerts = invoices.header_mismatch(heads, lines).unionByName(
        invoices.line_irregularities(lines.select(F.col("refuel_ref").alias("id"), F.lit(1e9).alias("unit_price")), lines)
        .filter(F.col("rule") == "producto_no_combustible"))
    return ranking.invoices_to_review(heads, lines, alerts).drop("total")


@query("ml12_out_of_service_refuels", ["refuel", "vehicle"], """
SELECT r.id, r.vehicle_id, v.plate, v.state, v.vehicle_type, r.litres,
       cast(datediff('day', state_date, cast(date as date)) as int) AS days_since
FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id WHERE state <> 'EN SERVICIO' AND cast(date as date) >= state_date""")
def _(x: Inputs):
    return ranking.out_of_service_refuels(refuels(x), x.view("vehicle"), None).select(
        "id", "vehicle_id", "plate", "state", "vehicle_type", "litres", "days_since")


@query("ml12_out_of_service_with_requests", ["refuel", "request", "vehicle"], f"""WITH RECURSIVE {CONTEXT}
SELECT r.id, r.vehicle_id, v.plate, v.state, v.vehicle_type, cast(r.date as date) AS date, r.station, r.litres,
       cast(datediff('day', state_date, cast(r.date as date)) as int) AS days_since, p.request_id IS NULL AS without_request,
       CASE WHEN p.request_id IS NULL THEN 'no request: the card was used outside the system' ELSE 'with a request: the state changed after it' END AS reason
FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id LEFT JOIN context_pairs p ON p.refuel_id = r.id
WHERE state <> 'EN SERVICIO' AND cast(r.date as date) >= state_date""")
def _(x: Inputs):
    a, b = refuels(x), requests(x)
    return ranking.out_of_service_refuels(a, x.view("vehicle"), matching.context_pairs(a, b, x.view("vehicle")))


@query("ml13_immediate_withdrawals", ["device", "vehicle"], f"""WITH {LINK_CTES},
d AS (SELECT *, try_cast(last_contact as timestamp) AS seen FROM device)
SELECT alias, l.linked_vehicle AS vehicle_id, v.state, device_group,
       cast(floor((epoch((SELECT max(seen) FROM d)) - epoch(seen)) / 86400) as bigint) AS silent_days,
       device_group = 'BAJA / REEMPLAZOS' AS group_out_of_date, seen IS NULL AS unreadable_date
FROM ({link_sql('d')}) l JOIN vehicle v ON v.vehicle_id = l.linked_vehicle
WHERE v.state LIKE '%BAJA%' AND (seen IS NULL OR (SELECT max(seen) FROM d) - seen <= INTERVAL '7' DAY)""")
def _(x: Inputs):
    return ranking.immediate_withdrawals(x.view("vehicle"), x.view("device")).select(
        "alias", "vehicle_id", "state", "device_group", "silent_days", "group_out_of_date", "unreadable_date")


@query("win13_nearest_request", ["refuel", "request"], """
WITH a AS (SELECT id, vehicle_id, epoch(cast(date || ' ' || coalesce(time, '00:00:00') as timestamp)) AS s FROM refuel WHERE vehicle_id IS NOT NULL),
b AS (SELECT vehicle_id, epoch(strptime(date || ' ' || time, '%d/%m/%Y %H:%M:%S')) AS s FROM request)
SELECT a.id, a.vehicle_id, round(min(abs(a.s - b.s)) / 60, 4) AS minutes FROM a LEFT JOIN b ON a.vehicle_id = b.vehicle_id
GROUP BY a.id, a.vehicle_id""")
def _(x: Inputs):
    out = causes.nearest_request_minutes(refuels(x), requests(x), "vehicle_id")
    return out.withColumn("minutes", F.round("minutes", 4))


@query("r20_surrounding_readings", ["refuel"], """
WITH a AS (SELECT id, vehicle_id, cast(date || ' ' || coalesce(time, '00:00:00') as timestamp) AS t,
                  cast(odometer as double) AS odometer FROM refuel WHERE vehicle_id IS NOT NULL),
p AS (SELECT * FROM a WHERE odometer IS NOT NULL),
c AS (SELECT a.id, arg_max(p.odometer, (p.t, p.id)) FILTER (WHERE p.t < a.t) AS before_odometer,
             arg_min(p.odometer, (p.t, p.id)) FILTER (WHERE p.t > a.t) AS after_odometer
      FROM a LEFT JOIN p ON p.vehicle_id = a.vehicle_id GROUP BY a.id)
SELECT id AS probe, before_odometer, after_odometer FROM c""")
def _(x: Inputs):
    r = refuels(x).withColumn("odometer", F.col("odometer").cast("double"))
    probes = r.filter("vehicle_id IS NOT NULL").select(F.col("id").alias("probe"), "vehicle_id", "instant")
    around = causes.surrounding_readings(probes, r.filter("odometer IS NOT NULL"))
    return around.select("probe", F.col("before.odometer").alias("before_odometer"), F.col("after.odometer").alias("after_odometer"))


def _causes(x: Inputs):
    a, b = refuels(x), requests(x)
    pairs = settle(matching.context_pairs(a, b, x.view("vehicle")))
    return causes.probable_causes(a, b, pairs, matching.unserved_requests(b, pairs))


# The likeliest request of every refuel without one by a plain join; readings around it in both vehicles decide.
CAUSES = f"""{CONTEXT},
rd AS (SELECT id, vehicle_id, litres, cast(odometer as double) AS o, cast(date || ' ' || coalesce(time, '00:00:00') as timestamp) AS t
       FROM refuel WHERE odometer IS NOT NULL),
ask AS (SELECT id, vehicle_id, loaded, strptime(date || ' ' || time, '%d/%m/%Y %H:%M:%S') AS t, station = 'ESTACION AJENA' AS abroad FROM request
        WHERE loaded IS NOT NULL AND (station = 'ESTACION AJENA' OR (settled = 'SI' AND voided <> 'SI' AND id NOT IN (SELECT request_id FROM context_pairs)))),
cand AS (SELECT rd.*, ask.id AS request_id, ask.vehicle_id AS other, abroad, CASE WHEN abroad THEN 0 ELSE 1 END AS native, abs(epoch(rd.t) - epoch(ask.t)) AS gap
         FROM rd JOIN ask ON abs(rd.litres - ask.loaded) <= 0.5 AND rd.t - ask.t BETWEEN INTERVAL '-30' MINUTE AND INTERVAL '180' MINUTE
           AND abroad = coalesce(rd.vehicle_id = ask.vehicle_id, false)
         WHERE rd.vehicle_id IS NOT NULL AND rd.id NOT IN (SELECT refuel_id FROM context_pairs)),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY native, gap, request_id) = 1),
side AS (SELECT best.id, own, arg_max(rd.o, (rd.t, rd.id)) FILTER (rd.t < best.t) AS low, arg_min(rd.o, (rd.t, rd.id)) FILTER (rd.t > best.t) AS high,
                arg_min(rd.id, (rd.t, rd.id)) FILTER (rd.t > best.t) AS next_id
         FROM best CROSS JOIN (VALUES (true), (false)) w(own) JOIN rd ON rd.vehicle_id = CASE WHEN own THEN best.vehicle_id ELSE best.other END
         WHERE native = 1 GROUP BY best.id, own),
judged AS (SELECT best.*, me.next_id, CASE WHEN native = 0 THEN 'proveedor_equivocado'
             WHEN coalesce(he.low <= o, true) AND coalesce(o <= he.high, true) AND NOT (coalesce(me.low <= o, true) AND coalesce(o <= me.high, true))
             THEN 'tarjeta_equivocada' ELSE 'dominio_equivocado' END AS cause
           FROM best LEFT JOIN side me ON me.id = best.id AND me.own LEFT JOIN side he ON he.id = best.id AND NOT he.own),
told AS (SELECT id AS record_id, cause, native, gap, id FROM judged UNION ALL SELECT request_id, cause, native, gap, id FROM judged
         UNION ALL SELECT next_id, cause, native, gap, id FROM judged WHERE cause = 'tarjeta_equivocada' AND next_id IS NOT NULL),
probable AS (SELECT record_id, cause FROM told
             QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY native DESC, gap DESC, id DESC, (record_id = id) DESC) = 1)"""


@query("r20_probable_causes", ["refuel", "request", "vehicle"], f"WITH RECURSIVE {CAUSES} SELECT record_id, cause FROM probable")
def _(x: Inputs):
    return _causes(x)


@query("r21_attached_causes", ["refuel", "vehicle"], """
SELECT r.id AS record_id, 'litros_mayor_a_tanque' AS rule,
       CASE WHEN r.card = 'T900000000' THEN 'tarjeta_equivocada' ELSE 'sin_explicacion' END AS probable_cause
FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id WHERE litres > tank_capacity
UNION ALL SELECT id, 'contingencia', NULL FROM refuel WHERE origin = 'CONTINGENCIA'""")
def _(x: Inputs):
    from tallyhound.operators.rules import charges

    r = x.view("refuel")
    alerts = volume.over_tank(r, x.view("vehicle")).unionByName(charges.fallback_refuels(r))
    found = r.filter(F.col("card") == "T900000000").select(F.col("id").alias("record_id"), F.lit("tarjeta_equivocada").alias("cause"))
    return causes.attach_causes(alerts, found).select("record_id", "rule", "probable_cause")


@query("r22_attached_outcomes", ["alert"], """
WITH o AS (SELECT concat('R', lpad(cast(doc_id as varchar), 12, '0')) AS record_id,
                  CASE WHEN toxic = 1 THEN 'error_humano' WHEN quality = 0 THEN 'pendiente' ELSE 'faltante' END AS outcome FROM labels)
SELECT a.record_id, a.rule, o.outcome, o.outcome IS NOT NULL AS documented
FROM alert a LEFT JOIN o ON o.record_id = a.record_id AND outcome <> 'pendiente' AND a.anomaly_type <> 'VALOR_NULO'""")
def _(x: Inputs):
    done = x.table("labels").select(
        F.concat(F.lit("R"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("record_id"), F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, "error_humano").when(F.col("quality") == 0, "pendiente").otherwise("faltante").alias("outcome"))
    rules = x.view("alert").filter("anomaly_type <> 'VALOR_NULO'").select("record_id", "rule").distinct()
    return causes.attach_outcomes(x.view("alert"), done.join(rules, "record_id")).select("record_id", "rule", "outcome", "documented")


@query("jn13_linked_claims", ["refuel"], """
WITH cl AS (SELECT event_id AS claim, CASE WHEN event_id % 3 = 0 THEN cast(event_id as varchar) || '.0' END AS ticket,
            CASE WHEN event_id % 3 = 1 THEN user_id END AS vehicle_id,
            CASE WHEN event_id % 3 <> 0 THEN concat('T', lpad(cast(user_id as varchar), 9, '0')) END AS card,
            date_trunc('second', ts) + INTERVAL '5' MINUTE AS t FROM events WHERE event_type = 'error'),
r AS (SELECT *, cast(date || ' ' || coalesce(time, '00:00:00') as timestamp) AS t FROM refuel),
tk AS (SELECT claim, min(r.id) AS id FROM cl JOIN r ON nullif(ltrim(regexp_replace(r.id, '\\D', '', 'g'), '0'), '') =
       ltrim(replace(ticket, '.0', ''), '0') GROUP BY 1),
vh AS (SELECT claim, arg_min(r.id, (abs(epoch(cl.t) - epoch(r.t)), r.t, r.id)) AS id FROM cl JOIN r USING (vehicle_id)
       WHERE claim NOT IN (SELECT claim FROM tk) AND abs(epoch(cl.t) - epoch(r.t)) <= 900 GROUP BY 1),
cd AS (SELECT claim, arg_min(r.id, (abs(epoch(cl.t) - epoch(r.t)), r.t, r.id)) AS id FROM cl JOIN r USING (card)
       WHERE claim NOT IN (SELECT claim FROM tk) AND abs(epoch(cl.t) - epoch(r.t)) <= 900 GROUP BY 1)
SELECT claim, coalesce(tk.id, vh.id, cd.id) AS refuel_id, CASE WHEN tk.id IS NOT NULL THEN 'ticket' WHEN vh.id IS NOT NULL
       THEN 'patente_y_hora' WHEN cd.id IS NOT NULL THEN 'tarjeta_y_hora' END AS link
FROM cl LEFT JOIN tk USING (claim) LEFT JOIN vh USING (claim) LEFT JOIN cd USING (claim)""")
def _(x: Inputs):
    e = x.table("events").filter("event_type = 'error'")
    n = F.col("event_id") % 3
    claims = e.select(
        F.col("event_id").alias("claim"), F.when(n == 0, F.concat(F.col("event_id").cast("string"), F.lit(".0"))).alias("ticket"),
        F.when(n == 1, F.col("user_id")).alias("vehicle_id"),
        F.when(n != 0, F.concat(F.lit("T"), F.lpad(F.col("user_id").cast("string"), 9, "0"))).alias("card"),
        F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + 300).alias("instant"))
    return causes.link_claims(claims, refuels(x)).select("claim", "refuel_id", "link")


@query("jn19_alerts_with_records", ["refuel", "vehicle", "invoice", "invoice_line"], """
WITH l AS (SELECT number, sum(amount) AS lt FROM invoice_line GROUP BY 1),
al AS (SELECT r.id AS record_id, 'litros_mayor_a_tanque' AS rule FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id WHERE litres > tank_capacity
  UNION ALL SELECT cast(i.number as varchar), 'factura_no_concilia' FROM invoice i LEFT JOIN l ON l.number = i.number
            WHERE abs((total - coalesce(lt, 0)) / greatest(abs(coalesce(lt, 0)), 1)) > 0.005
  UNION ALL SELECT line, 'producto_no_combustible' FROM invoice_line WHERE concept = 'LUBRICANTE' UNION ALL SELECT 'nobody', 'sin_registro')
SELECT al.record_id, al.rule, CASE WHEN r.id IS NOT NULL THEN 'refuel' WHEN i.line IS NOT NULL THEN 'invoice_line' WHEN h.number IS NOT NULL THEN 'invoice' END AS record_table,
       r.vehicle_id, r.plate, r.station, coalesce(r.litres, i.litres) AS litres, i.number, i.concept, i.amount, h.supplier, h.period, round(h.total, 4) AS total
FROM al LEFT JOIN refuel r ON r.id = al.record_id LEFT JOIN invoice_line i ON i.line = al.record_id LEFT JOIN invoice h ON cast(h.number as varchar) = al.record_id""")
def _(x: Inputs):
    from tallyhound.operators.alerts import with_records

    lines, heads = x.view("invoice_line"), x.view("invoice")
    alerts = volume.over_tank(refuels(x), x.view("vehicle")).select("record_id", "rule").unionByName(
        invoices.header_mismatch(heads, lines).select("record_id", "rule")).unionByName(
        lines.filter("concept = 'LUBRICANTE'").select(F.col("line").alias("record_id"), F.lit("producto_no_combustible").alias("rule"))).unionByName(
        x.spark.range(1).select(F.lit("nobody").alias("record_id"), F.lit("sin_registro").alias("rule")))
    found = with_records(alerts, {
        "refuel": (x.view("refuel").select("id", "vehicle_id", "plate", "station", "litres"), "id"),
        "invoice_line": (lines.select("line", "number", "concept", "litres", "amount"), "line"),
        "invoice": (heads.select("number", "supplier", "period", "total").withColumnRenamed("number", "head"), "head")})
    return found.withColumn("total", F.round("total", 4))


_DEFECTS = """SELECT CASE c_custkey % 3 WHEN 0 THEN 'TEXT_NORMALIZATION' WHEN 1 THEN 'NUMERIC_FORMAT' ELSE 'DATE_FORMAT' END AS defect_type,
  CASE WHEN c_custkey % 3 = 1 THEN cast(c_custkey as string) ELSE c_name END AS original_value,
  CASE WHEN c_custkey % 3 = 1 AND c_custkey % 5 = 0 THEN concat(cast(c_custkey as string), '.0') WHEN c_custkey % 3 = 1 THEN concat('N° ', cast(c_custkey as string))
       WHEN c_custkey % 4 = 0 THEN concat(c_name, 'X') ELSE concat(' ', lower(c_name), '-') END AS injected_value FROM {customer}"""


@query("ev11_correction_rate", [], f"""WITH d AS ({_DEFECTS.format(customer='customer')}),
n AS (SELECT defect_type, CASE defect_type WHEN 'TEXT_NORMALIZATION' THEN upper(regexp_replace(injected_value, '[\\s\\-_.]', '', 'g')) = upper(regexp_replace(original_value, '[\\s\\-_.]', '', 'g'))
        WHEN 'NUMERIC_FORMAT' THEN regexp_replace(injected_value, '\\D', '', 'g') = original_value ELSE true END AS ok FROM d)
SELECT defect_type, count(*) AS defects, round_even(100.0 * count(*) FILTER (ok) / count(*), 1) AS corrected_pct FROM n GROUP BY 1""")
def _(x: Inputs):
    from tallyhound.operators.eda import correction_rate

    return correction_rate(x.spark.sql(_DEFECTS.format(customer=f"parquet.`{x.sf_dir}/customer.parquet`")))
