"""Aggregate audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.functions.text import normalise_id
from tallyhound.operators import audit, linkage, matching, sequence
from tallyhound.operators.rules import odometer, volume
from tallyhound.operators.settle import settle
from tallyhound.plans.queries_links import LINK_CTES, NORM, link_sql, refuels, requests
from tallyhound.plans.queries_matching import CONTEXT as CONTEXT_PAIRS
from tallyhound.plans.queries_sequence import EXEMPT, OWN, PLAIN_SEQ, SEQ, _SHAPE, exempt
from tallyhound.plans.queries_sources import data
from tallyhound.plans.registry import Inputs, query


def others(x: Inputs):
    return x.view("device").select(normalise_id(F.col("plate")).alias("code")).unionByName(
        x.view("request").select(normalise_id(F.col("plate")).alias("code"))).filter(F.col("code").isNotNull())


@query("jn08_unlinked_causes", ["refuel", "vehicle", "device", "request"], f"""
WITH reg AS (SELECT DISTINCT {NORM.format(c='plate')} AS p FROM vehicle),
u AS (SELECT id, {NORM.format(c='plate')} AS c, card IN (SELECT card FROM vehicle) AS known FROM refuel),
l AS (SELECT * FROM u WHERE c IS NULL OR c NOT IN (SELECT p FROM reg)),
eng AS (SELECT DISTINCT right(regexp_replace(engine_number, '\\D', '', 'g'), 8) AS s FROM vehicle),
oth AS (SELECT {NORM.format(c='plate')} AS p FROM device UNION SELECT {NORM.format(c='plate')} FROM request),
k AS (SELECT DISTINCT c FROM l WHERE c IS NOT NULL AND NOT known),
near AS (SELECT DISTINCT c FROM k JOIN reg ON abs(length(c) - length(p)) <= 1 AND damerau_levenshtein(c, p) = 1)
SELECT id, CASE WHEN known THEN 'clave_propia' WHEN c IN (SELECT s FROM eng) THEN 'ultimos_8_del_motor'
       WHEN c IN (SELECT c FROM near) THEN 'distancia_1_de_un_dominio' WHEN c IN (SELECT p FROM oth) THEN 'otra_fuente'
       WHEN c IS NULL OR NOT (regexp_matches(c, '[A-Z]') AND regexp_matches(c, '[0-9]') AND length(c) = 9) THEN 'forma_del_identificador'
       ELSE 'sin_explicacion' END AS cause FROM l""")
def _(x: Inputs):
    flagged = linkage.with_membership(x.view("refuel"), "card", x.view("vehicle"), "card", "known")
    return audit.explain_unlinked(flagged, "plate", x.view("vehicle"), others(x), F.col("known")).select("id", "cause")


@query("au02_linkage", ["refuel", "vehicle", "device", "request"], f"""WITH {LINK_CTES},
own AS (SELECT * FROM refuel WHERE coalesce(id_type <> 'DNI', true)),
li AS (SELECT link_tier AS t, card IN (SELECT card FROM vehicle) AS known FROM ({link_sql('own')})),
ti AS (SELECT count(*) AS total, count(*) FILTER (t = 'exacto') AS e, count(*) FILTER (t IN ('exacto', 'normalizado')) AS n, count(t) AS m,
              count(*) FILTER (t IS NOT NULL OR coalesce(known, false)) AS c FROM li),
codes AS (SELECT DISTINCT {NORM.format(c='plate')} AS p FROM vehicle),
u AS (SELECT id, {NORM.format(c='plate')} AS c, coalesce(card IN (SELECT card FROM vehicle), false) AS known FROM own),
l AS (SELECT * FROM u WHERE c IS NULL OR c NOT IN (SELECT p FROM codes)),
oth AS (SELECT {NORM.format(c='plate')} AS p FROM device UNION SELECT {NORM.format(c='plate')} FROM request),
k AS (SELECT DISTINCT c FROM l WHERE c <> ''),
near AS (SELECT c, p, levenshtein(c, p) AS d, list_filter(range(1, length(c) + 1), lambda i: c[i] <> p[i])[1] AS f FROM k JOIN codes
         ON abs(length(c) - length(p)) <= 1 AND damerau_levenshtein(c, p) = 1),
edit AS (SELECT c, CASE WHEN length(c) <> length(p) THEN 'letra_de_mas_o_de_menos' WHEN d = 1 AND c[f] || p[f] IN ('0O', 'O0', '1I', 'I1', '8B', 'B8')
           THEN 'confusion_visual' WHEN d = 1 THEN 'letra_cambiada' ELSE 'transposicion' END AS edit FROM near
         QUALIFY row_number() OVER (PARTITION BY c ORDER BY length(p), p) = 1),
why AS (SELECT id, l.c, edit, CASE WHEN l.c IS NULL OR l.c = '' THEN 'vacio' WHEN regexp_matches(l.c, '^[0-9]+$') THEN 'solo_digitos'
          WHEN regexp_matches(l.c, '^[A-Z]+$') THEN 'solo_letras' WHEN length(l.c) NOT IN (SELECT length(p) FROM codes) THEN 'largo_distinto'
          ELSE 'forma_de_dominio' END AS shape, known, l.c IN (SELECT s FROM tails) AS engine, coalesce(l.c IN (SELECT p FROM oth), false) AS other
        FROM l LEFT JOIN edit ON edit.c = l.c),
cause AS (SELECT *, CASE WHEN known THEN 'clave_propia' WHEN engine THEN 'ultimos_8_del_motor' WHEN edit IS NOT NULL THEN 'distancia_1_de_un_dominio'
            WHEN other THEN 'otra_fuente' WHEN shape <> 'forma_de_dominio' THEN 'forma_del_identificador' ELSE 'sin_explicacion' END AS cause FROM why),
counted AS (SELECT 'por_causa' AS block, cause AS part FROM cause UNION ALL SELECT 'distancia_1_por_edicion', edit FROM cause WHERE cause = 'distancia_1_de_un_dominio'
  UNION ALL SELECT 'forma_de_todas_las_sin_vinculo', shape FROM cause UNION ALL SELECT 'forma_del_identificador', shape FROM cause WHERE cause = 'forma_del_identificador'),
grouped AS (SELECT block, part, count(*) AS n FROM counted GROUP BY ALL)
SELECT block, part, n, cast(sum(n) OVER (PARTITION BY block) as bigint) AS total FROM grouped
UNION ALL SELECT 'vinculadas', i.part, i.n, total FROM (SELECT unnest([{{'part': 'exacto', 'n': e}}, {{'part': 'normalizado', 'n': n}}, {{'part': 'motor', 'n': m}},
  {{'part': 'tarjeta', 'n': c}}]) AS i, total FROM ti)""")
def _(x: Inputs):
    return audit.linkage_block(x.view("refuel"), x.view("vehicle"), others(x))


@query("au02_published_linkage")
def _(x: Inputs):
    return audit.publish(audit.linkage_block(x.view("refuel"), x.view("vehicle"), others(x)))


@query("au03_odometer_exemptions", ["refuel", "vehicle", "exemption"], f"""WITH {SEQ.format(source=OWN.format(exempt=EXEMPT), skip="")},
ex AS (SELECT DISTINCT id FROM refuel WHERE {EXEMPT}),
fl AS (SELECT id, bool_or(km = 0) AS still, bool_or(km = 0 AND days > 0 AND NOT exempt) AS o FROM seq WHERE km = 0 GROUP BY id),
ro AS (SELECT coalesce(still, false) AS still, coalesce(o, false) AS o, ex.id IS NOT NULL AS covered FROM fl FULL JOIN ex ON ex.id = fl.id),
c AS (SELECT count(*) FILTER (covered) AS a, count(*) FILTER (still) AS b, count(*) FILTER (still AND covered) AS d, count(*) FILTER (still AND NOT o) AS e,
             count(*) FILTER (o) AS f FROM ro)
SELECT 'vehiculos_exceptuados_hoy' AS block, 'exceptuados' AS part, count(*) FILTER (odometer_exempt = 'SI') AS n FROM vehicle
UNION ALL SELECT 'cargas_sin_avance', i.part, i.n FROM (SELECT unnest([{{'part': 'cargas_con_excepcion_vigente', 'n': a}}, {{'part': 'sin_avance', 'n': b}},
  {{'part': 'sin_avance_con_excepcion', 'n': d}}, {{'part': 'sin_avance_el_mismo_dia_o_con_excepcion', 'n': e}}, {{'part': 'sin_avance_sin_excepcion', 'n': f}}]) AS i FROM c)""")
def _(x: Inputs):
    steps = settle(sequence.odometer_sequence(refuels(x), exempt=exempt(x)))
    alerts = odometer.no_advance(steps).unionByName(odometer.no_advance_without_exemption(steps))
    return audit.odometer_block(x.view("vehicle"), alerts, exempt(x)).select("block", "part", "n")


@query("au04_regressions", ["refuel"], f"""WITH {PLAIN_SEQ},
s AS (SELECT CASE WHEN {_SHAPE} <> 'otro' THEN {_SHAPE} WHEN NOT abs(previous - odometer) > 500 THEN 'leve'
       WHEN following IS NULL OR previous2 IS NULL THEN 'sin_vecinos' WHEN following < previous THEN 'se_queda_abajo' ELSE 'otro_patron' END AS part
      FROM seq WHERE km < 0)
SELECT 'retrocesos_todos' AS block, part, count(*) AS n, (SELECT count(*) FROM s) AS total FROM s GROUP BY part""")
def _(x: Inputs):
    steps = sequence.odometer_sequence(refuels(x))
    alerts = odometer.decreases(steps).unionByName(odometer.decreases_in_context(steps))
    return audit.regressions_block(steps, alerts).filter("block = 'retrocesos_todos'")


@query("au05_fallback", ["refuel"], """
WITH m AS (SELECT *, epoch(cast(date || ' ' || coalesce(time, '00:00:00') as timestamp)) AS s FROM refuel WHERE vehicle_id IS NOT NULL),
p AS (SELECT a.id, min(CASE WHEN round(a.litres, 2) = round(b.litres, 2) THEN 0 WHEN abs(a.litres - b.litres) <= 0.02 * b.litres + 1e-9 THEN 1
        WHEN abs(a.litres / 10 - b.litres) <= 0.02 * b.litres + 1e-9 OR abs(a.litres / 100 - b.litres) <= 0.02 * b.litres + 1e-9
             OR abs(a.litres * 10 - b.litres) <= 0.02 * b.litres + 1e-9 OR abs(a.litres * 100 - b.litres) <= 0.02 * b.litres + 1e-9 THEN 2
        WHEN abs(a.litres - b.litres) / b.litres <= 0.10 THEN 3 WHEN abs(a.litres - b.litres) / b.litres <= 0.50 THEN 4 ELSE 5 END) AS k
      FROM m a JOIN m b ON a.vehicle_id = b.vehicle_id AND abs(a.s - b.s) < 43200
      WHERE a.origin = 'CONTINGENCIA' AND b.origin <> 'CONTINGENCIA' GROUP BY a.id)
SELECT ['iguales', 'hasta_2_pct', 'decimal_movido', 'de_2_a_10_pct', 'de_10_a_50_pct', 'mas_de_50_pct'][k + 1] AS part, count(*) AS n FROM p GROUP BY 1""")
def _(x: Inputs):
    r = refuels(x)
    return audit.fallback_block(r, audit.fallback_pairs(r)).filter("block = 'litros_con_la_carga_mas_parecida'").select("part", "n")


@query("au06_excess", ["refuel", "vehicle"], """
WITH ra AS (SELECT r.id, r.vehicle_id, r.date, litres / tank_capacity AS q FROM refuel r LEFT JOIN vehicle v ON v.vehicle_id = r.vehicle_id),
po AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY date, id) - 1 AS pos, count(*) OVER (PARTITION BY vehicle_id) AS usable FROM ra WHERE q IS NOT NULL),
ea AS (SELECT DISTINCT vehicle_id FROM po WHERE q > 1.02 AND pos < greatest(usable * 0.25, 1)),
cl AS (SELECT *, CASE WHEN vehicle_id IN (SELECT vehicle_id FROM ea) THEN 'desde_el_inicio' ELSE 'despues' END AS w FROM po WHERE q > 1.02),
ow AS (SELECT w, vehicle_id, count(*) AS n, count(*) / any_value(usable) AS part, stddev_pop(q) / avg(q) AS cv FROM cl GROUP BY 1, 2),
li AS (SELECT w || '_cociente' AS block, CASE WHEN q <= 1.05 THEN '1_02_a_1_05' WHEN q <= 1.10 THEN '1_05_a_1_10' WHEN q <= 1.25 THEN '1_10_a_1_25'
         WHEN q <= 1.50 THEN '1_25_a_1_50' ELSE 'mas_de_1_50' END AS part FROM cl
  UNION ALL SELECT w || '_fraccion', CASE WHEN part < 0.10 THEN 'menos_de_0_10' WHEN part <= 0.30 THEN '0_10_a_0_30' WHEN part < 0.60 THEN '0_30_a_0_60' ELSE 'mas_de_0_60' END FROM ow
  UNION ALL SELECT w || '_cv', CASE WHEN cv < 0.05 THEN 'menos_de_0_05' WHEN cv <= 0.15 THEN '0_05_a_0_15' WHEN cv <= 0.30 THEN '0_15_a_0_30' ELSE 'mas_de_0_30' END FROM ow WHERE n >= 3),
gr AS (SELECT block, part, count(*) AS n FROM li GROUP BY ALL),
su AS (SELECT count(*) AS total, count(q) AS a, count(*) - count(q) AS b, count(*) FILTER (q > 1.0) AS c, count(*) FILTER (q > 1.02) AS d, count(*) FILTER (q > 1.05) AS e,
              count(*) FILTER (q > 1.1) AS f FROM ra)
SELECT block, part, n, cast(sum(n) OVER (PARTITION BY block) as bigint) AS total FROM gr
UNION ALL SELECT 'exceso_volumetrico', i.part, i.n, total FROM (SELECT unnest([{'part': 'cargas_evaluables', 'n': a}, {'part': 'cargas_sin_capacidad_registrada', 'n': b},
  {'part': 'mas_de_1_0', 'n': c}, {'part': 'mas_de_1_02', 'n': d}, {'part': 'mas_de_1_05', 'n': e}, {'part': 'mas_de_1_1', 'n': f}]) AS i, total FROM su)""")
def _(x: Inputs):
    alerts = volume.over_tank_with_history(refuels(x), x.view("vehicle"))
    return audit.excess_block(refuels(x), x.view("vehicle"), alerts)


@query("au06_excess_concentration", ["refuel", "vehicle"], """
WITH v AS (SELECT r.vehicle_id, count(*) AS n FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id WHERE litres > tank_capacity * 1.02 GROUP BY 1),
c AS (SELECT n, sum(n) OVER (ORDER BY n DESC, vehicle_id) AS cum, row_number() OVER (ORDER BY n DESC, vehicle_id) AS k FROM v)
SELECT (SELECT count(*) FROM v) AS vehicles, cast((SELECT sum(n) FROM v) as bigint) AS refuels, min(k) AS for_half FROM c
WHERE cum * 2 >= (SELECT sum(n) FROM v)""")
def _(x: Inputs):
    return audit.excess_concentration(x.view("refuel"), x.view("vehicle"))


@query("au07_claims")
def _(x: Inputs):
    from tallyhound.operators.rules import charges

    r = refuels(x)
    claims = r.filter(F.col("origin") == "CONTINGENCIA").select(
        F.col("id").alias("claim"), F.lit("doble_cobro").alias("type"),
        F.when(F.col("product") == "DIESEL", "nota_de_credito").otherwise("pendiente").alias("state"), F.lit("ticket").alias("link"), "date",
        F.col("id").alias("refuel_id"))
    return audit.claims_block(claims, charges.fallback_refuels(r).unionByName(charges.double_charges(r)), r)


@query("au08_coverage", ["refuel", "request"], """
SELECT 'cargas_del_reporte' AS block, substr(date, 1, 7) AS part, count(*) AS n FROM refuel GROUP BY 2
UNION ALL SELECT CASE WHEN station = 'ESTACION AJENA' THEN 'pedidos_de_otra_red' ELSE 'pedidos_del_proveedor' END, substr(date, 7, 4) || '-' || substr(date, 4, 2), count(*)
FROM request GROUP BY 1, 2""")
def _(x: Inputs):
    return audit.coverage_block(refuels(x), requests(x), None, None).select("block", "part", "n")


@query("au09_time_windows", ["refuel", "request", "vehicle"], f"""WITH RECURSIVE {CONTEXT_PAIRS},
fr AS (SELECT r.id, substr(r.date, 1, 7) AS month, {NORM.format(c='coalesce(v.plate, r.plate)')} AS k,
              epoch(cast(r.date || ' ' || coalesce(r.time, '00:00:00') as timestamp)) AS s, context_pairs.request_id
       FROM refuel r LEFT JOIN vehicle v ON v.vehicle_id = r.vehicle_id LEFT JOIN context_pairs ON context_pairs.refuel_id = r.id),
fq AS (SELECT id, {NORM.format(c='plate')} AS k, epoch(strptime(date || ' ' || time, '%d/%m/%Y %H:%M:%S')) AS s FROM request WHERE station <> 'ESTACION AJENA'),
mi AS (SELECT fr.id, any_value(month) AS month, min(abs(fr.s - fq.s)) / 60 AS m FROM fr LEFT JOIN fq ON fq.k = fr.k WHERE request_id IS NULL GROUP BY fr.id),
gap AS (SELECT abs(fr.s - fq.s) / 60 AS m FROM fr JOIN fq ON fq.id = fr.request_id),
listed AS (SELECT 'cargas_sin_pedido' AS block, CASE WHEN m <= 180 THEN 'hasta_3_horas' WHEN m <= 360 THEN 'de_3_a_6_horas' WHEN m <= 720 THEN 'de_6_a_12_horas' WHEN m <= 1440 THEN 'de_12_a_24_horas' ELSE 'ninguno_a_menos_de_24_horas' END AS part FROM mi
  UNION ALL SELECT 'cargas_sin_pedido_por_mes', month FROM mi
  UNION ALL SELECT 'minutos_de_los_pares_que_cruzan', CASE WHEN m <= 5 THEN 'hasta_5' WHEN m <= 30 THEN 'de_5_a_30' WHEN m <= 60 THEN 'de_30_a_60'
    WHEN m <= 180 THEN 'de_1_a_3_horas' ELSE 'mas_de_3_horas' END FROM gap),
grouped AS (SELECT block, part, count(*) AS n FROM listed GROUP BY ALL)
SELECT block, part, n, cast(sum(n) OVER (PARTITION BY block) as bigint) AS total FROM grouped""")
def _(x: Inputs):
    r, q = refuels(x), requests(x)
    pairs = settle(matching.context_pairs(r, q, x.view("vehicle")))
    return audit.time_window_block(r, q, x.view("vehicle"), pairs)


@query("au10_invoice_prices", ["invoice", "invoice_line"], """
WITH s AS (SELECT i.number, total, pdf_total, sum(amount) AS l FROM invoice i LEFT JOIN invoice_line USING (number) GROUP BY ALL),
d AS (SELECT abs((total - l) / nullif(l, 0)) AS g FROM s)
SELECT CASE WHEN g = 0 THEN 'exacta' WHEN g <= 0.001 THEN 'hasta_0_1_pct' WHEN g <= 0.005 THEN 'de_0_1_a_0_5_pct' WHEN g <= 0.02 THEN 'de_0_5_a_2_pct'
       ELSE 'mas_de_2_pct' END AS part, count(*) AS n FROM d WHERE g IS NOT NULL AND g > 0.0001 GROUP BY 1""")
def _(x: Inputs):
    # Differences that only come from the order of adding up are left out, in both engines.
    heads = x.view("invoice").join(x.view("invoice_line").groupBy("number").agg(F.sum("amount").alias("l")), "number")
    lines = x.view("invoice_line").withColumn("refuel_ref", F.col("refuel_ref").cast("string"))
    real = heads.filter(F.abs((F.col("total") - F.col("l")) / F.col("l")) > 0.0001).drop("l")
    parts = x.table("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_retailprice").alias("unit_price"),
                                   F.lit("1997-01-01").cast("date").alias("date"))
    return audit.invoice_price_block(parts, real, lines).filter("block = 'diferencias_entre_deuda_y_lineas'").select("part", "n")


@query("au11_model_agreement", ["refuel"], """
WITH a AS (SELECT id FROM refuel ORDER BY litres DESC, id LIMIT 100), b AS (SELECT id FROM refuel ORDER BY amount DESC, id LIMIT 100),
c AS (SELECT id FROM refuel WHERE litres > 100)
SELECT 'supervisado_e_isolation_forest' AS part, (SELECT count(*) FROM a WHERE id IN (SELECT id FROM b)) AS n
UNION ALL SELECT 'supervisado_y_reglas_con_contexto', (SELECT count(*) FROM b WHERE id IN (SELECT id FROM c))
UNION ALL SELECT 'isolation_forest_y_reglas_con_contexto', (SELECT count(*) FROM a WHERE id IN (SELECT id FROM c))""")
def _(x: Inputs):
    r = x.view("refuel").select(F.col("id").alias("record_id"), "litres", "amount")
    alerts = r.filter("litres > 100").select("record_id", F.lit("exceso_sin_antecedente").alias("rule"))
    return audit.model_agreement(r.select("record_id", F.col("litres").alias("score")), r.select("record_id", F.col("amount").alias("score")),
                                 alerts, ["exceso_sin_antecedente"]).select("part", "n")


_TWO = "CASE WHEN {v} = 0 THEN 0 ELSE round_even({v} / pow(10, floor(log10(abs({v}))) - 1), 0) * pow(10, floor(log10(abs({v}))) - 1) END"


@query("au11_feature_quantiles", ["refuel"], " UNION ALL ".join(
    f"SELECT '{c}' AS variable, " + ", ".join(f"{_TWO.format(v=f'quantile_cont({c}, {q})')} AS {p}" for p, q in
                                              (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))) + " FROM refuel"
    for c in ("litres", "amount", "odometer")))
def _(x: Inputs):
    return audit.model_quantiles(x.view("refuel"), ["litres", "amount", "odometer"])


@query("au01_whole_audit")
def _(x: Inputs):
    tables = data(x)
    tables["invoice_line"] = tables["invoice_line"].withColumn("refuel_ref", F.concat(F.lit("R"), F.lpad(F.col("refuel_ref").cast("string"), 12, "0")))
    return audit.audit(tables)
