"""Matching, causes and range-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.operators import matching
from tallyhound.operators.rules import requests as request_rules
from tallyhound.operators.settle import settle
from tallyhound.plans.queries_ledger import plain
from tallyhound.plans.queries_links import LINK_CTES, NORM, alert_sql, link_sql, refuels, requests
from tallyhound.plans.registry import Inputs, query

MATCH_VIEWS = ["refuel", "request", "vehicle"]
KEYED = f"""
a AS (SELECT r.id, r.litres, cast(r.date || ' ' || coalesce(r.time, '00:00:00') as timestamp) AS t,
             CASE WHEN id_type = 'DNI' THEN 'P:' || driver ELSE 'D:' || {NORM.format(c='coalesce(v.plate, r.plate)')} END AS k
      FROM refuel r LEFT JOIN vehicle v ON v.card = r.card),
b AS (SELECT id, loaded, voided = 'SI' AS voided, strptime(date || ' ' || time, '%d/%m/%Y %H:%M:%S') AS t,
             CASE WHEN personal_card THEN 'P:' || requester ELSE 'D:' || {NORM.format(c='plate')} END AS k
      FROM request WHERE station <> 'ESTACION AJENA'),
pairs AS (SELECT a.id AS refuel_id, b.id AS request_id,
                 abs((epoch(a.t) - epoch(b.t)) / 60 - 45) / 60 + 2 * abs(a.litres - loaded) / greatest(a.litres, 1)
                 + CASE WHEN voided THEN 2 ELSE 0 END AS cost
          FROM a JOIN b ON a.k = b.k AND a.t - b.t BETWEEN INTERVAL '-30' MINUTE AND INTERVAL '180' MINUTE
          WHERE loaded IS NOT NULL)"""


# All assignments of a component, refuel by refuel in order of id; the cheapest, then the first in order of ids, stands.
OPTIMAL = f"""{KEYED},
span AS (SELECT k, id, 'refuel' AS kind, epoch(t) - 10800 AS s, epoch(t) + 1800 AS f FROM a WHERE k IS NOT NULL
         UNION ALL SELECT k, id, 'request', epoch(t), epoch(t) FROM b WHERE loaded IS NOT NULL),
reach AS (SELECT *, max(f) OVER (PARTITION BY k ORDER BY s, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM span),
comp AS (SELECT k, id, kind, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, kind, id ROWS UNBOUNDED PRECEDING) AS c
         FROM reach),
edge AS (SELECT comp.k, comp.c, p.* FROM pairs p JOIN comp ON comp.kind = 'refuel' AND comp.id = p.refuel_id WHERE cost < 5),
bidder AS (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY refuel_id) AS i, count(*) OVER (PARTITION BY k, c) AS n
           FROM (SELECT DISTINCT k, c, refuel_id FROM edge)),
choice AS (SELECT k, c, i, refuel_id, request_id, cost FROM bidder JOIN edge USING (k, c, refuel_id)
           UNION ALL SELECT k, c, i, refuel_id, NULL, 5.0 FROM bidder),
walk(k, c, i, n, cost, taken, refuels) AS (
  SELECT DISTINCT k, c, 0::bigint, n, 0.0::double, []::varchar[], []::varchar[] FROM bidder
  UNION ALL SELECT w.k, w.c, x.i, w.n, w.cost + x.cost, list_append(w.taken, coalesce(x.request_id, '~')), list_append(w.refuels, x.refuel_id)
  FROM walk w JOIN choice x ON x.k = w.k AND x.c = w.c AND x.i = w.i + 1 AND (x.request_id IS NULL OR NOT list_contains(w.taken, x.request_id))),
cheapest AS (SELECT refuels, taken FROM walk WHERE i = n QUALIFY row_number() OVER (PARTITION BY k, c ORDER BY round(cost, 9), taken) = 1),
matched AS (SELECT * FROM (SELECT unnest(refuels) AS refuel_id, unnest(taken) AS request_id FROM cheapest) WHERE request_id <> '~')"""
UNIQUE = f"""{LINK_CTES},
lone AS (SELECT id, litres, cast(date || ' ' || coalesce(time, '00:00:00') as timestamp) AS t FROM ({link_sql('refuel')})
         WHERE link_tier IS NULL AND coalesce(card NOT IN (SELECT card FROM vehicle), true) AND coalesce(id_type <> 'DNI', true)
           AND id NOT IN (SELECT refuel_id FROM matched)),
spare AS (SELECT id, loaded, strptime(date || ' ' || time, '%d/%m/%Y %H:%M:%S') AS t FROM request
          WHERE station <> 'ESTACION AJENA' AND loaded IS NOT NULL AND NOT personal_card AND id NOT IN (SELECT request_id FROM matched)),
near AS (SELECT lone.id AS refuel_id, spare.id AS request_id FROM lone JOIN spare ON abs(lone.litres - spare.loaded) <= 0.5
         AND lone.t - spare.t BETWEEN INTERVAL '-30' MINUTE AND INTERVAL '180' MINUTE),
context_pairs AS (SELECT refuel_id, request_id FROM matched UNION ALL
  SELECT refuel_id, request_id FROM (SELECT *, count(*) OVER (PARTITION BY refuel_id) AS n, count(*) OVER (PARTITION BY request_id) AS m FROM near)
  WHERE n = 1 AND m = 1)"""
CONTEXT = f"{OPTIMAL},\n{UNIQUE}"
GREEDY = f"""
f AS (SELECT {NORM.format(c='plate')} AS p, cast(date as date) AS d, id, epoch(cast(date || ' ' || coalesce(time, '00:00:00') as timestamp)) AS s
      FROM refuel WHERE coalesce(id_type <> 'DNI', true) AND plate IS NOT NULL),
q AS (SELECT {NORM.format(c='plate')} AS p, cast(strptime(date, '%d/%m/%Y') as date) AS d, id, epoch(strptime(date || ' ' || time, '%d/%m/%Y %H:%M:%S')) AS s
      FROM request WHERE station <> 'ESTACION AJENA' AND settled = 'SI' AND voided <> 'SI'),
turn AS (SELECT *, row_number() OVER (PARTITION BY p, d ORDER BY id) AS i FROM q),
list AS (SELECT p, d, i, turn.id AS request_id, list(f.id ORDER BY abs(f.s - turn.s), f.id) AS l FROM turn JOIN f USING (p, d) GROUP BY ALL),
walk(p, d, i, request_id, pick, used) AS (
  SELECT p, d, i, request_id, l[1], [l[1]] FROM list WHERE i = 1
  UNION ALL SELECT w.p, w.d, x.i, x.request_id, list_filter(x.l, lambda y: NOT list_contains(w.used, y))[1],
                   list_append(w.used, list_filter(x.l, lambda y: NOT list_contains(w.used, y))[1])
  FROM walk w JOIN list x ON x.p = w.p AND x.d = w.d AND x.i = w.i + 1),
daily_pairs AS (SELECT pick AS refuel_id, request_id FROM walk WHERE pick IS NOT NULL)"""
UNSERVED = "station <> 'ESTACION AJENA' AND settled = 'SI' AND voided <> 'SI'"


@query("jn10_candidate_pairs", MATCH_VIEWS, f"WITH {KEYED} SELECT refuel_id, request_id, round(cost, 6) AS cost FROM pairs")
def _(x: Inputs):
    left = matching.keyed_refuels(refuels(x), x.view("vehicle")).select(
        F.col("id").alias("refuel_id"), F.col("instant").alias("at"), "litres", "match_key")
    right = matching.keyed_requests(requests(x)).filter(F.col("loaded").isNotNull()).select(
        F.col("id").alias("request_id"), F.col("instant").alias("asked"), "loaded", "is_voided", "match_key")
    joined = matching.bucketed_range_join(left, right, "at", "asked", ["match_key"], -1800, 10800)
    minutes = (F.unix_micros("at") - F.unix_micros("asked")) / 60e6
    cost = matching.pair_cost(minutes, F.col("litres"), F.col("loaded"), F.col("is_voided"))
    return joined.select("refuel_id", "request_id", F.round(cost, 6).alias("cost"))


@query("jn10_optimal_match", MATCH_VIEWS, f"WITH RECURSIVE {OPTIMAL} SELECT refuel_id, request_id FROM matched")
def _(x: Inputs):
    return matching.optimal_pairs(matching.keyed_refuels(refuels(x), x.view("vehicle")), matching.keyed_requests(requests(x)))


@query("jn10_match_components", MATCH_VIEWS, f"""WITH {KEYED},
e AS (SELECT k, id, 'refuel' AS kind, epoch(t) - 10800 AS s, epoch(t) + 1800 AS f FROM a WHERE k IS NOT NULL
      UNION ALL SELECT k, id, 'request', epoch(t), epoch(t) FROM b WHERE loaded IS NOT NULL),
m AS (SELECT *, max(f) OVER (PARTITION BY k ORDER BY s, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
SELECT k AS match_key, id, kind, cast(sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
       OVER (PARTITION BY k ORDER BY s, kind, id ROWS UNBOUNDED PRECEDING) as bigint) AS component FROM m""")
def _(x: Inputs):
    rows = matching.match_components(matching.keyed_refuels(refuels(x), x.view("vehicle")), matching.keyed_requests(requests(x)))
    return rows.select("match_key", "id", "kind", "component")


@query("jn11_unique_pairs", MATCH_VIEWS, f"""WITH {LINK_CTES},
u AS (SELECT id, litres, cast(date || ' ' || coalesce(time, '00:00:00') as timestamp) AS t FROM ({link_sql('refuel')})
      WHERE link_tier IS NULL),
q AS (SELECT id, loaded, strptime(date || ' ' || time, '%d/%m/%Y %H:%M:%S') AS t FROM request
      WHERE station <> 'ESTACION AJENA' AND loaded IS NOT NULL),
p AS (SELECT u.id AS refuel_id, q.id AS request_id FROM u JOIN q ON abs(u.litres - q.loaded) <= 0.5
      AND u.t - q.t BETWEEN INTERVAL '-30' MINUTE AND INTERVAL '180' MINUTE),
c AS (SELECT *, count(*) OVER (PARTITION BY refuel_id) AS n, count(*) OVER (PARTITION BY request_id) AS m FROM p)
SELECT refuel_id, request_id FROM c WHERE n = 1 AND m = 1""")
def _(x: Inputs):
    from tallyhound.operators.linkage import cumulative_links

    left = cumulative_links(refuels(x), "plate", x.view("vehicle")).filter(~F.col("link_engine"))
    return matching.unique_pairs(left, matching.keyed_requests(requests(x)))


@query("jn09_greedy_day_match", ["refuel", "request"], f"WITH RECURSIVE {GREEDY} SELECT refuel_id, request_id FROM daily_pairs")
def _(x: Inputs):
    return matching.greedy_day_pairs(refuels(x), requests(x))


@query("r13n_naive_match", ["refuel", "request"], f"""WITH RECURSIVE {GREEDY}
SELECT {alert_sql('CARGA_SIN_REGISTRO', 'cruce_por_dominio_y_dia')} FROM refuel WHERE id NOT IN (SELECT refuel_id FROM daily_pairs)
UNION ALL SELECT {alert_sql('RENDIDA_SIN_CARGA', 'cruce_por_dominio_y_dia')} FROM request
WHERE {UNSERVED} AND id NOT IN (SELECT request_id FROM daily_pairs)""")
def _(x: Inputs):
    a, b = refuels(x), requests(x)
    return plain(request_rules.naive_match(a, b, settle(matching.greedy_day_pairs(a, b))))


@query("jn12_matched_refuels", MATCH_VIEWS, f"""WITH RECURSIVE {CONTEXT}
SELECT r.id, r.litres, p.request_id, q.voided = 'SI' AS request_voided, q.settled = 'SI' AS request_settled,
       cast(q.loaded as double) AS request_litres, cast(q.authorised as double) AS request_authorised
FROM refuel r LEFT JOIN context_pairs p ON p.refuel_id = r.id LEFT JOIN request q ON q.id = p.request_id""")
def _(x: Inputs):
    a, b = refuels(x), requests(x)
    return matching.matched_refuels(a, b, matching.context_pairs(a, b, x.view("vehicle")))


@query("r13c_context_match", MATCH_VIEWS, f"""WITH RECURSIVE {CONTEXT},
x AS (SELECT r.id, r.litres, p.request_id, q.voided, q.loaded, q.authorised
      FROM refuel r LEFT JOIN context_pairs p ON p.refuel_id = r.id LEFT JOIN request q ON q.id = p.request_id)
SELECT {alert_sql('CARGA_SIN_REGISTRO', 'carga_sin_registro')} FROM x WHERE request_id IS NULL
UNION ALL SELECT {alert_sql('ANULADA_CON_CARGA', 'carga_de_registro_anulado')} FROM x WHERE voided = 'SI'
UNION ALL SELECT {alert_sql('DESACUERDO_DE_LITROS', 'desacuerdo_de_litros', measure='round(abs(loaded - litres), 4)')} FROM x WHERE abs(loaded - litres) > 0.5
UNION ALL SELECT {alert_sql('CARGA_SUPERA_AUTORIZADO', 'supera_autorizado_con_tolerancia', measure='round(litres, 4)')} FROM x WHERE litres > authorised * 1.05
UNION ALL SELECT {alert_sql('RENDIDA_SIN_CARGA', 'rendida_sin_carga')} FROM request
WHERE {UNSERVED} AND id NOT IN (SELECT request_id FROM context_pairs)""")
def _(x: Inputs):
    a, b = refuels(x), requests(x)
    pairs = settle(matching.context_pairs(a, b, x.view("vehicle")))
    return plain(request_rules.context_match(a, b, pairs))
