"""Sequence, daily and place queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.operators import daily, linkage, sequence
from tallyhound.operators.prepare import off_network_refuels
from tallyhound.operators.rules import charges, efficiency, odometer, place
from tallyhound.plans.queries_ledger import plain
from tallyhound.plans.queries_links import alert_sql, refuels
from tallyhound.plans.registry import Inputs, query

# The sequence of readings in the oracle; {source} gives id, vehicle_id, date, at, odometer, off_network, exempt.
SEQ = """
src AS ({source}),
lagged AS (SELECT *, lag(odometer) OVER w AS p0 FROM src WINDOW w AS (PARTITION BY vehicle_id ORDER BY moment, id)),
kept AS (SELECT * FROM lagged {skip}),
seq0 AS (SELECT *, lag(odometer) OVER w AS previous, lag(odometer, 2) OVER w AS previous2, lead(odometer) OVER w AS following,
                lag(date) OVER w AS pdate, lag(exempt) OVER w AS pexempt
         FROM kept WINDOW w AS (PARTITION BY vehicle_id ORDER BY moment, id)),
seq1 AS (SELECT *, odometer - previous AS km, datediff('day', pdate, date) AS days FROM seq0),
seq AS (SELECT *, median(CASE WHEN days > 0 THEN greatest(km, 0) / days END) OVER (PARTITION BY vehicle_id) AS rate,
               coalesce(pexempt, false) AND previous2 IS NOT NULL AS after_exempt FROM seq1)"""
OWN = """SELECT id, vehicle_id, cast(date as date) AS date, cast(date || ' ' || coalesce(time, '00:00:00') as timestamp) AS moment,
       cast(odometer as double) AS odometer, false AS off_network, {exempt} AS exempt FROM refuel
       WHERE odometer IS NOT NULL AND vehicle_id IS NOT NULL"""
OFF = """SELECT concat('FUERA-', id), vehicle_id, strptime(date, '%d/%m/%Y')::date,
       strptime(date || ' ' || time, '%d/%m/%Y %H:%M:%S'), cast(odometer as double), true, false FROM request
       WHERE station = 'ESTACION AJENA' AND settled = 'SI' AND voided <> 'SI'"""
EXEMPT = """(EXISTS (SELECT 1 FROM vehicle v JOIN exemption e ON upper(e.plate) = v.plate WHERE v.vehicle_id = refuel.vehicle_id
       AND cast(refuel.date as date) BETWEEN e.date_from AND e.date_to))"""
TYPO = """(coalesce(km < 0 AND following >= previous AND abs(previous - odometer) > 500, false)
       OR coalesce(km < 0 AND previous2 <= odometer AND abs(previous - odometer) > 500, false)
       OR coalesce(km > 0 AND following < odometer, false) OR coalesce(km > 0 AND previous < previous2, false))"""
PLAIN_SEQ = SEQ.format(source=OWN.format(exempt="false"), skip="")
FULL_SEQ = SEQ.format(source=OWN.format(exempt=EXEMPT) + " UNION ALL " + OFF, skip="WHERE p0 IS NULL OR p0 <> odometer")
REPEAT_SEQ = SEQ.format(source=OWN.format(exempt=EXEMPT) + " UNION ALL " + OFF, skip="")
CONTEXT = ["refuel", "request", "vehicle", "exemption"]


def exempt(x: Inputs):
    return linkage.exempt_refuels(refuels(x), x.view("vehicle"), x.view("exemption"))


def own_sequence(x: Inputs):
    return sequence.odometer_sequence(refuels(x))


def full_sequence(x: Inputs, skip_repeats: bool = True):
    return sequence.odometer_sequence(refuels(x), off_network=off_network_refuels(x.view("request")),
                                      skip_repeats=skip_repeats, exempt=exempt(x))


@query("win01_odometer_sequence", ["refuel"], f"""WITH {PLAIN_SEQ}
SELECT id, vehicle_id, km, cast(days as int) AS days, round(rate, 6) AS km_per_day, previous2, following
FROM seq WHERE km IS NOT NULL""")
def _(x: Inputs):
    return own_sequence(x).select("id", "vehicle_id", "km", "days", F.round("km_per_day", 6).alias("km_per_day"),
                                  "previous2", "following")


@query("win01_full_sequence", CONTEXT, f"""WITH {FULL_SEQ}
SELECT id, vehicle_id, off_network, exempt, after_exempt, km, cast(days as int) AS days, round(rate * days, 4) AS expected_km
FROM seq WHERE km IS NOT NULL""")
def _(x: Inputs):
    return full_sequence(x).select("id", "vehicle_id", "off_network", "exempt", "after_exempt", "km", "days",
                                   F.round("expected_km", 4).alias("expected_km"))


_KIND = "CASE WHEN km > -1000 THEN 'ODOMETRO_REGRESIVO_LEVE' ELSE 'ODOMETRO_REGRESIVO' END AS anomaly_type"


@query("r05n_odometer_decreases", ["refuel"], f"""WITH {PLAIN_SEQ}
SELECT id AS record_id, {_KIND}, 'odometro_disminuye' AS rule, km AS measure FROM seq WHERE km < 0""")
def _(x: Inputs):
    return plain(odometer.decreases(own_sequence(x)))


@query("r05c_decrease_in_context", CONTEXT, f"""WITH {FULL_SEQ}
SELECT id AS record_id, {_KIND}, 'retroceso_con_contexto' AS rule, km AS measure FROM seq
WHERE km < 0 AND odometer >= 10000 AND NOT {TYPO} AND NOT off_network AND NOT exempt""")
def _(x: Inputs):
    return plain(odometer.decreases_in_context(full_sequence(x)))


@query("r06n_jump_fixed", ["refuel"], f"""WITH {PLAIN_SEQ}
SELECT {alert_sql('ODOMETRO_SALTO', 'salto_umbral_fijo', measure='km')} FROM seq WHERE km > 500 AND days <= 7""")
def _(x: Inputs):
    return plain(odometer.jump_fixed(own_sequence(x)))


@query("r06h_jump_by_history", ["refuel"], f"""WITH {PLAIN_SEQ}
SELECT {alert_sql('ODOMETRO_SALTO', 'salto_historial_vehiculo', measure='round(km - rate * days, 4)')} FROM seq
WHERE km - rate * days > 1000""")
def _(x: Inputs):
    return plain(odometer.jump_by_history(own_sequence(x)))


@query("r07_reading_typos", ["refuel"], f"WITH {PLAIN_SEQ} SELECT id, km FROM seq WHERE km IS NOT NULL AND {TYPO}")
def _(x: Inputs):
    return own_sequence(x).filter(sequence.is_reading_typo()).select("id", "km")


_SHAPE = """CASE WHEN coalesce(previous2 <= odometer AND abs(previous - odometer) > 500, false) THEN 'tras_un_salto'
       WHEN coalesce(following >= previous AND abs(previous - odometer) > 500, false) THEN 'lectura_baja_aislada'
       ELSE 'otro' END"""


@query("r08_regression_shapes", ["refuel"], f"""WITH {PLAIN_SEQ}
SELECT id, {_SHAPE} AS shape, CASE WHEN {_SHAPE} <> 'otro' THEN {_SHAPE} WHEN NOT abs(previous - odometer) > 500 THEN 'leve'
       WHEN following IS NULL OR previous2 IS NULL THEN 'sin_vecinos' WHEN following < previous THEN 'se_queda_abajo'
       ELSE 'otro_patron' END AS sub_shape FROM seq WHERE km < 0""")
def _(x: Inputs):
    return sequence.regression_shapes(own_sequence(x)).select("id", "shape", "sub_shape")


_STILL = "ODOMETRO_SIN_AVANCE"


@query("r17n_no_advance", ["refuel"], f"WITH {PLAIN_SEQ} SELECT {alert_sql(_STILL, 'odometro_sin_avance')} FROM seq WHERE km = 0")
def _(x: Inputs):
    return plain(odometer.no_advance(own_sequence(x)))


@query("r17s_small_advance", ["refuel", "vehicle"], f"""WITH {PLAIN_SEQ}
SELECT {alert_sql(_STILL, 'avance_menor_a_5_km', measure='km')} FROM seq s
WHERE km >= 0 AND km < 5 AND NOT EXISTS (SELECT 1 FROM vehicle v WHERE v.vehicle_id = s.vehicle_id AND odometer_exempt = 'SI'
      AND s.date <= strptime(exempt_until, '%d/%m/%Y'))""")
def _(x: Inputs):
    return plain(odometer.small_advance(own_sequence(x), linkage.exempt_refuels(refuels(x), x.view("vehicle"))))


@query("r17c_no_advance_without_exemption", CONTEXT, f"""WITH {REPEAT_SEQ}
SELECT {alert_sql(_STILL, 'sin_avance_sin_excepcion')} FROM seq WHERE km = 0 AND days > 0 AND NOT exempt AND NOT off_network""")
def _(x: Inputs):
    return plain(odometer.no_advance_without_exemption(full_sequence(x, skip_repeats=False)))


# Days in the oracle, over refuels of the report and of other networks.
DAYS = """
base AS (SELECT id, vehicle_id, cast(date as date) AS date, litres, cast(odometer as double) AS odometer, false AS off FROM refuel
         WHERE vehicle_id IS NOT NULL
         UNION ALL SELECT concat('FUERA-', id), vehicle_id, strptime(date, '%d/%m/%Y')::date, coalesce(loaded, authorised),
                cast(odometer as double), true FROM request
         WHERE station = 'ESTACION AJENA' AND settled = 'SI' AND voided <> 'SI'),
d0 AS (SELECT vehicle_id, date, sum(litres) AS litres, count(*) AS refuels, max(odometer) AS odometer,
              count(*) FILTER (WHERE NOT off) AS own FROM base GROUP BY 1, 2),
d1 AS (SELECT *, lag(date) OVER w AS previous_day,
              odometer - last_value(odometer IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS odometer_km
       FROM d0 WINDOW w AS (PARTITION BY vehicle_id ORDER BY date)),
d2 AS (SELECT d.*, v.tank_capacity, v.vehicle_type, v.plate,
              CASE WHEN odometer_km >= 0 THEN odometer_km / nullif(litres, 0) END AS orate
       FROM d1 d LEFT JOIN vehicle v ON v.vehicle_id = d.vehicle_id),
tr AS (SELECT d.vehicle_id, d.date, coalesce(sum(t.km), 0) AS km, count(t.km) AS n FROM d2 d
       LEFT JOIN daily_track t ON t.plate = d.plate AND t.date > d.previous_day AND t.date <= d.date GROUP BY 1, 2),
d3 AS (SELECT d.*, CASE WHEN previous_day IS NOT NULL AND EXISTS (SELECT 1 FROM daily_track t WHERE t.plate = d.plate)
              AND d.date <= (SELECT max(date) FROM daily_track) THEN tr.km END AS track_km,
              tr.n = datediff('day', previous_day, d.date) AS full_track
       FROM d2 d JOIN tr ON tr.vehicle_id = d.vehicle_id AND tr.date = d.date),
d4 AS (SELECT *, coalesce(track_km IS NOT NULL AND full_track, false) AS track_complete,
              CASE WHEN track_km IS NOT NULL AND full_track THEN track_km / nullif(litres, 0) END AS trate FROM d3),
days AS (SELECT *, orate / nullif(median(orate) OVER (PARTITION BY vehicle_id), 0) AS orel,
                trate / nullif(median(trate) OVER (PARTITION BY vehicle_id), 0) AS trel,
                orate / nullif(median(orate) OVER (PARTITION BY vehicle_type), 0) AS otype,
                trate / nullif(median(trate) OVER (PARTITION BY vehicle_type), 0) AS ttype FROM d4),
own_days AS (SELECT * FROM days WHERE own > 0),
mem AS (SELECT r.id, o.* FROM refuel r JOIN own_days o ON o.vehicle_id = r.vehicle_id AND o.date = cast(r.date as date))"""
DAY_VIEWS = ["refuel", "request", "vehicle", "daily_track"]


def days(x: Inputs):
    return daily.daily_refuels(refuels(x), x.view("vehicle"), tracks=x.view("daily_track"),
                               off_network=off_network_refuels(x.view("request")))


@query("ag01_daily_refuels", DAY_VIEWS, f"""WITH {DAYS}
SELECT vehicle_id, date, round(litres, 4) AS litres, refuels, odometer_km, round(orate, 6) AS odometer_rate,
       round(orel, 4) AS odometer_relative, round(otype, 4) AS odometer_vs_type, track_km, track_complete,
       round(trel, 4) AS track_relative, round(ttype, 4) AS track_vs_type FROM own_days""")
def _(x: Inputs):
    return days(x).select(
        "vehicle_id", "date", F.round("litres", 4).alias("litres"), "refuels", "odometer_km",
        F.round("odometer_rate", 6).alias("odometer_rate"), F.round("odometer_relative", 4).alias("odometer_relative"),
        F.round("odometer_vs_type", 4).alias("odometer_vs_type"), "track_km", "track_complete",
        F.round("track_relative", 4).alias("track_relative"), F.round("track_vs_type", 4).alias("track_vs_type"))


@query("ag11_enriched_refuels", DAY_VIEWS, f"""WITH {PLAIN_SEQ}, {DAYS}
SELECT r.id, v.vehicle_type, v.tank_capacity, v.fuel, round(r.litres / v.tank_capacity, 6) AS tank_share, substr(r.date, 1, 7) AS month,
       ['Domingo', 'Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado'][dayofweek(cast(r.date as date)) + 1] AS weekday,
       cast(substr(r.time, 1, 2) as integer) AS hour, nullif(s.km, 0) AS km, o.own AS refuels_that_day,
       round(coalesce(o.trate, o.orate), 6) AS km_per_litre, round(coalesce(o.trel, o.orel), 4) AS relative_rate
FROM refuel r LEFT JOIN vehicle v ON v.vehicle_id = r.vehicle_id LEFT JOIN (SELECT id, km FROM seq WHERE km IS NOT NULL) s ON s.id = r.id
LEFT JOIN own_days o ON o.vehicle_id = r.vehicle_id AND o.date = cast(r.date as date)""")
def _(x: Inputs):
    from tallyhound.operators.eda import enriched_refuels

    out = enriched_refuels(refuels(x), x.view("vehicle"), own_sequence(x), days(x))
    return out.select("id", "vehicle_type", "tank_capacity", "fuel", F.round("tank_share", 6).alias("tank_share"), "month", "weekday", "hour", "km",
                      "refuels_that_day", F.round("km_per_litre", 6).alias("km_per_litre"), F.round("relative_rate", 4).alias("relative_rate"))


@query("r06c_jump_in_context", [*CONTEXT, "daily_track"], f"""WITH {FULL_SEQ}, {DAYS}
SELECT {alert_sql('ODOMETRO_SALTO', 'salto_con_contexto', 's.id', 'round(km - rate * s.days, 4)')} FROM seq s
LEFT JOIN (SELECT id, track_km, track_complete FROM mem) m ON m.id = s.id
WHERE km - rate * s.days > 1000 AND NOT {TYPO} AND NOT off_network AND NOT exempt AND NOT after_exempt
  AND NOT coalesce(track_complete AND km - track_km <= 1000, false)""")
def _(x: Inputs):
    tracked = daily.tracked_intervals(refuels(x), days(x))
    return plain(odometer.jump_in_context(full_sequence(x), tracked))


_SPLIT = "refuels >= 2 AND litres > tank_capacity * 1.05"


@query("r09n_split_tank", DAY_VIEWS, f"""WITH {DAYS}
SELECT {alert_sql('FRACCIONAMIENTO', 'fraccionamiento_diario', measure='round(litres / tank_capacity, 6)')} FROM mem WHERE {_SPLIT}""")
def _(x: Inputs):
    return plain(efficiency.split_tank(refuels(x), days(x)), 6)


@query("r09c_split_tank_without_distance", DAY_VIEWS, f"""WITH {DAYS}
SELECT {alert_sql('FRACCIONAMIENTO', 'fraccionamiento_sin_recorrido', measure='round(litres / tank_capacity, 6)')} FROM mem
WHERE {_SPLIT} AND NOT coalesce(coalesce(trel, orel) >= 0.75, false)""")
def _(x: Inputs):
    return plain(efficiency.split_tank(refuels(x), days(x), by_distance=True), 6)


@query("r09s_refuels_close_in_time", ["refuel"], f"""
WITH m AS (SELECT id, vehicle_id, epoch(cast(date || ' ' || coalesce(time, '00:00:00') as timestamp)) AS s FROM refuel
           WHERE vehicle_id IS NOT NULL),
n AS (SELECT *, least(s - lag(s) OVER w, lead(s) OVER w - s) AS gap FROM m WINDOW w AS (PARTITION BY vehicle_id ORDER BY s, id))
SELECT {alert_sql('FRACCIONAMIENTO', 'cargas_menos_de_6_horas', measure='gap')} FROM n WHERE gap < 21600""")
def _(x: Inputs):
    return plain(efficiency.refuels_close_in_time(refuels(x)))


@query("r10s_low_rate_by_type", [*DAY_VIEWS, "exemption"], f"""WITH {DAYS}
SELECT {alert_sql('CONSUMO_ATIPICO', 'rendimiento_fuente', measure='round(otype, 4)')} FROM mem
WHERE litres >= tank_capacity * 0.3 AND otype < 0.7 AND odometer_km <= 2000
  AND NOT EXISTS (SELECT 1 FROM refuel WHERE refuel.vehicle_id = mem.vehicle_id AND cast(refuel.date as date) = mem.date AND {EXEMPT})""")
def _(x: Inputs):
    return plain(efficiency.low_rate_by_type(refuels(x), days(x), without_reading=exempt(x)))


@query("r10c_low_rate_odometer", [*DAY_VIEWS, "exemption"], f"""WITH {DAYS}
SELECT {alert_sql('CONSUMO_ATIPICO', 'rendimiento_bajo_odometro', measure='round(orel, 4)')} FROM mem
WHERE litres >= tank_capacity * 0.3 AND orel < 0.32
  AND NOT EXISTS (SELECT 1 FROM refuel WHERE refuel.vehicle_id = mem.vehicle_id AND cast(refuel.date as date) = mem.date AND {EXEMPT})""")
def _(x: Inputs):
    return plain(efficiency.low_rate(refuels(x), days(x), "odometro", without_reading=exempt(x)))


@query("r10c_low_rate_track", DAY_VIEWS, f"""WITH {DAYS}
SELECT {alert_sql('CONSUMO_ATIPICO', 'rendimiento_bajo_gps', measure='round(coalesce(trel, orel), 4)')} FROM mem
WHERE litres >= tank_capacity * 0.3 AND coalesce(trel, orel) < 0.32
  AND NOT EXISTS (SELECT 1 FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id WHERE r.litres > v.tank_capacity
                  AND r.vehicle_id = mem.vehicle_id AND cast(r.date as date) = mem.date)""")
def _(x: Inputs):
    from tallyhound.operators.rules import volume

    explained = volume.over_tank(refuels(x), x.view("vehicle")).select(F.col("record_id").alias("id"))
    return plain(efficiency.low_rate(refuels(x), days(x), "gps", explained=explained))


_XY = "({lon}) * 111.32 * cos(radians(-34.65))", "({lat}) * 110.57"


@query("r12n_far_from_zone", ["refuel", "station"], f"""
WITH l AS (SELECT r.id, r.vehicle_id, s.lat, s.lon FROM refuel r JOIN station s ON s.code = r.station WHERE vehicle_id IS NOT NULL),
z AS (SELECT *, median(lat) OVER w AS zlat, median(lon) OVER w AS zlon FROM l WINDOW w AS (PARTITION BY vehicle_id)),
d AS (SELECT id, sqrt(pow((lon - zlon) * 111.32 * cos(radians(-34.65)), 2) + pow((lat - zlat) * 110.57, 2)) AS km FROM z)
SELECT {alert_sql('CARGA_FUERA_DE_ZONA', 'carga_lejos_de_base', measure='round(km, 4)')} FROM d WHERE km > 50""")
def _(x: Inputs):
    return plain(place.far_from_zone(refuels(x), x.view("station")))


@query("r12c_far_from_track", ["refuel", "station", "vehicle", "daily_track"], f"""
WITH j AS (SELECT r.id, lon * 111.32 * cos(radians(-34.65)) AS px, lat * 110.57 AS py,
                  lon0 * 111.32 * cos(radians(-34.65)) AS ax, lat0 * 110.57 AS ay,
                  lon1 * 111.32 * cos(radians(-34.65)) AS bx, lat1 * 110.57 AS by_
           FROM refuel r JOIN station s ON s.code = r.station JOIN vehicle v ON v.vehicle_id = r.vehicle_id
           JOIN daily_track t ON t.plate = v.plate AND t.date = cast(r.date as date)),
k AS (SELECT *, pow(bx - ax, 2) + pow(by_ - ay, 2) AS l2 FROM j),
t AS (SELECT *, CASE WHEN l2 > 0 THEN least(1, greatest(0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / l2)) ELSE 0 END AS u FROM k),
d AS (SELECT id, sqrt(pow(px - ax - u * (bx - ax), 2) + pow(py - ay - u * (by_ - ay), 2)) AS km FROM t)
SELECT {alert_sql('CARGA_FUERA_DE_ZONA', 'carga_lejos_del_gps', measure='round(km, 4)')} FROM d WHERE km > 50""")
def _(x: Inputs):
    return plain(place.far_from_track(refuels(x), x.view("vehicle"), x.view("station"), x.view("daily_track")))


@query("r18c_double_charges", ["refuel"], f"""
WITH m AS (SELECT *, epoch(cast(date || ' ' || coalesce(time, '00:00:00') as timestamp)) AS s FROM refuel WHERE vehicle_id IS NOT NULL),
p AS (SELECT a.id, round(abs(a.litres - b.litres), 6) <= round(0.02 * b.litres, 6) AS same,
             round(abs(a.litres / 10 - b.litres), 6) <= round(0.02 * b.litres, 6)
             OR round(abs(a.litres / 100 - b.litres), 6) <= round(0.02 * b.litres, 6)
             OR round(abs(a.litres / 0.1 - b.litres), 6) <= round(0.02 * b.litres, 6)
             OR round(abs(a.litres / 0.01 - b.litres), 6) <= round(0.02 * b.litres, 6) AS moved
      FROM m a JOIN m b ON a.vehicle_id = b.vehicle_id AND abs(a.s - b.s) < 43200
      WHERE a.origin = 'CONTINGENCIA' AND b.origin <> 'CONTINGENCIA')
SELECT {alert_sql('DOBLE_COBRO', 'doble_cobro', measure='CASE WHEN bool_or(same) THEN 0.0 ELSE 1.0 END::double')}
FROM p WHERE same OR moved GROUP BY id""")
def _(x: Inputs):
    return plain(charges.double_charges(refuels(x)))
