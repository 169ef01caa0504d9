"""Linkage, quality, volume and device queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.functions.text import normalise_id
from tallyhound.operators import linkage
from tallyhound.operators.prepare import off_network_refuels, typed_refuels, typed_requests
from tallyhound.operators.rules import devices, links, quality, volume
from tallyhound.plans.queries_ledger import plain
from tallyhound.plans.registry import Inputs, query


def refuels(x: Inputs):
    return typed_refuels(x.view("refuel"))


def requests(x: Inputs):
    return typed_requests(x.view("request"))


def alert_sql(kind: str, rule: str, record: str = "id", measure: str = "cast(NULL as double)") -> str:
    return f"{record} AS record_id, '{kind}' AS anomaly_type, '{rule}' AS rule, {measure} AS measure"


NORM = "upper(regexp_replace(cast({c} as varchar), '[\\s\\-_.]', '', 'g'))"

# Links of any identifier in the oracle: exact, normalised, unique engine suffix.
LINK_CTES = f"""
reg AS (SELECT plate AS raw, min(vehicle_id) AS v FROM vehicle WHERE plate <> '' GROUP BY 1),
regn AS (SELECT {NORM.format(c='plate')} AS n, min(vehicle_id) AS v FROM vehicle GROUP BY 1),
tails AS (SELECT vehicle_id, right({NORM.format(c='engine_number')}, 8) AS s FROM vehicle
          WHERE length({NORM.format(c='engine_number')}) >= 8
          UNION SELECT vehicle_id, right(regexp_replace(engine_number, '\\D', '', 'g'), 8) FROM vehicle
          WHERE length(regexp_replace(engine_number, '\\D', '', 'g')) >= 8),
suffix AS (SELECT s, min(vehicle_id) AS v FROM tails GROUP BY s HAVING count(DISTINCT vehicle_id) = 1)"""


def link_sql(source: str) -> str:
    return f"""
SELECT r.*, coalesce(e.v, n.v, m.v) AS linked_vehicle,
       CASE WHEN e.v IS NOT NULL THEN 'exacto' WHEN n.v IS NOT NULL THEN 'normalizado' WHEN m.v IS NOT NULL THEN 'motor' END
       AS link_tier
FROM {source} r LEFT JOIN reg e ON e.raw = r.plate LEFT JOIN regn n ON n.n = {NORM.format(c='r.plate')}
LEFT JOIN suffix m ON m.s = {NORM.format(c='r.plate')}"""


@query("prj01_normalised_names", [], f"SELECT c_custkey, {NORM.format(c='c_name')} AS norm FROM customer")
def _(x: Inputs):
    return x.table("customer").select("c_custkey", normalise_id(F.col("c_name")).alias("norm"))


@query("r01_exact_duplicates", ["refuel"], f"""
SELECT {alert_sql('DUPLICADO', 'duplicado_exacto')} FROM (
  SELECT id, row_number() OVER (PARTITION BY vehicle_id, plate, date, time, station, product, litres, unit_price, amount,
         card, driver, odometer, contract, id_type, origin ORDER BY id) AS n FROM refuel) WHERE n > 1""")
def _(x: Inputs):
    return plain(quality.exact_duplicates(x.view("refuel")))


@query("win10_duplicate_lines", [], """
SELECT l_orderkey, l_linenumber, l_partkey, count(*) - 1 AS copies FROM (
  SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY ALL HAVING count(*) > 1""")
def _(x: Inputs):
    lines = x.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        (F.count(F.lit(1)) - 1).alias("copies")).filter("copies > 0")


@query("r02_missing_mandatory", ["refuel"], " UNION ALL ".join(
    f"SELECT {alert_sql('VALOR_NULO', f'nulo_{c}')} FROM refuel WHERE {c} IS NULL" for c in quality.MANDATORY))
def _(x: Inputs):
    return plain(quality.missing_mandatory(x.view("refuel")))


@query("r03n_unknown_plate", ["refuel", "vehicle"], f"""
SELECT {alert_sql('DOMINIO_INVALIDO', 'dominio_sin_vinculo')} FROM refuel r
WHERE NOT EXISTS (SELECT 1 FROM vehicle v WHERE v.plate = r.plate)""")
def _(x: Inputs):
    return plain(links.unknown_plate(x.view("refuel"), x.view("vehicle")))


@query("r03n_unknown_plate_normalised", ["refuel", "vehicle"], f"""
SELECT {alert_sql('DOMINIO_INVALIDO', 'dominio_sin_vinculo_normalizado')} FROM refuel r
WHERE id_type <> 'DNI' AND NOT EXISTS (SELECT 1 FROM vehicle v WHERE {NORM.format(c='v.plate')} = {NORM.format(c='r.plate')})""")
def _(x: Inputs):
    return plain(links.unknown_plate(x.view("refuel"), x.view("vehicle"), normalised=True))


@query("jn03_link_tiers", ["refuel", "vehicle"], f"WITH {LINK_CTES} SELECT id, linked_vehicle, link_tier FROM ({link_sql('refuel')})")
def _(x: Inputs):
    return linkage.link_identifiers(x.view("refuel"), "plate", x.view("vehicle")).select("id", "linked_vehicle", "link_tier")


@query("jn04_refuel_links", ["refuel", "vehicle"], f"""WITH {LINK_CTES}
SELECT id, link_tier = 'exacto' IS TRUE AS link_exact, coalesce(link_tier IN ('exacto', 'normalizado'), false) AS link_normalised,
       link_tier IS NOT NULL AS link_engine,
       link_tier IS NOT NULL OR card IN (SELECT card FROM vehicle) AS link_card, id_type = 'DNI' AS personal
FROM ({link_sql('refuel')})""".replace("link_tier = 'exacto' IS TRUE", "coalesce(link_tier = 'exacto', false)"))
def _(x: Inputs):
    return linkage.refuel_links(x.view("refuel"), x.view("vehicle")).select(
        "id", "link_exact", "link_normalised", "link_engine", "link_card", "personal")


@query("r03c_unlinked_refuel", ["refuel", "vehicle"], f"""WITH {LINK_CTES}
SELECT {alert_sql('DOMINIO_INVALIDO', 'carga_sin_movil_identificado')} FROM ({link_sql('refuel')})
WHERE link_tier IS NULL AND id_type <> 'DNI' AND card NOT IN (SELECT card FROM vehicle)""")
def _(x: Inputs):
    return plain(links.unlinked_refuel(x.view("refuel"), x.view("vehicle")))


@query("r03c_unlinked_request", ["request", "vehicle"], f"""WITH {LINK_CTES}
SELECT {alert_sql('DOMINIO_INVALIDO', 'pedido_sin_movil_identificado')} FROM ({link_sql('request')}) q
WHERE link_tier IS NULL AND NOT EXISTS (SELECT 1 FROM vehicle v WHERE v.vehicle_id = q.vehicle_id)""")
def _(x: Inputs):
    return plain(links.unlinked_request(x.view("request"), x.view("vehicle")))


@query("r03c_unlinked_device", ["device", "vehicle"], f"""WITH {LINK_CTES}
SELECT {alert_sql('DOMINIO_INVALIDO', 'dispositivo_sin_movil_identificado', 'alias')} FROM ({link_sql('device')})
WHERE link_tier IS NULL AND device_group <> 'BAJA / REEMPLAZOS'""")
def _(x: Inputs):
    return plain(links.unlinked_device(x.view("device"), x.view("vehicle")))


@query("jn07_plate_typos", ["refuel", "vehicle"], f"""WITH {LINK_CTES},
c AS (SELECT r.id, {NORM.format(c='r.plate')} AS a, {NORM.format(c='v.plate')} AS b
      FROM ({link_sql('refuel')}) r JOIN vehicle v ON v.card = r.card
      WHERE (link_tier IS NULL OR link_tier = 'motor') AND id_type <> 'DNI'),
k AS (SELECT *, CASE
        WHEN length(a) = length(b) AND hamming(a, b) = 1 THEN
          CASE WHEN list_contains(['0O','O0','1I','I1','8B','B8'],
                 list_filter(list_transform(range(1, length(a) + 1), lambda i: a[i] || b[i]), lambda p: p[1] <> p[2])[1])
               THEN 'confusion_visual' ELSE 'letra_cambiada' END
        WHEN length(a) = length(b) AND list_bool_or(list_transform(range(1, length(a)),
             lambda i: a[i] <> a[i+1] AND a[:i-1] || a[i+1] || a[i] || a[i+2:] = b)) THEN 'transposicion'
        WHEN abs(length(a) - length(b)) = 1 AND levenshtein(a, b) = 1 THEN 'letra_de_mas_o_de_menos' END AS kind
      FROM c WHERE a IS NOT NULL)
SELECT id, a AS written_plate, b AS own_plate, kind AS edit_kind FROM k WHERE kind IS NOT NULL""")
def _(x: Inputs):
    return linkage.plate_typos(x.view("refuel"), x.view("vehicle"))


@query("jn06_one_edit_part_names", [], """
WITH n AS (SELECT DISTINCT replace(upper(p_brand || p_type), '#', '') AS c FROM part)
SELECT x.c AS code, y.c AS register_code FROM n x JOIN n y ON levenshtein(x.c, y.c) = 1
   OR (length(x.c) = length(y.c) AND hamming(x.c, y.c) = 2 AND levenshtein(x.c, y.c) = 2 AND damerau_levenshtein(x.c, y.c) = 1)""")
def _(x: Inputs):
    names = x.table("part").select(F.regexp_replace(F.upper(F.concat("p_brand", "p_type")), "#", "").alias("code")).distinct()
    return linkage.one_edit_matches(names, names.withColumnRenamed("code", "register_code")).select("code", "register_code")


@query("jn14_exempt_refuels", ["refuel", "vehicle", "exemption"], """
SELECT DISTINCT r.id FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id
JOIN exemption e ON upper(e.plate) = v.plate AND cast(r.date as date) BETWEEN e.date_from AND e.date_to""")
def _(x: Inputs):
    return linkage.exempt_refuels(refuels(x), x.view("vehicle"), x.view("exemption"))


@query("jn14_exempt_by_register", ["refuel", "vehicle"], """
SELECT r.id FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id
WHERE v.odometer_exempt = 'SI' AND cast(r.date as date) <= strptime(v.exempt_until, '%d/%m/%Y')""")
def _(x: Inputs):
    return linkage.exempt_refuels(refuels(x), x.view("vehicle"))


@query("r28_exemptions_in_force", ["exemption"], "SELECT id, plate, reason, date_from, date_to FROM exemption WHERE active = 'SI'")
def _(x: Inputs):
    return x.view("exemption").filter(F.col("active") == "SI").select("id", "plate", "reason", "date_from", "date_to")


@query("r04n_over_tank", ["refuel", "vehicle"], f"""
SELECT {alert_sql('EXCESO_VOLUMETRICO', 'litros_mayor_a_tanque', measure='round(litres, 4)')}
FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id WHERE litres > tank_capacity""")
def _(x: Inputs):
    return plain(volume.over_tank(x.view("refuel"), x.view("vehicle")))


@query("r04c_over_tank_with_history", ["refuel", "vehicle"], """
WITH d AS (SELECT r.*, tank_capacity, litres > tank_capacity * 1.02 AS excess,
                  row_number() OVER (PARTITION BY r.vehicle_id ORDER BY date, id) - 1 AS pos,
                  count(*) OVER (PARTITION BY r.vehicle_id) AS n
           FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id),
early AS (SELECT DISTINCT vehicle_id FROM d WHERE excess AND pos < greatest(n * 0.25, 1))
SELECT id AS record_id, CASE WHEN vehicle_id IN (SELECT vehicle_id FROM early) THEN 'CAPACIDAD_MAL_REGISTRADA'
       ELSE 'EXCESO_VOLUMETRICO' END AS anomaly_type, 'exceso_sin_antecedente' AS rule,
       CASE WHEN vehicle_id IN (SELECT vehicle_id FROM early) THEN 'capacidad_tanque_mal_registrada'
       ELSE 'sin_explicacion' END AS probable_cause, round(litres, 4) AS measure
FROM d WHERE excess""")
def _(x: Inputs):
    found = volume.over_tank_with_history(refuels(x), x.view("vehicle"))
    return found.select("record_id", "anomaly_type", "rule", "probable_cause", F.round("measure", 4).alias("measure"))


@query("r11_inactive_vehicle", ["refuel", "vehicle"], f"""
SELECT {alert_sql('CARGA_VEHICULO_INACTIVO', 'carga_vehiculo_inactivo',
                  measure="cast(datediff('day', state_date, cast(date as date)) as double)")}
FROM refuel r JOIN vehicle v ON v.vehicle_id = r.vehicle_id
WHERE state <> 'EN SERVICIO' AND cast(date as date) >= state_date""")
def _(x: Inputs):
    return plain(volume.inactive_vehicle(refuels(x), x.view("vehicle")))


@query("r16n_written_off_with_device", ["device", "vehicle"], f"""WITH {LINK_CTES}
SELECT {alert_sql('DISPOSITIVO_ACTIVO_EN_BAJA', 'baja_con_dispositivo', 'alias')} FROM ({link_sql('device')}) d
JOIN vehicle v ON v.vehicle_id = d.linked_vehicle WHERE v.state LIKE '%BAJA%'""")
def _(x: Inputs):
    return plain(devices.written_off_with_device(x.view("vehicle"), x.view("device")))


_ACTIVE = f"""WITH {LINK_CTES},
d AS (SELECT *, try_cast(last_contact as timestamp) AS seen FROM device)
SELECT alias AS record_id, 'DISPOSITIVO_ACTIVO_EN_BAJA' AS anomaly_type, 'dispositivo_activo_en_baja' AS rule,
       cast(floor((epoch((SELECT max(seen) FROM d)) - epoch(seen)) / 86400) as double) AS measure
FROM ({link_sql('d')}) l JOIN vehicle v ON v.vehicle_id = l.linked_vehicle
WHERE v.state LIKE '%BAJA%' AND (SELECT max(seen) FROM d) - seen <= INTERVAL '7' DAY"""


@query("r16c_active_device", ["device", "vehicle"], _ACTIVE)
def _(x: Inputs):
    return plain(devices.active_device(x.view("vehicle"), x.view("device")))


@query("r16c_unreadable_contact", ["device", "vehicle"], f"""WITH {LINK_CTES}
SELECT alias, device_group FROM ({link_sql('device')}) l JOIN vehicle v ON v.vehicle_id = l.linked_vehicle
WHERE v.state LIKE '%BAJA%' AND try_cast(last_contact as timestamp) IS NULL""")
def _(x: Inputs):
    return devices.written_off_unreadable(x.view("vehicle"), x.view("device")).select("alias", "device_group")


@query("r18n_fallback_refuels", ["refuel"], f"SELECT {alert_sql('DOBLE_COBRO', 'contingencia')} FROM refuel WHERE origin = 'CONTINGENCIA'")
def _(x: Inputs):
    from tallyhound.operators.rules import charges

    return plain(charges.fallback_refuels(x.view("refuel")))


@query("r19_off_network_refuels", ["request"], """
SELECT concat('FUERA-', id) AS id, vehicle_id, strptime(date, '%d/%m/%Y')::date AS date, cast(odometer as double) AS odometer,
       coalesce(loaded, authorised) AS litres FROM request
WHERE station = 'ESTACION AJENA' AND settled = 'SI' AND voided <> 'SI'""")
def _(x: Inputs):
    return off_network_refuels(x.view("request")).select("id", "vehicle_id", "date", "odometer", "litres")
