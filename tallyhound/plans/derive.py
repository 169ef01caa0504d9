"""Fleet-shaped views over the general test tables, in SQL that Spark and the oracle both read.

Every view is written once and rendered for either engine, so both start from equal inputs. All of
them are per-row expressions of the large tables, or one aggregation, so they grow with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Plate of a vehicle key, and the last eight digits of its engine number (keys 30k and 30k+1 share them).
_PLATE = "concat('CU', lpad(cast({k} as string), 7, '0'))"
_ENGINE = "cast(40000000 + CASE WHEN {k} % 30 <= 1 THEN {k} - {k} % 30 ELSE {k} END as string)"
_DATE = "substr(cast({t} as string), 1, 10)"
_TIME = "substr(cast({t} as string), 12, 8)"

_REFUEL_FIELDS = f"""
    CASE WHEN event_id % 61 = 0 THEN NULL ELSE user_id END AS vehicle_id,
    CASE WHEN event_id % 43 = 0 THEN NULL
         WHEN event_id % 71 = 0 THEN concat('ZZ', lpad(cast(event_id as string), 9, '0'))
         WHEN event_id % 83 = 0 THEN {_ENGINE.format(k='user_id')}
         WHEN event_id % 53 = 0 THEN concat('G', substr({_PLATE.format(k='user_id')}, 2))
         WHEN event_id % 59 = 0 THEN concat('UC', substr({_PLATE.format(k='user_id')}, 3))
         WHEN event_id % 67 = 0 THEN substr({_PLATE.format(k='user_id')}, 2)
         WHEN event_id % 73 = 0 THEN concat('CUO', substr({_PLATE.format(k='user_id')}, 4))
         WHEN event_id % 11 = 0 THEN concat('cu-', lpad(cast(user_id as string), 7, '0'))
         WHEN event_id % 13 = 0 THEN concat('CU ', lpad(cast(user_id as string), 7, '0'))
         ELSE {_PLATE.format(k='user_id')} END AS plate,
    {_DATE.format(t='ts')} AS date,
    CASE WHEN event_id % 101 = 0 THEN NULL ELSE {_TIME.format(t='ts')} END AS time,
    CASE WHEN event_id % 37 = 0 THEN NULL
         ELSE lpad(cast((user_id % 3 + event_id % 19 * 7) % 40 as string), 4, '0') END AS station,
    CASE WHEN event_id % 3 = 0 THEN 'DIESEL' ELSE 'NAFTA' END AS product,
    value AS litres,
    cast(100 + user_id % 10 as double) AS unit_price,
    round(value * (100 + user_id % 10), 2) AS amount,
    CASE WHEN event_id % 47 = 0 THEN 'T900000000' ELSE concat('T', lpad(cast(user_id as string), 9, '0')) END AS card,
    CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('P', cast(event_id % 17 as string)) END AS driver,
    CASE WHEN event_id % 41 = 0 THEN NULL ELSE
         20000 + user_id * 37
         + CASE WHEN user_id % 10 = 3 THEN cast(floor(SECS(ts) / 172800) as bigint) * 300 - 2952000
                WHEN user_id % 10 = 4 THEN cast(floor(SECS(ts) / 600) as bigint) - 2838000
                ELSE cast(floor(SECS(ts) / 300) as bigint) - 5676000 END
         + CASE WHEN event_id % 97 = 0 THEN -3000 WHEN event_id % 89 = 0 THEN 5000
                WHEN event_id % 103 = 0 THEN -600 ELSE 0 END END AS odometer,
    cast(user_id % 25 as int) AS contract,
    CASE WHEN event_id % 43 = 0 THEN 'DNI' ELSE 'PATENTE' END AS id_type,
    CASE WHEN event_type = 'error' THEN 'CONTINGENCIA' ELSE 'POSNET' END AS origin"""

_REQUEST_FIELDS = f"""
    cast(user_id as bigint) AS vehicle_id,
    CASE WHEN event_id % 79 = 0 THEN concat('YY', cast(event_id as string))
         WHEN event_id % 7 = 0 THEN concat('cu.', lpad(cast(user_id as string), 7, '0'))
         ELSE {_PLATE.format(k='user_id')} END AS plate,
    concat(substr(cast(moment as string), 9, 2), '/', substr(cast(moment as string), 6, 2), '/', substr(cast(moment as string), 1, 4))
         AS date,
    {_TIME.format(t='moment')} AS time,
    20000 + user_id * 37 + cast(floor(SECS(moment) / 300) as bigint) - 5676000 AS odometer,
    concat('P', cast(event_id % 17 as string)) AS requester,
    event_id % 43 = 0 AS personal_card,
    value + event_id % 5 AS authorised,
    CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 10 = 0 THEN value + 2 ELSE value END AS loaded,
    CASE WHEN event_id % 6 = 0 THEN 'NO' ELSE 'SI' END AS settled,
    CASE WHEN event_id % 19 = 0 THEN 'SI' ELSE 'NO' END AS voided,
    CASE WHEN event_id % 9 = 0 THEN 'ESTACION AJENA' ELSE 'RED' END AS station"""

VIEWS: dict[str, str] = {
    "vehicle": f"""
SELECT c_custkey AS vehicle_id, {_PLATE.format(k='c_custkey')} AS plate,
       CASE WHEN c_acctbal >= 0 THEN 'EN SERVICIO' WHEN c_custkey % 2 = 0 THEN 'EN TRAMITE DE BAJA'
            ELSE 'FUERA DE SERVICIO' END AS state,
       CASE WHEN c_acctbal < 0 THEN cast('2024-01-10' as date) + cast(c_custkey % 15 as int) END AS state_date,
       c_mktsegment AS vehicle_type,
       CASE WHEN c_custkey % 3 = 0 THEN 'DIESEL' ELSE 'NAFTA' END AS fuel,
       cast(40 + c_custkey % 5 * 20 as double) AS tank_capacity,
       concat('MT-', {_ENGINE.format(k='c_custkey')}) AS engine_number,
       concat('T', lpad(cast(c_custkey as string), 9, '0')) AS card,
       cast(c_custkey % 25 as int) AS contract,
       CASE WHEN c_custkey % 8 = 0 THEN 'SI' ELSE 'NO' END AS odometer_exempt,
       CASE WHEN c_custkey % 8 = 0 THEN '20/01/2024' END AS exempt_until
FROM @customer""",
    "refuel": f"""
SELECT concat('R', lpad(cast(event_id as string), 12, '0')) AS id, {_REFUEL_FIELDS}
FROM @events WHERE event_type <> 'view'
UNION ALL
SELECT concat('X', lpad(cast(event_id as string), 12, '0')) AS id, {_REFUEL_FIELDS}
FROM @events WHERE event_type = 'purchase' AND event_id % 40 = 0""",
    "request": f"""
SELECT concat('S', lpad(cast(event_id as string), 12, '0')) AS id, {_REQUEST_FIELDS}
FROM (SELECT *, ts AS moment FROM @events WHERE event_type = 'view') v
UNION ALL
SELECT concat('Q', lpad(cast(event_id as string), 12, '0')) AS id, {_REQUEST_FIELDS}
FROM (SELECT *, ts - INTERVAL '75' MINUTE + (event_id % 9) * INTERVAL '10' MINUTE AS moment
      FROM @events WHERE event_type = 'purchase' AND event_id % 13 <> 0) p""",
    "station": """
SELECT lpad(cast(s_suppkey as string), 4, '0') AS code, s_name AS brand,
       cast(-34.9 + s_suppkey % 20 * 0.07 as double) AS lat, cast(-58.9 + s_suppkey % 13 * 0.09 as double) AS lon
FROM @supplier""",
    "daily_track": f"""
SELECT {_PLATE.format(k='user_id')} AS plate, cast(ts as date) AS date, cast(count(*) * 60 as double) AS km,
       cast(-34.9 + user_id % 20 * 0.07 as double) AS lat0, cast(-58.9 + user_id % 13 * 0.09 as double) AS lon0,
       cast(-34.8 + max(event_id) % 20 * 0.03 as double) AS lat1, cast(-58.8 + max(event_id) % 13 * 0.03 as double) AS lon1
FROM @events WHERE user_id % 4 <> 0 GROUP BY user_id, cast(ts as date)""",
    "exemption": f"""
SELECT concat('EXC-', lpad(cast(c_custkey as string), 7, '0')) AS id, lower({_PLATE.format(k='c_custkey')}) AS plate,
       'SENSOR' AS reason, CASE WHEN c_custkey % 14 = 0 THEN 'SI' ELSE 'NO' END AS active,
       cast('2024-01-05' as date) + cast(c_custkey % 9 as int) AS date_from,
       cast('2024-01-05' as date) + cast(c_custkey % 9 + c_custkey % 4 * 3 as int) AS date_to
FROM @customer WHERE c_custkey % 7 = 0 OR c_custkey % 10 = 3""",
    "device": f"""
SELECT concat('DEV-', lpad(cast(c_custkey as string), 7, '0')) AS alias,
       CASE WHEN c_custkey % 17 = 0 THEN concat('QQ', cast(c_custkey as string))
            WHEN c_custkey % 5 = 0 THEN concat('cu ', lpad(cast(c_custkey as string), 7, '0'))
            ELSE {_PLATE.format(k='c_custkey')} END AS plate,
       CASE WHEN c_custkey % 6 = 0 THEN 'BAJA / REEMPLAZOS' ELSE 'FLOTA' END AS device_group,
       CASE WHEN c_custkey % 23 = 0 THEN 'sin dato'
            ELSE concat(cast(cast('2024-01-30' as date) - cast(c_custkey % 20 as int) as string), ' 10:00:00') END AS last_contact
FROM @customer WHERE c_custkey % 3 <> 1""",
    "contract": "SELECT cast(n_nationkey as int) AS contract, cast(700000 + n_nationkey * 9000 as double) AS monthly_cap FROM @nation",
    "spend": """
SELECT o_orderkey AS id, cast(o_custkey % 25 as int) AS contract, cast(o_orderdate as date) AS date, o_totalprice AS amount
FROM @orders""",
    "transfer": """
SELECT concat('TR-', lpad(cast(o_orderkey as string), 9, '0')) AS id, cast(o_orderdate as date) AS date,
       cast(o_custkey % 25 as int) AS from_contract, cast((o_custkey + 1 + o_orderkey % 7) % 25 as int) AS to_contract,
       o_totalprice AS amount
FROM @orders WHERE o_orderkey % 12 = 0""",
    "invoice_line": """
SELECT concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
              cast(l_suppkey as string), '-', cast(cast(round(l_extendedprice * 100) as bigint) as string)) AS line,
       l_orderkey AS number,
       CASE WHEN l_partkey % 33 = 0 THEN -l_partkey - 1 ELSE l_partkey END AS refuel_ref,
       CASE WHEN l_linenumber = 7 AND l_partkey % 2 = 0 THEN 'LUBRICANTE' WHEN l_linenumber = 6 AND l_partkey % 3 = 0
            THEN 'AJUSTE' ELSE 'COMBUSTIBLE' END AS concept,
       l_quantity AS litres, (900 + l_partkey % 1000 / 10) * (0.97 + l_suppkey % 8 * 0.01) AS unit_price,
       l_extendedprice AS amount
FROM @lineitem""",
    "invoice": """
SELECT o_orderkey AS number, cast(o_custkey % 25 as int) AS contract,
       substr(cast(cast(o_orderdate as date) as string), 1, 7) AS period, o_orderpriority AS supplier,
       cast(coalesce(lines.total, 0) as double)
           * CASE WHEN o_orderkey % 50 = 0 THEN 1.03 WHEN o_orderkey % 51 = 0 THEN 0.99 ELSE 1 END AS total,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL
            ELSE cast(coalesce(lines.total, 0) as double) * CASE WHEN o_orderkey % 37 = 0 THEN 1.002 WHEN o_orderkey % 50 = 0
                 THEN 1.03 WHEN o_orderkey % 51 = 0 THEN 0.99 ELSE 1 END END AS pdf_total
FROM @orders LEFT JOIN
     (SELECT l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) AS total FROM @lineitem GROUP BY l_orderkey) lines
     ON l_orderkey = o_orderkey""",
    "truth": """
SELECT concat('R', lpad(cast(doc_id as string), 12, '0')) AS record_id,
       CASE WHEN doc_id % 3 = 0 THEN 'ODOMETRO_SALTO' WHEN doc_id % 3 = 1 THEN 'EXCESO_VOLUMETRICO'
            ELSE 'VALOR_NULO' END AS anomaly_type,
       CASE WHEN doc_id % 3 = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'lang' ELSE 'text' END END AS column_name
FROM @labels WHERE quality = 0""",
    "benign": "SELECT concat('R', lpad(cast(doc_id as string), 12, '0')) AS record_id, 'caso' AS case_name FROM @labels WHERE toxic = 1",
    "alert": """
SELECT concat('R', lpad(cast(doc_id as string), 12, '0')) AS record_id,
       CASE WHEN doc_id % 3 = 0 THEN 'ODOMETRO_SALTO' WHEN doc_id % 3 = 1 THEN 'EXCESO_VOLUMETRICO'
            ELSE 'VALOR_NULO' END AS anomaly_type,
       CASE WHEN doc_id % 3 = 0 THEN CASE WHEN n_chars > 2000 THEN 'salto_umbral_fijo' ELSE 'salto_con_contexto' END
            WHEN doc_id % 3 = 1 THEN CASE WHEN n_chars > 1500 THEN 'litros_mayor_a_tanque' ELSE 'exceso_sin_antecedente' END
            ELSE CASE WHEN doc_id % 2 = 0 THEN 'nulo_lang' ELSE 'nulo_text' END END AS rule
FROM @documents WHERE n_chars % 4 <> 0""",
}

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
           "embeddings", "pages", "benchmark", "labels", "conversations"]


def spark_sql(text: str, sf_dir: str) -> str:
    text = re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", text)
    return re.sub(r"SECS\((\w+)\)", r"unix_seconds(cast(\1 as timestamp))", text)


def oracle(text: str) -> str:
    text = re.sub(r"@(\w+)", r"\1", text)
    return re.sub(r"SECS\((\w+)\)", r"cast(floor(epoch(\1)) as bigint)", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    return spark.sql(spark_sql(VIEWS[name], sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(names: list[str], body: str, instead: dict[str, str] | None = None) -> str:
    """The oracle's SQL: the named views as common table expressions, then the body; ``instead`` gives other SQL for names."""
    shown = {n: oracle(VIEWS[n]) for n in names} | (instead or {})
    ctes = ",\n".join(f"{n} AS ({sql})" for n, sql in shown.items())
    body = body.strip()
    opening = next((o for o in ("WITH RECURSIVE", "WITH") if body.upper().startswith(o)), "")
    joined = f"{ctes},\n{body[len(opening):].lstrip()}" if opening else f"{ctes}\n{body}"
    return f"{opening or 'WITH'} {joined}" if shown else body
