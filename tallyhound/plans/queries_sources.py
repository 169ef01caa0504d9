"""Source, load and integrity queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyhound.operators.settle import shared_folder
from tallyhound.plans.queries_links import LINK_CTES, NORM, link_sql
from tallyhound.plans.registry import Inputs, query
from tallyhound.sources import files, normalise, relational
from tallyhound.streaming.incremental import incremental_load


@query("src02_numeric_columns", [], """
SELECT 'c_acctbal' AS "column" UNION ALL SELECT 'c_custkey' UNION ALL SELECT 'c_nationkey'""")
def _(x: Inputs):
    text = x.table("customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.col("c_acctbal").cast("string").alias("c_acctbal"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"))
    names = files.numeric_columns(text)
    return x.spark.createDataFrame([(n,) for n in names], "column string")


def _stacked(x: Inputs, low: int, high: int):
    o = x.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    old = o.filter(F.col("o_orderkey") % 10 < low).withColumns({"_file": F.lit("old"), "_mtime": F.lit(1)})
    new = o.filter(F.col("o_orderkey") % 10 >= high).withColumns(
        {"o_totalprice": F.col("o_totalprice") + 1, "_file": F.lit("new"), "_mtime": F.lit(2)})
    return old.unionByName(new)


@query("src05_combined_batches", [], """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 >= 5 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, 'lotes' AS mode FROM orders""")
def _(x: Inputs):
    rows, mode = files.combine_files(_stacked(x, 7, 5))
    return rows.withColumn("mode", F.lit(mode))


@query("src05_newest_version", [], """
SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, 'versiones' AS mode FROM orders""")
def _(x: Inputs):
    rows, mode = files.combine_files(_stacked(x, 10, 0), key="o_orderkey")
    return rows.withColumn("mode", F.lit(mode))


def _raw(x: Inputs):
    r, v = x.view("refuel"), x.view("vehicle")
    report = r.select(
        F.concat_ws(" ", F.date_format(F.col("date").cast("date"), "dd/MM/yyyy"), F.coalesce("time", F.lit("00:00:00"))).alias("FECHA"),
        F.when(F.col("id_type") == "DNI", "Tarjeta DNI").otherwise("Patente").alias("TIPO IDENTIFICACION TARJETA"),
        F.coalesce("plate", F.concat(F.lit("DNI "), F.col("driver"))).alias("IDENTIFICACION TARJETA"), F.col("card").alias("TARJETA"),
        F.concat(F.lit("0001-"), F.substring("id", 2, 12)).alias("REMITO"), F.concat(F.col("station"), F.lit(" - NOMBRE")).alias("ESTABLECIMIENTO"),
        F.col("product").alias("PRODUCTO"), F.col("litres").cast("string").alias("LITROS UNIDADES"),
        F.col("unit_price").alias("PRECIO PVP ESTABLECIMIENTO"), F.col("amount").alias("IMP TOT PVP ESTABLECIMIENTO"),
        F.col("odometer").alias("ODOMETRO"), F.lower("origin").alias("ORIGEN DE TRANSACCION"))
    register = v.select(
        F.col("vehicle_id").alias("Matricula"), F.lower("plate").alias("Dominio"), F.col("tank_capacity").alias("CapacidadTanque"),
        F.concat(F.lit(" "), F.col("card")).alias("NumeroTarjeta"), F.lower("state").alias("Estado"), F.col("contract").alias("NumeroContrato"),
        F.col("engine_number").alias("NumeroMotor"))
    return {"report": report, "register": register, "wider": register.withColumn("Otra", F.lit(1))}


@query("src07_normalised_refuels", ["refuel", "vehicle"], f"""
WITH r AS (SELECT *, '0001-' || substr(id, 2, 12) AS receipt,
                  row_number() OVER (PARTITION BY substr(id, 2, 12) ORDER BY date, coalesce(time, '00:00:00'), litres, amount, card) AS n FROM refuel)
SELECT receipt || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS id, cast(coalesce(c.vehicle_id, p.vehicle_id) as varchar) AS vehicle_id, date,
       coalesce(time, '00:00:00') AS time, station, litres, odometer, id_type, origin
FROM r LEFT JOIN vehicle c ON c.card = r.card
LEFT JOIN vehicle p ON {NORM.format(c='p.plate')} = {NORM.format(c='r.plate')} AND r.id_type <> 'DNI'""")
def _(x: Inputs):
    data, _ = normalise.normalise_sources(_raw(x))
    return data["refuel"].select("id", "vehicle_id", "date", "time", "station", "litres", "odometer", "id_type", "origin")


@query("src07_diagnosis", ["refuel", "vehicle"], f"""
WITH l AS (SELECT r.*, coalesce(c.vehicle_id, p.vehicle_id) AS v FROM refuel r LEFT JOIN vehicle c ON c.card = r.card
           LEFT JOIN vehicle p ON {NORM.format(c='p.plate')} = {NORM.format(c='r.plate')} AND r.id_type <> 'DNI')
SELECT count(*) AS refuels, round_even(100.0 * count(v) / count(*), 1) AS with_vehicle_pct, round_even(100.0 * count(v) / count(*), 1) AS with_contract_pct,
       round_even(100.0 * count(*) FILTER (WHERE id_type = 'DNI') / count(*), 1) AS personal_pct,
       round_even(100.0 * count(*) FILTER (WHERE origin = 'CONTINGENCIA') / count(*), 1) AS fallback_pct FROM l""")
def _(x: Inputs):
    return normalise.normalise_sources(_raw(x))[1]


def data(x: Inputs):
    return {n: x.view(n) for n in ("vehicle", "refuel", "request", "device", "exemption", "daily_track", "contract", "transfer",
                                   "invoice", "invoice_line", "station")}


@query("src08_vehicle_states", ["vehicle"], """
SELECT vehicle_id, state, coalesce(state_date, DATE '1900-01-01') AS valid_from, cast(NULL as date) AS valid_to FROM vehicle
UNION ALL SELECT vehicle_id, 'EN SERVICIO', DATE '1900-01-01', state_date FROM vehicle WHERE state_date IS NOT NULL""")
def _(x: Inputs):
    return relational.relational_tables(data(x))["vehicle_state"]


@query("src08_cards", ["vehicle", "refuel"], """
SELECT card, 'VEHICULO' AS type, contract FROM vehicle
UNION ALL SELECT card, CASE WHEN bool_or(id_type = 'DNI') THEN 'PERSONAL' ELSE 'VEHICULO' END, min(contract) FROM refuel
WHERE card NOT IN (SELECT card FROM vehicle) GROUP BY card""")
def _(x: Inputs):
    return relational.relational_tables(data(x))["card"]


@query("src08_device_assignments", ["vehicle", "device"], """
SELECT alias, v.vehicle_id, DATE '1900-01-01' AS valid_from, cast(NULL as date) AS valid_to FROM device d LEFT JOIN vehicle v ON v.plate = d.plate""")
def _(x: Inputs):
    return relational.relational_tables(data(x))["device_assignment"]


@query("src09_lines_until", ["invoice_line"], """
SELECT line, number FROM invoice_line WHERE number IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-30')""")
def _(x: Inputs):
    invoices = x.table("orders").select(F.col("o_orderkey").alias("number"), F.to_date("o_orderdate").alias("date"))
    kept = relational.load_until({"invoice": invoices, "invoice_line": x.view("invoice_line")}, "1997-06-30")
    return kept["invoice_line"].select("line", "number")


@query("src10_upserted_orders", [], """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders""")
def _(x: Inputs):
    o = x.table("orders").select("o_orderkey", "o_totalprice")
    change = o.filter("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return relational.upsert(o.filter("o_orderkey % 10 <> 0"), change, ["o_orderkey"])


@query("jn18_integrity", ["refuel", "vehicle"], """
SELECT 'refuel' AS child, 'card' AS "column", 'register' AS parent, count(*) AS orphans FROM refuel WHERE card NOT IN (SELECT card FROM vehicle)
UNION ALL SELECT 'labels', 'doc_id', 'long', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 2000)""")
def _(x: Inputs):
    tables = {"lineitem": x.table("lineitem"), "orders": x.table("orders"), "customer": x.table("customer"), "nation": x.table("nation"),
              "refuel": x.view("refuel"), "register": x.view("vehicle"), "labels": x.table("labels"),
              "long": x.table("documents").filter("n_chars > 2000")}
    return relational.check_integrity(tables, [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"), ("refuel", "card", "register", "card"), ("labels", "doc_id", "long", "doc_id")])


@query("jn18_repeated_active_exemptions", [], """
SELECT o_custkey AS vehicle_id, count(*) AS active FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1""")
def _(x: Inputs):
    rows = x.table("orders").select(F.col("o_custkey").alias("vehicle_id"), F.when(F.col("o_orderstatus") == "P", "SI").otherwise("NO").alias("active"))
    return relational.repeated_active_exemptions(rows)


@query("r27_written_off_active", ["vehicle", "device"], """
WITH d AS (SELECT *, try_cast(last_contact as timestamp) AS seen FROM device)
SELECT v.vehicle_id, v.plate, state, alias, device_group, last_contact FROM vehicle v JOIN d ON d.plate = v.plate
WHERE state LIKE '%BAJA%' AND (SELECT max(seen) FROM d) - seen <= INTERVAL '7' DAY""")
def _(x: Inputs):
    return relational.written_off_active(relational.relational_tables(data(x)))


@query("jn05_links_by_source", ["device", "vehicle"], f"""WITH {LINK_CTES}
SELECT coalesce(link_tier, 'ninguno') AS tier, count(*) AS n FROM ({link_sql('device')}) GROUP BY 1""")
def _(x: Inputs):
    from tallyhound.operators.linkage import link_identifiers

    linked = link_identifiers(x.view("device"), "plate", x.view("vehicle"))
    return linked.groupBy(F.coalesce("link_tier", F.lit("ninguno")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("st01_load_by_key", [], """
SELECT o_orderkey, o_custkey, o_totalprice + CASE WHEN o_orderkey % 10 IN (4, 5) THEN 2 WHEN o_orderkey % 10 >= 6 THEN 1 ELSE 0 END AS o_totalprice,
       CASE WHEN o_orderkey % 10 IN (4, 5) THEN 3 WHEN o_orderkey % 10 >= 6 THEN 2 ELSE 1 END AS version FROM orders""")
def _(x: Inputs):
    """All orders in three loads that overlap; the last one holds newer rows of some keys and late ones of others."""
    o, last = x.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), F.col("o_orderkey") % 10
    version = lambda rows, n: rows.withColumns({"o_totalprice": F.col("o_totalprice") + F.lit(n - 1), "version": F.lit(n)})
    late = version(o.filter(last.isin(4, 5)), 3).unionByName(version(o.filter(last >= 8), 1))
    store = relational.KeyedTables(x.spark, f"{shared_folder(x.spark)}/load-{uuid.uuid4().hex}")
    for i, rows in enumerate((version(o.filter(last < 7), 1), version(o.filter(last >= 5), 2), late)):
        store.load({"orders": rows}, f"load {i}", keys={"orders": ["o_orderkey"]}, order={"orders": ["version"]})
    return store.read("orders").select(*o.columns, "version")


@query("st01_incremental_load", [], "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def _(x: Inputs):
    """The customer files as a stream put in by key; the second run finds nothing new."""
    folder, columns = f"{shared_folder(x.spark)}/load-{uuid.uuid4().hex}", ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]
    store = relational.KeyedTables(x.spark, f"{folder}/tables")
    for _ in range(2):
        incremental_load(x.spark, f"{x.sf_dir}/customer.parquet*", x.table("customer").schema, store, "customer", f"{folder}/progress", key=["c_custkey"])
    return store.read("customer").select(*columns)
