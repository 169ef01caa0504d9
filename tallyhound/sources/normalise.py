"""Recognising raw exports by their columns and bringing them to the common schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions.bands import share
from tallyhound.functions.dates import parse_date_text
from tallyhound.functions.text import as_number, categorise, clean_text, digits_only, normalise_id
from tallyhound.operators.linkage import lookup
from tallyhound.operators.prepare import OFF_NETWORK
from tallyhound.operators.rules.links import DEPOT_GROUP
from tallyhound.operators.skew import OrderedGroups, first_by, per_heat

# The columns that identify each source, and the key words of claims and outcomes.
SIGNATURES = {
    "vehicle": {"Matricula", "Dominio", "CapacidadTanque", "NumeroTarjeta", "Estado"},
    "refuel": {"FECHA", "TIPO IDENTIFICACION TARJETA", "IDENTIFICACION TARJETA", "TARJETA", "REMITO", "ESTABLECIMIENTO",
               "PRODUCTO", "LITROS UNIDADES", "PRECIO PVP ESTABLECIMIENTO", "IMP TOT PVP ESTABLECIMIENTO", "ODOMETRO"},
    "request": {"Rendido", "Anulado", "LitrosAutorizados", "Solicitante", "Fecha", "Hora"},
    "device": {"Placa", "Grupo", "IMEI"},
    "invoice": {"numero", "numero_contrato", "monto_facturado"},
    "invoice_line": {"factura_id", "remito", "importe_yer"},
    "contract": {"numero", "limite"},
    "period": {"id", "fecha_inicio", "fecha_fin"},
    "exemption": {"patente", "motivo", "activo", "fecha_hasta"},
    "claim": {"tipo_alerta", "estado_reclamo", "monto_reclamable", "nro_ticket"},
    "observation": {"id_registro", "regla", "resultado", "observacion"},
}
CLAIM_TYPES = {"doble_cobro": ["doble", "duplicidad"], "cargas_multiples": ["multiple"], "odometro_estancado": ["odometro"]}
CLAIM_STATES = {"pendiente": ["pend"], "en_disputa": ["disput"], "nota_de_credito": ["nota", "credito"], "rechazado": ["rechaz"]}
OUTCOMES = {"error_humano": ["error", "humano"], "facturacion_del_proveedor": ["factur", "proveedor"], "faltante": ["faltante"],
            "sin_irregularidad": ["sin_irreg", "sin irreg"], "pendiente": ["pend"]}
NO_END = "2100-01-01"
ALWAYS = "1900-01-01"


def recognise_source(tables: dict[str, DataFrame], source: str) -> DataFrame | None:
    """The table with a source's columns; among several the one with the fewest, the rawest."""
    hits = [(len(df.columns), name) for name, df in tables.items() if SIGNATURES[source] <= set(df.columns)]
    return tables[min(hits)[1]] if hits else None


def _optional(df: DataFrame, column: str) -> Column:
    return F.col(f"`{column}`").cast("string") if column in df.columns else F.lit(None).cast("string")


def vehicles_of(raw: DataFrame) -> DataFrame:
    capacity = as_number(F.col("CapacidadTanque"))
    out = raw.select(
        clean_text(F.col("Matricula")).alias("vehicle_id"), clean_text(F.col("Dominio")).alias("plate"),
        F.upper(F.trim("Estado")).alias("state"), F.lit(None).cast("date").alias("state_date"),
        _optional(raw, "TipoVehiculo").alias("vehicle_type"),
        _optional(raw, "TipoCombustible").alias("fuel"), F.when(capacity > 0, capacity).alias("tank_capacity"),
        clean_text(F.col("NumeroTarjeta")).alias("card"), as_number(_optional(raw, "NumeroContrato")).cast("long").alias("contract"),
        clean_text(_optional(raw, "NumeroMotor")).alias("engine_number"),
        _optional(raw, "ExcepcionOdometro").alias("odometer_exempt"),
        _optional(raw, "FechaHastaExcepcionOdometro").alias("exempt_until"),
    ).filter(F.col("vehicle_id").isNotNull())
    return first_by(out, ["vehicle_id"], ["plate", "card"])


def number_repeats(rows: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Adds ``id``: ``R``, ``R#2``, ``R#3`` tell repeated receipts apart in order of time; none without a receipt."""
    told = rows.filter(F.col("receipt").isNotNull()).withColumn("__at", F.coalesce("at", F.timestamp_seconds(F.lit(0))))
    groups = OrderedGroups(["receipt"], ["__at", "litres", "amount", "card"])

    def count(part: DataFrame, hot: bool) -> DataFrame:
        return groups.running(part, {"__n": ("sum", F.lit(1), True)}, hot)

    numbered = per_heat(told, ["receipt"], count, hot_rows)
    suffix = F.when(F.col("__n") > 1, F.concat(F.lit("#"), F.col("__n").cast("string"))).otherwise("")
    return numbered.withColumn("id", F.concat("receipt", suffix)).drop("__n", "__at").unionByName(
        rows.filter(F.col("receipt").isNull()).withColumn("id", F.lit(None).cast("string")))


def refuels_of(raw: DataFrame, vehicles: DataFrame) -> DataFrame:
    """The supplier's report; the vehicle is that of the card, else that of the plate."""
    at = F.try_to_timestamp(F.trim("FECHA"), F.lit("dd/MM/yyyy HH:mm:ss"))
    person = F.coalesce(F.upper("TIPO IDENTIFICACION TARJETA").contains("DNI"), F.lit(False))
    told = clean_text(F.col("IDENTIFICACION TARJETA"))
    driver = _optional(raw, "NRO IDENTIFICACION CONDUCTOR")
    rows = raw.select(
        clean_text(F.col("REMITO")).alias("receipt"), at.alias("at"), F.when(~person, told).alias("plate"),
        clean_text(F.col("TARJETA")).alias("card"),
        F.nullif(F.regexp_extract("ESTABLECIMIENTO", r"^(\d+)", 1), F.lit("")).alias("station"),
        F.col("PRODUCTO").alias("product"), as_number(F.col("LITROS UNIDADES")).alias("litres"),
        as_number(F.col("PRECIO PVP ESTABLECIMIENTO")).alias("unit_price"),
        as_number(F.col("IMP TOT PVP ESTABLECIMIENTO")).alias("amount"),
        digits_only(F.when(person, told).otherwise(clean_text(driver))).alias("driver"),
        F.rint(as_number(F.col("ODOMETRO"))).cast("long").alias("odometer"),
        F.when(person, "DNI").otherwise("PATENTE").alias("id_type"),
        F.upper(F.trim(_optional(raw, "ORIGEN DE TRANSACCION"))).alias("origin"),
    )
    rows = number_repeats(rows)
    by_card = lookup(vehicles, F.col("card"), F.col("vehicle_id"), "card", "__card_vehicle")
    by_plate = lookup(vehicles, normalise_id(F.col("plate")), F.col("vehicle_id"), "__norm", "__plate_vehicle")
    linked = rows.withColumn("__norm", normalise_id(F.col("plate"))).join(by_card, "card", "left").join(by_plate, "__norm", "left")
    linked = linked.withColumn("vehicle_id", F.coalesce("__card_vehicle", "__plate_vehicle"))
    contracts = vehicles.select("vehicle_id", "contract")
    return linked.join(contracts, "vehicle_id", "left").filter(F.col("at").isNotNull() & (F.col("litres") > 0)).select(
        "id", "vehicle_id", "plate", F.date_format("at", "yyyy-MM-dd").alias("date"), F.date_format("at", "HH:mm:ss").alias("time"),
        "station", "product", "litres", "unit_price", "amount", "card", "driver", "odometer", "contract", "id_type", "origin")


def requests_of(raw: DataFrame, supplier: str | None = None) -> DataFrame:
    station = _optional(raw, "EstacionServicio")
    if supplier:
        foreign = F.coalesce((F.trim(station) != "") & ~station.rlike("(?i)" + re.escape(supplier)), F.lit(False))
        station = F.when(foreign, OFF_NETWORK).otherwise(station)
    return raw.select(
        clean_text(_optional(raw, "Id")).alias("id"), clean_text(_optional(raw, "Matricula")).alias("vehicle_id"),
        clean_text(_optional(raw, "Dominio")).alias("plate"), F.trim("Fecha").alias("date"), F.trim("Hora").alias("time"),
        as_number(_optional(raw, "OdometroRegistrado")).alias("odometer"),
        F.nullif(F.regexp_extract("Solicitante", r"DNI:\s*(\d+)", 1), F.lit("")).alias("requester"),
        F.coalesce(F.upper(_optional(raw, "TarjetaDni")).isin("TRUE", "SI", "1"), F.lit(False)).alias("personal_card"),
        as_number(F.col("LitrosAutorizados")).alias("authorised"), as_number(_optional(raw, "LitrosCargados")).alias("loaded"),
        F.upper(F.trim("Rendido")).alias("settled"), F.upper(F.trim("Anulado")).alias("voided"), station.alias("station"))


def invoices_of(invoices: DataFrame, lines: DataFrame, contracts: DataFrame, periods: DataFrame | None
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contracts, invoices, lines). Contracts are numbered in the order of their number; they are few."""
    numbered = contracts.select(clean_text(F.col("numero")).alias("number"), as_number(F.col("limite")).alias("monthly_cap"))
    numbered = numbered.withColumn("contract", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("number")))
    heads = invoices.withColumn("__contract", clean_text(F.col("numero_contrato"))).join(
        numbered.select(F.col("number").alias("__contract"), "contract"), "__contract", "left")
    if periods is not None and "periodo_id" in invoices.columns:
        starts = periods.select(F.col("id").alias("periodo_id"), F.date_format(parse_date_text(F.col("fecha_inicio")), "yyyy-MM").alias("period"))
        heads = heads.join(starts, "periodo_id", "left")
    else:
        heads = heads.withColumn("period", F.lit(None).cast("string"))
    document = as_number(_optional(invoices, "pdf_total"))
    heads = heads.select(
        F.col("id").alias("__id"), clean_text(F.col("numero")).alias("number"), "contract", "period",
        as_number(F.col("monto_facturado")).alias("total"), F.when(document > 0, document).alias("pdf_total"))
    litres, amount = as_number(_optional(lines, "litros")), as_number(F.col("importe_yer"))
    fuel = F.coalesce(as_number(_optional(lines, "es_combustible")), F.lit(1.0)) == 1
    detail = lines.select(
        F.concat(F.lit("T"), clean_text(F.col("id"))).alias("line"), F.col("factura_id").alias("__id"),
        clean_text(F.col("remito")).alias("refuel_ref"), F.when(fuel, "COMBUSTIBLE").otherwise("OTRO").alias("concept"),
        litres.alias("litres"), F.bround(F.try_divide(amount, litres), 2).alias("unit_price"), amount.alias("amount"))
    detail = detail.join(heads.select("__id", "number"), "__id").drop("__id")
    return numbered, heads.drop("__id"), detail


def exemptions_of(raw: DataFrame) -> DataFrame:
    """An active exemption without an end has no end; one without a start has always been in force."""
    active = F.upper(F.trim("activo")).isin("SI", "1", "TRUE")
    until = F.to_date(parse_date_text(F.col("fecha_hasta")))
    since = F.to_date(parse_date_text(_optional(raw, "fecha_creacion")))
    return raw.select(
        clean_text(F.col("patente")).alias("plate"), F.when(active, "SI").otherwise("NO").alias("active"),
        F.coalesce(since, F.lit(ALWAYS).cast("date")).alias("date_from"),
        F.coalesce(until, F.when(active, F.lit(NO_END).cast("date"))).alias("date_to"))


def claims_of(raw: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Claims with typed fields; neither the message nor the claim's number is kept."""
    by_plate = lookup(vehicles, normalise_id(F.col("plate")), F.col("vehicle_id"), "__norm", "__v")
    at = parse_date_text(_optional(raw, "fecha_hora"))
    rows = raw.withColumn("__norm", normalise_id(F.col("patente"))).join(by_plate, "__norm", "left")
    fields = [
        categorise(F.coalesce("tipo_alerta", F.lit("")), CLAIM_TYPES).alias("type"),
        categorise(F.coalesce("estado_reclamo", F.lit("")), CLAIM_STATES).alias("state"),
        as_number(F.col("monto_reclamable")).alias("amount"), F.col("nro_ticket").cast("string").alias("ticket"),
        F.coalesce("__v", clean_text(_optional(raw, "matricula"))).alias("vehicle_id"),
        clean_text(_optional(raw, "numero_tarjeta")).alias("card"), at.alias("instant"),
        F.to_date(F.coalesce(parse_date_text(_optional(raw, "dia")), at)).alias("date"),
    ]
    out = rows.select(*fields)
    return out.withColumn("claim", F.sha2(F.to_json(F.struct(*out.columns)), 256))


def devices_of(raw: DataFrame) -> DataFrame:
    group = F.col("Grupo").cast("string")
    depot = F.coalesce(F.upper(group).rlike("BAJA|REEMPLAZ|DEPOSITO|DEPÓSITO"), F.lit(False))
    alias = _optional(raw, "Alias") if "Alias" in raw.columns else F.col("IMEI").cast("string")
    return raw.select(
        clean_text(F.col("IMEI")).alias("imei"), clean_text(alias).alias("alias"), clean_text(F.col("Placa")).alias("plate"),
        F.when(depot, DEPOT_GROUP).otherwise(group).alias("device_group"),
        F.date_format(parse_date_text(_optional(raw, "Hora de última transmisión")), "yyyy-MM-dd'T'HH:mm:ss").alias("last_contact"))


def observations_of(raw: DataFrame) -> DataFrame:
    """Only the alert and its outcome; the text of an observation is free and is not kept."""
    return raw.select(
        clean_text(F.col("id_registro")).alias("record_id"), clean_text(F.col("regla")).alias("rule"),
        categorise(F.coalesce("resultado", F.lit("")), OUTCOMES).alias("outcome"), *([F.col("id")] if "id" in raw.columns else []))


def normalise_sources(tables: dict[str, DataFrame], supplier: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The common tables of raw exports and a diagnosis of one row: what could be read and linked."""
    found = {name: recognise_source(tables, name) for name in SIGNATURES}
    for needed in ("vehicle", "refuel"):
        if found[needed] is None:
            raise ValueError(f"no table looks like the source {needed}")
    vehicles = vehicles_of(found["vehicle"])
    out = {"vehicle": vehicles, "refuel": refuels_of(found["refuel"], vehicles)}
    if found["request"] is not None:
        out["request"] = requests_of(found["request"], supplier)
    if all(found[n] is not None for n in ("invoice", "invoice_line", "contract")):
        out["contract"], out["invoice"], out["invoice_line"] = invoices_of(
            found["invoice"], found["invoice_line"], found["contract"], found["period"])
    for name, build in (("exemption", exemptions_of), ("device", devices_of), ("observation", observations_of)):
        if found[name] is not None:
            out[name] = build(found[name])
    if found["claim"] is not None:
        out["claim"] = claims_of(found["claim"], vehicles)
    whole = F.count(F.lit(1))
    diagnosis = out["refuel"].agg(
        whole.alias("refuels"), share(F.count("vehicle_id"), whole).alias("with_vehicle_pct"),
        share(F.count("contract"), whole).alias("with_contract_pct"),
        share(F.count_if(F.col("id_type") == "DNI"), whole).alias("personal_pct"),
        share(F.count_if(F.col("origin") == "CONTINGENCIA"), whole).alias("fallback_pct"))
    return out, diagnosis
