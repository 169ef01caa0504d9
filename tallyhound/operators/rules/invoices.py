"""Invoices against their lines, their document, the refuels they bill and the month's consumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.dates import month_of
from tallyhound.operators.alerts import alerts, alerts_of_each_row

# Tolerances and line concepts.
HEADER_TOLERANCE = 0.005
DOCUMENT_TOLERANCE = 0.001
PRICE_TOLERANCE = 0.02
PUMP_PRICE_MARGIN = 0.005
MONTH_TOLERANCE = 0.01
FUEL, ADJUSTMENT = "COMBUSTIBLE", "AJUSTE"


def line_totals(lines: DataFrame, number: str = "number", amount: str = "amount") -> DataFrame:
    return lines.groupBy(number).agg(F.sum(amount).alias("lines_total"), F.count(F.lit(1)).alias("line_count"))


def header_gap(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Every invoice with the sum of its lines (0 without lines) and the relative difference of its total."""
    joined = invoices.join(line_totals(lines), "number", "left").withColumn(
        "lines_total", F.coalesce("lines_total", F.lit(0.0))
    )
    base = F.greatest(F.abs("lines_total"), F.lit(1.0))
    return joined.withColumn("gap", (F.col("total") - F.col("lines_total")) / base)


def header_mismatch(invoices: DataFrame, lines: DataFrame, tolerance: float = HEADER_TOLERANCE) -> DataFrame:
    """``factura_no_concilia``: the total differs from its lines."""
    flagged = header_gap(invoices, lines).filter(F.abs("gap") > tolerance)
    return alerts(flagged, F.col("number"), "TOTAL_INFLADO", "factura_no_concilia",
                  F.format_string("total %.1f%% away from its lines", F.col("gap") * 100), F.col("gap"))


def document_mismatch(invoices: DataFrame, tolerance: float = DOCUMENT_TOLERANCE) -> DataFrame:
    """``pdf_no_concilia``: the document's total differs from the debt; without a document nothing is said."""
    gap = (F.col("pdf_total") - F.col("total")) / F.greatest(F.abs("total"), F.lit(1.0))
    flagged = invoices.filter(F.col("pdf_total").isNotNull()).withColumn("gap", gap).filter(F.abs("gap") > tolerance)
    return alerts(flagged, F.col("number"), "DIFERENCIA_DEUDA_PDF", "pdf_no_concilia",
                  F.format_string("document %.2f, debt %.2f", "pdf_total", "total"), F.col("gap"))


def line_irregularities(refuels: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines without a refuel, repeated, overpriced, at pump price, or not fuel; one pass over the lines.

    ``refuels`` needs ``id`` and ``unit_price``; ``lines`` needs ``line, refuel_ref, concept, unit_price``.
    A refuel id that occurs more than once counts with its lowest price.
    """
    prices = refuels.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("unit_price").alias("refuel_price"))
    prices = prices.select(F.col("id").alias("refuel_ref"), "refuel_price", F.lit(True).alias("known"))
    is_fuel = F.col("concept") == FUEL
    # The first line that bills a refuel stands; a minimum is combined before the shuffle, so copies are cheap.
    first = (
        lines.filter(is_fuel & F.col("refuel_ref").isNotNull())
        .groupBy("refuel_ref").agg(F.min("line").alias("first_line"))
    )
    billed = prices.join(first, "refuel_ref", "left")
    joined = lines.join(billed, "refuel_ref", "left")
    known = F.coalesce("known", F.lit(False))
    over = F.col("unit_price") > F.col("refuel_price") * (1 + PRICE_TOLERANCE)
    at_pump = (F.col("unit_price") >= F.col("refuel_price") * (1 - PUMP_PRICE_MARGIN)) & ~over
    ratio = F.try_divide("unit_price", "refuel_price")
    return alerts_of_each_row(joined, F.col("line"), [
        (is_fuel & ~known, "LINEA_SIN_CONSUMO", "linea_sin_consumo", "no such refuel", None),
        (is_fuel & known & (F.col("line") != F.col("first_line")), "LINEA_DUPLICADA", "linea_duplicada",
         "refuel billed before", None),
        (is_fuel & over, "SOBREPRECIO", "sobreprecio", "price per litre above the refuel's", ratio),
        (is_fuel & at_pump, "FACTURADA_A_PRECIO_DE_SURTIDOR", "precio_de_surtidor",
         "pump price, without the company discount", ratio),
        (~F.col("concept").isin(FUEL, ADJUSTMENT) | F.col("concept").isNull(), "PRODUCTO_NO_COMBUSTIBLE",
         "producto_no_combustible", F.concat_ws(" ", F.col("concept"), F.lit("on a fuel invoice")), None),
    ])


def month_reconciliation(spend: DataFrame, invoices: DataFrame, tolerance: float = MONTH_TOLERANCE) -> DataFrame:
    """``conciliacion_mensual``: what a contract used in a month against what was billed; flags each invoice."""
    used = spend.groupBy("contract", month_of(F.col("date")).alias("period")).agg(F.sum("amount").alias("used"))
    billed = invoices.groupBy("contract", "period").agg(F.sum("total").alias("billed"))
    gap = (F.col("billed") - F.col("used")) / F.greatest("used", F.lit(1.0))
    pairs = (
        billed.join(used, ["contract", "period"], "left")
        .withColumn("used", F.coalesce("used", F.lit(0.0)))
        .withColumn("gap", gap).filter(F.abs("gap") > tolerance).select("contract", "period", "gap")
    )
    return alerts(invoices.join(pairs, ["contract", "period"]), F.col("number"), "TOTAL_INFLADO", "conciliacion_mensual",
                  F.format_string("billed %.1f%% away from the month's use", F.col("gap") * 100), F.col("gap"))


def triple_reconciliation(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Debt, lines and document side by side with the number of lines that are not fuel.

    Invoices without lines are not listed: there is nothing to reconcile.
    """
    other = F.sum(F.when(F.col("concept").isin(FUEL, ADJUSTMENT), 0).otherwise(1))
    sums = lines.groupBy("number").agg(F.sum("amount").alias("__lines"), other.cast("long").alias("non_fuel_lines"))
    joined = invoices.join(sums, "number")
    observed = (
        (F.abs(F.col("total") - F.col("__lines")) > HEADER_TOLERANCE * F.abs("__lines"))
        | F.coalesce(F.abs(F.col("pdf_total") - F.col("total")) > DOCUMENT_TOLERANCE * F.abs("total"), F.lit(False))
        | (F.col("non_fuel_lines") > 0)
    )
    return joined.select(
        "number", "contract", "period", F.col("total").alias("debt"), "pdf_total",
        F.round("__lines", 2).alias("lines_total"),
        F.round(F.col("total") - F.col("__lines"), 2).alias("debt_minus_lines"),
        F.round(F.col("pdf_total") - F.col("total"), 2).alias("pdf_minus_debt"),
        "non_fuel_lines", observed.alias("observed"),
    )


def lines_without_refuel(lines: DataFrame, refuels: DataFrame) -> DataFrame:
    """Fuel lines that bill a refuel absent from the report."""
    known = refuels.select(F.col("id").alias("refuel_ref")).filter(F.col("refuel_ref").isNotNull()).distinct()
    return lines.filter(F.col("concept") == FUEL).join(known, "refuel_ref", "left_anti")


def monthly_invoices(spend: DataFrame, tax: float = 0.21) -> DataFrame:
    """Consumption of each contract and month rolled up to the figures of an invoice."""
    net = F.round(F.sum("amount"), 2)
    return spend.groupBy("contract", month_of(F.col("date")).alias("period")).agg(
        F.count(F.lit(1)).alias("refuels"), F.round(F.sum("litres"), 2).alias("litres"), net.alias("net"),
        F.round(net * tax, 2).alias("tax"), F.round(net * (1 + tax), 2).alias("total"),
    )


def contract_rollup(refuels: DataFrame, diesel: str = "DIESEL") -> DataFrame:
    """Per contract: refuels, litres, amount, mean unit price and the fuel family of the majority."""
    return refuels.groupBy("contract").agg(
        F.count(F.lit(1)).alias("refuels"), F.round(F.sum("litres"), 2).alias("litres"),
        F.round(F.sum("amount"), 2).alias("amount"),
        F.round(F.try_divide(F.sum("amount"), F.sum("litres")), 4).alias("unit_price"),
        F.when(F.avg((F.col("product") == diesel).cast("int")) > 0.5, F.lit("DIESEL")).otherwise(F.lit("NAFTA"))
        .alias("family"),
    )
