"""Ordered bands of a number; every set keeps its own side for the values on an edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINIMUM_GROUP = 20  # fixed value: smallest group whose count may be published
SMALL = "1–19"


def bands(value: Column, edges: list[tuple[str, float, str]], last: str) -> Column:
    """``edges`` holds (operator, limit, label) tested in order; null stays null."""
    tests = {"<": lambda x: value < x, "<=": lambda x: value <= x, "==": lambda x: value == x}
    out = None
    for op, limit, label in edges:
        out = F.when(tests[op](limit), label) if out is None else out.when(tests[op](limit), label)
    return out.when(value.isNotNull(), last)


def tank_ratio_band(x: Column) -> Column:
    return bands(x, [("<=", 1.05, "1_02_a_1_05"), ("<=", 1.10, "1_05_a_1_10"), ("<=", 1.25, "1_10_a_1_25"),
                     ("<=", 1.50, "1_25_a_1_50")], "mas_de_1_50")


def excess_share_band(x: Column) -> Column:
    return bands(x, [("<", 0.10, "menos_de_0_10"), ("<=", 0.30, "0_10_a_0_30"), ("<", 0.60, "0_30_a_0_60")], "mas_de_0_60")


def variation_band(x: Column) -> Column:
    return bands(x, [("<", 0.05, "menos_de_0_05"), ("<=", 0.15, "0_05_a_0_15"), ("<=", 0.30, "0_15_a_0_30")], "mas_de_0_30")


def rate_band(x: Column) -> Column:
    return bands(x, [("<", 0.5, "menos_de_0_5"), ("<=", 0.8, "0_5_a_0_8"), ("<=", 1.2, "0_8_a_1_2")], "mas_de_1_2")


def amount_difference_band(x: Column) -> Column:
    return bands(x, [("==", 0.0, "exacta"), ("<=", 0.001, "hasta_0_1_pct"), ("<=", 0.005, "de_0_1_a_0_5_pct"),
                     ("<=", 0.02, "de_0_5_a_2_pct")], "mas_de_2_pct")


def nearest_request_band(minutes: Column) -> Column:
    return bands(minutes, [("<=", 180, "hasta_3_horas"), ("<=", 360, "de_3_a_6_horas"), ("<=", 720, "de_6_a_12_horas"),
                           ("<=", 1440, "de_12_a_24_horas")], "ninguno_a_menos_de_24_horas")


def matched_gap_band(minutes: Column) -> Column:
    return bands(F.abs(minutes), [("<=", 5, "hasta_5"), ("<=", 30, "de_5_a_30"), ("<=", 60, "de_30_a_60"),
                                  ("<=", 180, "de_1_a_3_horas")], "mas_de_3_horas")


def billed_price_band(x: Column) -> Column:
    return bands(x, [("<", 0.95, "menos_de_0_95"), ("<", 0.98, "de_0_95_a_0_98"), ("<", 1.00, "de_0_98_a_1_00"),
                     ("<=", 1.02, "de_1_00_a_1_02")], "mas_de_1_02")


def price_ratio_band(x: Column) -> Column:
    return bands(x, [("<", 0.97, "menos_de_0_97"), ("<", 0.98 - 0.0005, "de_0_97_a_0_98"),
                     ("<=", 0.98 + 0.0005, "exactamente_0_98"), ("<=", 0.99, "de_0_98_a_0_99")], "mas_de_0_99")


def count_band(n: Column) -> Column:
    """A count as a band that reveals neither small groups nor exact sizes."""
    return bands(n, [("==", 0, "0"), ("<", 20, "<20"), ("<", 100, "20–99"), ("<", 1_000, "100–999"),
                     ("<", 10_000, "1.000–9.999"), ("<", 100_000, "10.000–99.999"),
                     ("<", 1_000_000, "100.000–999.999")], "≥1.000.000")


def cardinality_band(n: Column) -> Column:
    return bands(n, [("<=", 1, "1"), ("<=", 10, "2–10"), ("<=", 100, "11–100"), ("<=", 1_000, "101–1.000"),
                     ("<=", 10_000, "1.001–10.000")], ">10.000")


def bounded_count(n: Column) -> Column:
    """A count fit to publish: 0, ``1–19`` or the number."""
    return F.when((n > 0) & (n < MINIMUM_GROUP), SMALL).otherwise(n.cast("string"))


def two_digits(x: Column) -> Column:
    """Rounded to two significant digits, halves to even; zero stays zero, a missing value missing."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 1)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / power) * power)


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage with one decimal; null without a whole."""
    return F.bround(F.try_divide(part * 100.0, whole), digits)
