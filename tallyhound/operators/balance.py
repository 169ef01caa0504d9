"""Daily balance of each contract against its monthly cap, and the rules on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions.dates import month_of
from tallyhound.operators.alerts import alerts
from tallyhound.operators.skew import first_by

# Fixed values of the projection and of the transfer test.
HISTORY_DAYS = 7
PROJECTION_MARGIN = 1.05
TRANSFER_SLACK = 0.9


def contract_month_key(contract, month):
    return F.concat(F.lit("CTO-"), contract.cast("string"), F.lit("|"), month)


def month_spend(spend: DataFrame) -> DataFrame:
    return spend.groupBy("contract", month_of(F.col("date")).alias("month")).agg(F.sum("amount").alias("used"))


def spend_over_cap(spend: DataFrame, contracts: DataFrame) -> DataFrame:
    """``ejecucion_supera_tope``: the month's consumption exceeds the cap."""
    over = month_spend(spend).join(contracts, "contract").filter(F.col("used") > F.col("monthly_cap"))
    share = F.round(F.col("used") / F.col("monthly_cap") * 100, 0)
    return alerts(over, contract_month_key(F.col("contract"), F.col("month")), "CARGA_CON_CUPO_AGOTADO",
                  "ejecucion_supera_tope", F.format_string("month at %.0f%% of its cap", share), share)


def _day_movements(spend: DataFrame, transfers: DataFrame) -> DataFrame:
    """Consumption, received and ceded amount per contract and day; combined before the shuffle."""
    zero = F.lit(0.0)
    moves = (
        spend.select("contract", "date", F.col("amount").alias("used"), zero.alias("received"), zero.alias("ceded"))
        .unionByName(transfers.select(F.col("to_contract").alias("contract"), "date", zero.alias("used"),
                                      F.col("amount").alias("received"), zero.alias("ceded")))
        .unionByName(transfers.select(F.col("from_contract").alias("contract"), "date", zero.alias("used"),
                                      zero.alias("received"), F.col("amount").alias("ceded")))
    )
    return moves.groupBy("contract", "date").agg(F.sum("used").alias("used"), F.sum("received").alias("received"),
                                                 F.sum("ceded").alias("ceded"))


def daily_balance(spend: DataFrame, transfers: DataFrame, contracts: DataFrame) -> DataFrame:
    """The balance of every contract on every day from the first month's start to the last day of use.

    The cap renews each month; transfers of a day count before its refuels.
    """
    first = spend.agg(F.trunc(F.min("date"), "MM")).scalar()
    last = spend.agg(F.max("date")).scalar()
    calendar = contracts.select("contract", "monthly_cap", F.explode(F.sequence(first, last)).alias("date"))
    days = calendar.join(_day_movements(spend, transfers), ["contract", "date"], "left").select(
        "contract", "date", month_of(F.col("date")).alias("month"), F.col("monthly_cap").alias("cap"),
        (F.coalesce("received", F.lit(0.0)) - F.coalesce("ceded", F.lit(0.0))).alias("transferred"),
        F.coalesce("used", F.lit(0.0)).alias("used"),
    )
    # A group holds one month of one contract: 31 rows at most.
    w = Window.partitionBy("contract", "month").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    moved, used = F.sum("transferred").over(w), F.sum("used").over(w)
    return days.select(
        "*", (F.col("cap") + moved - (used - F.col("used"))).alias("available"),
        (F.col("cap") + moved - used).alias("closing"),
    )


def exhausted_months(balance: DataFrame) -> DataFrame:
    """Contract months with days that had refuels and nothing left to spend."""
    return balance.filter((F.col("available") <= 0) & (F.col("used") > 0)).groupBy("contract", "month").agg(
        F.count(F.lit(1)).alias("days"), F.round(F.sum("used"), 2).alias("used_without_balance")
    )


def active_day_balance(spend: DataFrame, transfers: DataFrame, contracts: DataFrame) -> DataFrame:
    """Opening, available and projected use on the days with movement, for the months with consumption.

    Only days with movement can raise an alert, so no calendar is built. The projection to the end of the
    month mixes the month so far with seven days of the contract's mean over the complete months, all
    months but the last.
    """
    months = spend.select(month_of(F.col("date")).alias("month")).distinct()
    span = months.agg(F.max("month").alias("last"), F.count(F.lit(1)).alias("n"))
    last_month, n_months = span.select("last").scalar(), span.select("n").scalar()
    history = month_spend(spend).filter((F.col("month") != last_month) | (n_months == 1)).groupBy("contract").agg(
        F.sum("used").alias("__history")
    )
    days = (
        _day_movements(spend, transfers).withColumn("month", month_of(F.col("date")))
        .join(months, "month", "left_semi").join(contracts, "contract").join(history, "contract", "left")
    )
    before = Window.partitionBy("contract", "month").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum("used").over(before), F.lit(0.0))
    net = F.coalesce(F.sum(F.col("received") - F.col("ceded") - F.col("used")).over(before), F.lit(0.0))
    length = F.dayofmonth(F.last_day("date"))
    n_day = F.dayofmonth("date")
    mean = F.coalesce("__history", F.lit(0.0)) / F.greatest(n_months - 1, F.lit(1))
    daily = (so_far + mean / length * HISTORY_DAYS) / (n_day - 1 + HISTORY_DAYS)
    return days.select(
        "contract", "month", "date", "used", "received", "ceded", (F.col("monthly_cap") + net).alias("opening"),
        (F.col("monthly_cap") + net + F.col("received") - F.col("ceded")).alias("available"),
        (daily * (length - n_day + 1)).alias("projection"),
    )


def quota_irregularities(spend: DataFrame, transfers: DataFrame, contracts: DataFrame) -> DataFrame:
    """``carga_con_saldo_agotado`` and ``transferencia_no_justificada``.

    A received transfer has no ground when the projection with its margin stays below 90 % of what the
    contract had without it and that day's use did not exceed that either; the first one of each contract
    month is reported.
    """
    days = active_day_balance(spend, transfers, contracts)
    exhausted = days.filter((F.col("available") <= 0) & (F.col("used") > 0)).groupBy("contract", "month").agg(
        F.count(F.lit(1)).alias("days")
    )
    key = contract_month_key(F.col("contract"), F.col("month"))
    own = F.col("opening") - F.col("ceded")
    idle = days.filter(
        (F.col("received") != 0) & (F.col("projection") * PROJECTION_MARGIN < TRANSFER_SLACK * own)
        & (F.col("used") <= own)
    )
    received = transfers.select(F.col("to_contract").alias("contract"), "date", F.col("id").alias("transfer"))
    unfounded = first_by(
        idle.select("contract", "month", "date").join(received, ["contract", "date"]), ["contract", "month"],
        ["date", "transfer"],
    )
    return alerts(
        exhausted, key, "CARGA_CON_CUPO_AGOTADO", "carga_con_saldo_agotado",
        F.format_string("%d days with refuels and no balance", "days"), F.col("days"),
    ).unionByName(alerts(
        unfounded, key, "TRANSFERENCIA_SIN_NECESIDAD", "transferencia_no_justificada",
        F.concat(F.col("transfer"), F.lit(": the month's projection was covered")),
    ))
