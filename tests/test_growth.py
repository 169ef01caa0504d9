"""Joins and plans that must keep their form when tables grow."""

import re

from pyspark.sql import functions as F

from tallyhound.operators import audit, linkage, profile


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def registers(spark):
    vehicles = spark.range(60).select(
        "id", F.col("id").alias("vehicle_id"), F.format_string("CU%05d", "id").alias("plate"), F.format_string("T%d", "id").alias("card"),
        F.format_string("MT%08d", "id").alias("engine_number"))
    refuels = spark.range(90).select(
        F.format_string("R%d", "id").alias("id"), F.when(F.col("id") % 9 == 0, F.format_string("GU%05d", "id")).otherwise(
            F.format_string("CU%05d", "id")).alias("plate"), F.format_string("T%d", "id").alias("card"))
    return refuels, vehicles


def test_register_sides_are_never_broadcast(spark):
    refuels, vehicles = registers(spark)
    assert "Broadcast" not in plan(linkage.refuel_links(refuels, vehicles))
    others = vehicles.select(F.col("plate").alias("code"))
    assert plan(audit.explain_unlinked(refuels, "plate", vehicles, others)).count("BroadcastHashJoin") <= 1  # the lengths of plates


def test_unlinked_are_explained_once_for_all_blocks(spark):
    refuels, vehicles = registers(spark)
    block = audit.linkage_block(refuels, vehicles, vehicles.select(F.col("plate").alias("code")))
    assert plan(block).count("levenshtein") == 0
    got = {(r["block"], r["part"]): (r["n"], r["total"]) for r in block.collect()}
    assert got[("vinculadas", "exacto")] == (53, 90)
    assert sum(n for (b, _), (n, _) in got.items() if b == "por_causa") == 37 == got[("por_causa", "distancia_1_de_un_dominio")][1]


def test_values_are_counted_before_their_facts_and_not_sorted_by_column(spark):
    rows = [(("a" if i % 2 else "b"), "  x  y" if i == 0 else "7,5", "w" * 300 if i < 30 else None) for i in range(60)]
    counts = profile.value_counts(spark.createDataFrame(rows, "kind string, odd string, story string"))
    assert "mixed_case#" not in "".join(re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan(counts)))
    told = {(r["column"], r["n"]): r for r in counts.collect()}
    assert told["odd", 1]["spaces"] == 2 and told["odd", 59]["number"] == 7.5
    assert {(r["chars"], len(r["value"]), r["mixed_case"]) for r in counts.filter("chars > 200").collect()} == {(300, 64, False)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert re.search(r"BroadcastHashJoin [^\n]*LeftAnti", plan(profile.categories(counts)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = {(r["column"], r["value"]): r["pct"] for r in profile.categories(counts, sensitive=counts.select("column").limit(0)).collect()}
    assert got["kind", "a"] == got["kind", "b"] == 50.0
