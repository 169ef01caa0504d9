"""The path of hot keys gives what the plain window gives."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhound.operators.matching import match_components
from tallyhound.operators.rangejoin import bucketed_range_join
from tallyhound.operators.sequence import odometer_sequence
from tallyhound.operators.skew import OrderedGroups, first_by, group_quantiles, per_heat


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        key = "hot" if rng.random() < 0.6 else rng.choice("abc")
        at = start + timedelta(hours=rng.randrange(0, 24 * 30))
        rows.append((f"{i:04d}", key, at, rng.choice([None, *range(100)]), round(rng.gauss(0, 40), 2)))
    return spark.createDataFrame(rows, "id string, k string, at timestamp, v int, x double").cache()


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("seconds", [3600, 86_400, 10 * 86_400])
def test_neighbours(events, seconds):
    groups = OrderedGroups(["k"], ["at", "id"], slice_seconds=seconds)
    picks = {"p1": (F.col("id"), 1), "p2": (F.col("id"), 2), "n1": (F.col("id"), -1)}
    got = per_heat(events, ["k"], lambda df, hot: groups.neighbours(df, picks, hot), hot_rows=200)
    want = groups.neighbours(events, picks, hot=False)
    assert [r for r in collected(got, "id")] == [r for r in collected(want, "id")]
    as_text = [F.coalesce(c, F.lit("")) for c in ("p1", "p2", "n1")]
    assert collected(got, "id", *as_text) == collected(want, "id", *as_text)


@pytest.mark.parametrize("reverse", [False, True])
def test_running(events, reverse):
    groups = OrderedGroups(["k"], ["at", "id"])
    specs = {"total": ("sum", F.col("v"), True), "before": ("sum", F.col("v"), False), "top": ("max", F.col("v"), False),
             "seen": ("last", F.col("v"), False), "now": ("last", F.struct("id", "v"), True)}
    got = per_heat(events, ["k"], lambda df, hot: groups.running(df, specs, hot, reverse), hot_rows=200)
    want = groups.running(events, specs, False, reverse)
    columns = ["id", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in specs]]
    assert collected(got, *columns) == collected(want, *columns)


def test_quantiles(events):
    points = {"lo": 0.05, "mid": 0.5, "hi": 0.95}
    plain = group_quantiles(events, ["k"], "x", points, hot_rows=10**9)
    split = group_quantiles(events, ["k"], "x", points, hot_rows=200)
    every = group_quantiles(events, ["k"], "x", points, hot_rows=0)
    rounded = lambda df: collected(df, "k", *[F.round(p, 9) for p in points])
    assert rounded(plain) == rounded(split) == rounded(every)
    values = [r["x"] for r in events.filter("k = 'hot'").collect()]
    assert dict((r[0], r[2]) for r in rounded(split))["hot"] == pytest.approx(median(values))


def test_first_by(events):
    got = collected(first_by(events, ["k"], ["v", "id"]), "k", "id")
    w = Window.partitionBy("k").orderBy(F.col("v").asc_nulls_last(), "id")
    want = collected(events.withColumn("r", F.row_number().over(w)).filter("r = 1"), "k", "id")
    assert got == want


def test_range_join_equals_plain_join(events):
    left = events.select(F.col("id").alias("a"), "k", F.col("at").alias("t"))
    right = events.select(F.col("id").alias("b"), "k", F.col("at").alias("u"))
    got = bucketed_range_join(left, right, "t", "u", ["k"], -1800, 3 * 3600)
    gap = F.unix_seconds("t") - F.unix_seconds("u")
    want = left.join(right, "k").filter(gap.between(-1800, 3 * 3600))
    assert collected(got, "a", "b") == collected(want, "a", "b")


def test_sequence_of_hot_vehicle(events):
    refuels = events.select("id", F.col("k").alias("vehicle_id"), F.to_date("at").alias("date"), F.col("at").alias("instant"),
                            F.col("v").alias("odometer"))
    for repeats in (False, True):
        cold = odometer_sequence(refuels, skip_repeats=repeats, hot_rows=10**9)
        hot = odometer_sequence(refuels, skip_repeats=repeats, hot_rows=200)
        columns = ["id", "km", "days", F.coalesce(F.round("km_per_day", 6), F.lit(-1.0)), F.coalesce("following", F.lit(-1.0)),
                   F.coalesce("previous2", F.lit(-1.0))]
        assert collected(cold, *columns) == collected(hot, *columns)


def test_components_of_hot_key(events):
    refuels = events.filter("v % 2 = 0").select(F.col("k").alias("match_key"), "id", F.col("at").alias("instant"), F.col("x").alias("litres"))
    requests = events.filter("v % 2 = 1").select(F.col("k").alias("match_key"), "id", F.col("at").alias("instant"), F.col("x").alias("loaded"),
                                                 F.lit(False).alias("is_voided"))
    columns = ["id", "kind", "component", "alone", "heads_pair", "ends_pair"]
    assert collected(match_components(refuels, requests, 10**9), *columns) == collected(match_components(refuels, requests, 100), *columns)
