"""No small group can be read or recovered by subtraction."""

import itertools
import random
from threading import Barrier

import pytest

from tallyhound.functions import bands
from tallyhound.operators.profile import normalise_name, sensitivity_of_name
from tallyhound.operators import audit
from tallyhound.operators.suppress import _Told, suppress_axis, suppress_parts
from tallyhound.plans import run
from tallyhound.sources.files import name_pattern


def published(spark, total, parts):
    rows = [(1, f"p{i}", n, total) for i, n in enumerate(parts)]
    df = suppress_parts(spark.createDataFrame(rows, "block int, part string, n long, total long"), ["block"])
    return [r["published"] for r in df.orderBy("part").collect()]


@pytest.mark.parametrize("total,parts,want", [
    (37, [23, 14, 0], [None, "1–19", "0"]), (100, [50, 50], ["50", "50"]), (10, [10], ["1–19"]), (71, [5, 6, 60], ["1–19", "1–19", None])])
def test_stated_cases(spark, total, parts, want):
    assert published(spark, total, parts) == want


def test_no_remainder_of_a_small_group(spark):
    rng = random.Random(3)
    rows, totals = [], {}
    for block in range(200):
        parts = [rng.choice([0, rng.randrange(1, 20), rng.randrange(20, 90)]) for _ in range(rng.randrange(1, 7))]
        totals[block] = (sum(parts), sum(parts) + rng.choice([0, 7, 25]))
        rows += [(block, f"p{i}", n, *totals[block]) for i, n in enumerate(parts)]
    df = spark.createDataFrame(rows, "block int, part string, n long, t1 long, t2 long")
    out = suppress_parts(df, ["block"], totals=("t1", "t2")).collect()
    for block, both in totals.items():
        shown = [int(r["published"]) for r in out if r["block"] == block and r["published"] not in (None, "1–19")]
        if any(n >= 20 for n in shown):
            assert all(not 0 < t - sum(shown) < 20 for t in both if t >= 20)
        assert not any(0 < n < 20 for n in shown)


def test_nested_block_does_not_give_a_hidden_cell(spark):
    rows = [("a", "x", 60, 88), ("a", "y", 23, 88), ("a", "z", 5, 88), ("a.y", "u", 23, 23), ("alone", "p", 50, 50)]
    out = audit.publish(spark.createDataFrame(rows, "block string, part string, n long, total long"), {"a.y": ("a", "y")}).collect()
    got = {(r["block"], r["part"]): (r["published"], r["total"]) for r in out}
    assert got[("a", "z")] == ("1–19", "88") and got[("alone", "p")] == ("50", "50")
    assert got[("a", "y")][0] is None and got[("a.y", "u")][1] is None
    assert got[("a", "x")][0] is None or got[("a.y", "u")][0] is None  # else z is 88 - 60 - 23


def test_overlapping_parts_are_set_against_their_total_alone(spark):
    rows = [("tiers", "a", 60, 90), ("tiers", "b", 80, 90), ("tiers", "c", 90, 90)]
    out = audit.publish(spark.createDataFrame(rows, "block string, part string, n long, total long")).collect()
    shown = {r["part"]: r["published"] for r in out}
    assert shown["a"] == "60" and shown["c"] == "90" and shown["b"] is None  # 90 - 80 would tell ten


def possible(told, most):
    """Every assignment of the unknowns that agrees with all that is published, by trying all numbers."""
    unknown = [x for x in told.value if not told.visible(x)]
    spans = {x: range(0, most) if x[0] == "rest" else range(1, told.minimum) if 0 < told.value[x] < told.minimum else range(told.minimum, most) for x in unknown}
    fixed = {x: n for x, n in told.value.items() if told.visible(x)}
    for pick in itertools.product(*spans.values()):
        full = fixed | dict(zip(unknown, pick))
        if all(full[whole] == sum(full[p] for p in parts) for _, (whole, *parts) in told.sums):
            yield full


@pytest.mark.parametrize("seed", range(150))
def test_all_published_numbers_together_give_no_small_group(seed):
    """Trees of two or three blocks, small enough to try every solution; groups of 1 and 2 are to be protected."""
    rng = random.Random(seed)
    outer = [rng.choice([0, 1, 2, 3, 4, 6]) for _ in range(rng.randint(2, 3))]
    rows = [("a", f"p{i}", n, sum(outer) + (rng.choice([0, 0, 1])), None, None) for i, n in enumerate(outer)]
    rows = [(*r[:3], rows[0][3], *r[4:]) for r in rows]
    for i in rng.sample(range(len(outer)), rng.randint(1, 2)):
        inside = rng.randint(0, outer[i]) if rng.random() < 0.3 else outer[i]
        cut = rng.randint(0, inside)
        rows += [(f"b{i}", "u", cut, inside, "a", f"p{i}"), (f"b{i}", "v", inside - cut, inside, "a", f"p{i}")]
    told = _Told(rows, 3)
    told.protect()
    if any(told.visible(x) and told.value[x] >= 3 for x in told.value):
        solutions = list(possible(told, 9))
        assert told.value in solutions
        for x in told.value:
            if not told.visible(x) and 0 < told.value[x] < 3:
                assert len({s[x] for s in solutions}) > 1, (x, rows)
        for _, (whole, *parts) in told.sums:
            hidden = [p for p in parts if not told.visible(p)]
            sums = {sum(s[p] for p in hidden) for s in solutions}
            assert not hidden or told.value[whole] < 3 or len(sums) > 1 or not 0 < next(iter(sums)) < 3, rows


def test_axis(spark):
    cells = spark.createDataFrame([(1, "2024-01", "a", 30), (1, "2024-02", "a", 40), (1, "2024-01", "b", 25), (1, "2024-02", "b", 50)],
                                  "block int, month string, field string, n long")
    totals = spark.createDataFrame([(1, "a", 75), (1, "b", 75), (1, None, 150)], "block int, field string, total long")
    out = {(r["month"], r["field"]): r["published"] for r in suppress_axis(cells, ["block"], "month", "field", "n", totals).collect()}
    assert out[("2024-01", "a")] is None and out[("2024-02", "a")] == "40" and out[("2024-02", "b")] == "50"


def test_axis_leaves_no_small_remainder(spark):
    rng = random.Random(11)
    rows, totals = [], {}
    for block in range(120):
        for f in "abc":
            cells = [(block, f"m{m}", f, rng.choice([0, rng.randrange(1, 20), rng.randrange(20, 90)])) for m in range(rng.randrange(1, 5))]
            rows += cells
            totals[block, f] = sum(c[3] for c in cells) + rng.choice([0, 7])
        totals[block, None] = sum(t for (b, f), t in totals.items() if b == block and f)
    out = suppress_axis(spark.createDataFrame(rows, "block int, month string, field string, n long"), ["block"], "month", "field", "n",
                        spark.createDataFrame([(*k, t) for k, t in totals.items()], "block int, field string, total long")).collect()
    assert len(out) == len(rows)
    for (block, f), total in totals.items():
        mine = [r for r in out if r["block"] == block and f in (None, r["field"])]
        shown = [int(r["published"]) for r in mine if r["published"] not in (None, "1–19")]
        assert not any(0 < n < 20 for n in shown)
        if total >= 20 and any(r["n"] >= 20 for r in mine):
            assert not 0 < total - sum(shown) < 20
        hidden = [r for r in mine if r["published"] is None]
        assert all(r["n"] >= 20 for r in hidden)


def test_bands(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.05,), (1.1,), (1.5,), (1.51,)], "x double")
    assert [r[0] for r in df.select(bands.tank_ratio_band(F.col("x"))).collect()] == ["1_02_a_1_05", "1_05_a_1_10", "1_25_a_1_50", "mas_de_1_50"]
    df = spark.createDataFrame([(0.1, 0.3), (0.0999, 0.6)], "a double, b double")
    got = df.select(bands.excess_share_band(F.col("a")), bands.excess_share_band(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("0_10_a_0_30", "0_10_a_0_30"), ("menos_de_0_10", "mas_de_0_60")]
    df = spark.createDataFrame([(123456.0,), (0.0347,), (0.0,), (-125.0,)], "x double")
    assert [r[0] for r in df.select(F.round(bands.two_digits(F.col("x")), 6)).collect()] == [120000.0, 0.035, 0.0, -120.0]


def test_names():
    assert normalise_name("Fecha_Carga") == normalise_name("fechaCarga") == "fecha carga"
    assert sensitivity_of_name("NumeroTarjeta") == "identificador"
    assert sensitivity_of_name("litros") is None
    assert [name_pattern(n) for n in ("consumo_2025-09-01", "Reporte (12)", "lote_3_final")] == ["consumo", "Reporte", "lote_9_final"]


def test_sensitive_columns_are_not_published(spark):
    from pyspark.sql import functions as F

    from tallyhound.operators import profile

    names = ["conductor", "patente", "NumeroTarjeta", "fechaCarga", "producto", "cod_postal", "Título"]
    told = spark.createDataFrame([(n,) for n in names], "n string").select("n", profile.name_sensitivity(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in told} == {n: sensitivity_of_name(n) for n in names}
    rows = [(["ANA", "LUIS"][i % 2], ["AB123CD", "AA111BB"][i % 2], ["DIESEL", "NAFTA"][i % 2], ["AE999ZZ", "AF888YY"][i % 2],
             f"UNIDAD DE TRASLADO DEL NORTE {i % 2}") for i in range(80)]
    df = spark.createDataFrame(rows, "conductor string, patente string, producto string, rodado string, responsable string")
    counts = profile.value_counts(df)
    assert {r["column"] for r in profile.categories(counts).collect()} == {"producto"}
    shapes = {(r["column"], r["shape"]) for r in profile.shape_histogram(counts).collect()}
    assert ("responsable", "TEXTO_21-40") in shapes and ("rodado", "AA999AA") in shapes


def test_types_of_columns(spark):
    from pyspark.sql import functions as F

    from tallyhound.operators import profile

    df = spark.range(60).select(
        (F.col("id") % 2).alias("flag"), (F.col("id") % 2 == 0).alias("yes"), F.col("id").alias("count"), (F.col("id") / 7).alias("angle"),
        (F.col("id") * 1.5 + 1000).alias("amount"), (F.col("id") + 350_000_000_000).alias("line"), F.to_date(F.lit("2024-01-01")).alias("day"),
        F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("at"), F.when(F.col("id") < 5, F.lit("x")).alias("rare"), F.lit("a").alias("word"))
    got = {r["column"]: (r["type"], r["sensitive"]) for r in profile.column_types(df).collect()}
    assert got == {"flag": ("booleano", None), "yes": ("booleano", None), "count": ("entero", None), "angle": ("decimal", "ubicacion"), "amount": ("decimal", None),
                   "line": ("entero", "identificador"), "day": ("fecha", None), "at": ("fecha", None), "rare": ("desconocido", None), "word": ("texto", None)}


def test_a_block_that_fails_ends_the_audit(spark):
    """No row stands for a failure, and the error tells the block and the type alone."""
    def build():
        return spark.createDataFrame([("AA001BB",)], "plate string").selectExpr("'b' AS block", "raise_error(plate) AS part", "1L AS n", "1L AS total")

    with pytest.raises(audit.BlockFailed, match="^audit block exceso failed: [A-Za-z0-9]+$") as told:
        audit.protected("exceso", build)
    assert told.value.__context__ is None and told.value.__cause__ is None
    fine = spark.createDataFrame([("b", "p", 3, 4)], "block string, part string, n long, total long")
    assert [tuple(r) for r in audit.protected("fine", lambda: fine).collect()] == [("b", "p", 3, 4)]


def test_a_failing_block_reaches_the_caller_of_the_whole_audit(spark, monkeypatch):
    vehicle = spark.createDataFrame([(1, "AA001BB", "MT-40000001", "T1", "SI", 50.0)],
                                    "vehicle_id long, plate string, engine_number string, card string, odometer_exempt string, tank_capacity double")
    rows = [(f"R{i}", 1, "AA001BB", f"2024-01-0{1 + i}", "10:00:00", "POSNET", 10.0 + i, 1000 + i, "NAFTA", 10.0, "PATENTE", "P1", "1", "T1", 1.0) for i in range(3)]
    refuel = spark.createDataFrame(rows, "id string, vehicle_id long, plate string, date string, time string, origin string, litres double, odometer long, "
                                         "product string, amount double, id_type string, driver string, station string, card string, unit_price double")

    def broken(alerts):
        raise KeyError("AA001BB")

    monkeypatch.setattr(audit, "rule_block", broken)
    with pytest.raises(audit.BlockFailed, match="^audit block reglas failed: KeyError$"):
        audit.audit({"vehicle": vehicle, "refuel": refuel})


def test_blocks_of_the_audit_run_side_by_side_and_share_the_pairs(spark, monkeypatch):
    both = Barrier(2, timeout=60)
    block = lambda name: spark.createDataFrame([(name, "p", 30, 70)], "block string, part string, n long, total long")
    refuel = spark.createDataFrame([("R1", "2024-01-01", "10:00:00", 10.0)], "id string, date string, time string, litres double")
    pairs = spark.createDataFrame([("R1", "S1")], "refuel_id string, request_id string")
    alerts = spark.createDataFrame([], "record_id string, anomaly_type string, rule string, detail string, measure double")

    def waiting(name):
        def build(*rest):
            both.wait()
            return block(name)
        return build

    def windows(refuels, requests, vehicles, given):
        assert given is pairs
        return block("ventanas")

    monkeypatch.setattr(run, "run_rules", lambda data, hot_rows, dealt: run.Findings(
        alerts, refuel, refuel, requests=refuel, extra={"sequence": alerts, "exempt": refuel, "all_pairs": pairs}))
    for name, build in {"rule_block": waiting("reglas"), "excess_block": waiting("exceso"), "time_window_block": windows}.items():
        monkeypatch.setattr(audit, name, build)
    for name in ("hypothesis_block", "fallback_block", "regressions_block", "odometer_block", "coverage_block"):
        monkeypatch.setattr(audit, name, lambda *rest, name=name: block(name))
    monkeypatch.setattr(audit, "fallback_pairs", lambda refuels: refuels)
    out = audit.audit({"vehicle": refuel, "refuel": refuel}).collect()
    assert sorted(r["block"] for r in out) == sorted([
        "reglas", "exceso", "ventanas", "hypothesis_block", "fallback_block", "regressions_block", "odometer_block", "coverage_block"])
