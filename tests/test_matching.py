"""Matching against brute force on small cases."""

from itertools import permutations

import numpy as np
import pytest

from tallyhound.operators import matching
from tallyhound.operators.prepare import typed_refuels, typed_requests


def brute(cost, unmatched):
    n, m = cost.shape
    best = np.inf
    for pick in set(permutations([*range(m), *[-1] * n], n)):
        best = min(best, sum(unmatched if j < 0 else cost[i, j] for i, j in enumerate(pick)))
    return best


@pytest.mark.parametrize("seed", range(25))
def test_assignment_is_cheapest(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 5, 2)
    cost = rng.uniform(0, 8, (n, m))
    cost[rng.random((n, m)) < 0.3] = np.inf
    taken = matching.assign(cost, 5.0)
    used = taken[taken >= 0]
    assert len(used) == len(set(used))
    total = sum(5.0 if j < 0 else cost[i, j] for i, j in enumerate(taken))
    assert total == pytest.approx(brute(cost, 5.0))


REFUEL = "id string, plate string, card string, driver string, id_type string, date string, time string, litres double"
REQUEST = ("id string, vehicle_id string, plate string, requester string, personal_card boolean, date string, time string, "
           "authorised double, loaded double, settled string, voided string, station string")
VEHICLE = "vehicle_id string, plate string, card string, engine_number string"


def request(i, plate, time, loaded, voided="NO", settled="SI", station="RED"):
    return (i, None, plate, None, False, "05/03/2024", time, loaded, loaded, settled, voided, station)


@pytest.fixture(scope="module")
def vehicles(spark):
    return spark.createDataFrame([("V1", "AA001BB", "T1", "MOT11111111"), ("V2", "AA002BB", "T2", "MOT22222222")], VEHICLE)


def pairs(df):
    return {(r["refuel_id"], r["request_id"]) for r in df.collect()}


def test_optimal_match_prefers_litres_and_live_requests(spark, vehicles):
    refuels = typed_refuels(spark.createDataFrame([
        ("C1", "AA001BB", "T1", None, "PATENTE", "2024-03-05", "10:00:00", 40.0),
        ("C2", "WRONG", "T1", None, "PATENTE", "2024-03-05", "11:00:00", 20.0),
        ("C3", "AA002BB", "T2", None, "PATENTE", "2024-03-05", "18:00:00", 30.0)], REFUEL))
    requests = typed_requests(spark.createDataFrame([
        request("P1", "aa-001-bb", "09:30:00", 20.0), request("P2", "AA001BB", "09:20:00", 40.0),
        request("P3", "AA002BB", "10:00:00", 30.0), request("P4", "AA001BB", "09:31:00", 20.0, voided="SI"),
        request("P5", "AA001BB", "09:30:00", 20.0, station="ESTACION AJENA")], REQUEST))
    assert pairs(matching.context_pairs(refuels, requests, vehicles)) == {("C1", "P2"), ("C2", "P1")}


def test_window_edges(spark, vehicles):
    refuels = typed_refuels(spark.createDataFrame([
        ("C1", "AA001BB", "T1", None, "PATENTE", "2024-03-05", "10:00:00", 40.0),
        ("C2", "AA002BB", "T2", None, "PATENTE", "2024-03-05", "10:00:00", 40.0)], REFUEL))
    late = [request("P1", "AA001BB", "10:30:00", 40.0), request("P2", "AA002BB", "06:59:00", 40.0)]
    assert pairs(matching.context_pairs(refuels, typed_requests(spark.createDataFrame(late, REQUEST)), vehicles)) == {("C1", "P1")}


def test_unlinked_refuel_needs_a_single_candidate(spark, vehicles):
    refuels = typed_refuels(spark.createDataFrame([
        ("C1", "ZZ9", "TX", None, "PATENTE", "2024-03-05", "10:00:00", 33.0),
        ("C2", "ZZ8", "TX", None, "PATENTE", "2024-03-05", "15:00:00", 21.0)], REFUEL))
    requests = typed_requests(spark.createDataFrame([
        request("P1", "AA001BB", "09:30:00", 33.2), request("P2", "AA001BB", "14:30:00", 21.1), request("P3", "AA002BB", "14:40:00", 21.2)], REQUEST))
    found = matching.context_pairs(refuels, requests, vehicles)
    assert pairs(found) == {("C1", "P1")}
    left = {r["id"] for r in matching.unserved_requests(requests, found).collect()}
    assert left == {"P2", "P3"}


def test_greedy_takes_requests_in_order(spark):
    refuels = typed_refuels(spark.createDataFrame([
        ("C1", "AA001BB", "T1", None, "PATENTE", "2024-03-05", "10:00:00", 40.0),
        ("C2", "AA001BB", "T1", None, "PATENTE", "2024-03-05", "12:00:00", 40.0),
        ("C3", "AA001BB", "T1", None, "DNI", "2024-03-05", "10:01:00", 40.0)], REFUEL))
    requests = typed_requests(spark.createDataFrame([
        request("P1", "AA001BB", "10:50:00", 40.0), request("P2", "AA001BB", "10:01:00", 40.0), request("P3", "AA001BB", "12:00:00", 40.0)], REQUEST))
    assert pairs(matching.greedy_day_pairs(refuels, requests)) == {("C1", "P1"), ("C2", "P2")}


def cost_of(found, a, b):
    """Total cost of pairs plus that of the refuels left alone; checks one-to-one and the window."""
    assert len({f for f, _ in found}) == len({q for _, q in found}) == len(found)
    total = matching.UNMATCHED_COST * (len(a) - len(found))
    for f, q in found:
        minutes = (a[f][0] - b[q][0]) / 60
        assert -matching.MINUTES_AFTER <= minutes <= matching.MINUTES_BEFORE
        total += float(matching.pair_cost(np.float64(minutes), a[f][1], b[q][1], b[q][2]))
    return total


@pytest.mark.parametrize("n,m", [(60, 40), (40, 70)])
def test_auction_costs_as_little_as_the_exact_match(spark, n, m):
    """Chains of overlapping windows over several slices, by either side as the bidder."""
    rng = np.random.default_rng(n)
    for seed in range(2):
        a = {f"F{i:03d}": (int(rng.integers(0, 60_000)), float(rng.integers(10, 60)), False) for i in range(n)}
        b = {f"Q{i:03d}": (int(rng.integers(0, 60_000)), float(rng.integers(10, 60)), bool(rng.random() < 0.2)) for i in range(m)}
        rows = [("K", 1, kind, k, v[0] * 1_000_000, v[1], v[2]) for kind, side in (("refuel", a), ("request", b)) for k, v in side.items()]
        df = spark.createDataFrame(rows, "match_key string, component long, kind string, id string, at long, litres double, voided boolean")
        got = cost_of(pairs(matching.auction_pairs(df)), a, b)
        gap = np.array([[(x[0] - y[0]) / 60 for y in b.values()] for x in a.values()])
        cost = np.array([[float(matching.pair_cost(np.float64(g), x[1], y[1], y[2])) for g, y in zip(row, b.values())] for row, x in zip(gap, a.values())])
        cost[(gap > matching.MINUTES_BEFORE) | (gap < -matching.MINUTES_AFTER)] = np.inf
        best = sum(matching.UNMATCHED_COST if j < 0 else cost[i, j] for i, j in enumerate(matching.assign(cost)))
        assert best - 1e-9 <= got <= best + matching.EPSILON * min(n, m)


def test_auction_of_a_chain_of_days_takes_few_rounds(spark, monkeypatch):
    """Many requests outbid one another over ten days; rounds must not grow with the hours that the chain spans."""
    rng = np.random.default_rng(4)
    a = {f"F{i:04d}": (int(rng.integers(0, 864_000)), float(rng.integers(10, 200)), False) for i in range(2400)}
    b = {f"Q{i:04d}": (int(rng.integers(0, 864_000)), float(rng.integers(10, 200)), False) for i in range(1000)}
    rows = [("K", 1, kind, k, v[0] * 1_000_000, v[1], v[2]) for kind, side in (("refuel", a), ("request", b)) for k, v in side.items()]
    df = spark.createDataFrame(rows, "match_key string, component long, kind string, id string, at long, litres double, voided boolean")
    settled, rounds = matching.settle, []
    monkeypatch.setattr(matching, "settle", lambda x: rounds.append(x) or settled(x))
    whole = cost_of(pairs(matching.auction_pairs(df)), a, b)
    assert len(rounds) <= 2
    sliced = cost_of(pairs(matching.auction_pairs(df, slice_rows=1000)), a, b)
    assert abs(whole - sliced) <= matching.EPSILON * 1000 and len(rounds) <= 10


def test_large_components_take_the_auction(spark, vehicles):
    refuels = typed_refuels(spark.createDataFrame([(f"C{i}", "AA001BB", "T1", None, "PATENTE", "2024-03-05", f"10:0{i}:00", 40.0 + i) for i in range(4)], REFUEL))
    requests = typed_requests(spark.createDataFrame([request(f"P{i}", "AA001BB", f"09:1{i}:00", 40.0 + i) for i in range(4)], REQUEST))
    left, right = matching.keyed_refuels(refuels, vehicles), matching.keyed_requests(requests)
    want = {(f"C{i}", f"P{i}") for i in range(4)}
    assert pairs(matching.optimal_pairs(left, right)) == pairs(matching.optimal_pairs(left, right, component_rows=2)) == want


@pytest.mark.parametrize("seed", range(30))
def test_nearest_in_turn_is_the_plain_search(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(0, 12, 2)
    group = {"kind": np.array(["refuel"] * n + ["request"] * m, object), "at": rng.integers(0, 20, n + m),
             "id": np.array([f"F{i:02d}" for i in rng.permutation(n)] + [f"Q{i:02d}" for i in range(m)], object)}
    free = {group["id"][i]: int(group["at"][i]) for i in range(n)}
    want = []
    for request_id, when in zip(group["id"][n:], group["at"][n:]):
        if free:
            near = min(free, key=lambda f: (abs(free[f] - when), f))
            want.append((near, request_id))
            del free[near]
    assert matching.nearest_in_turn(group) == want


def test_unique_pairs_where_most_are_crowded(spark):
    rng = np.random.default_rng(8)
    at = lambda: int(rng.integers(0, 40_000))
    a = [(f"F{i}", at(), float(rng.choice([30.0, 30.2, 30.5, 31.0]))) for i in range(200)]
    b = [(f"Q{i}", at(), float(rng.choice([30.0, 30.5, 29.9]))) for i in range(200)]
    for i in range(40):
        when = at()
        a.append((f"G{i}", when, 100.0 + 3 * i))
        b += [(f"P{i}-{k}", when - int(rng.integers(-2000, 11_000)), 100.0 + 3 * i + float(rng.choice([-0.5, 0, 0.5, 0.6]))) for k in range(2)]
    a += [("F-null", at(), None)]
    near = [(f, q) for f, s, x in a if x is not None for q, t, y in b if abs(x - y) <= 0.5 + 1e-12 and -1800 <= s - t <= 10800]
    ones = {p for p in near if sum(p[0] == f for f, _ in near) == 1 and sum(p[1] == q for _, q in near) == 1}
    from pyspark.sql import functions as F

    left = spark.createDataFrame(a, "id string, s long, litres double").withColumn("instant", F.timestamp_seconds("s"))
    right = spark.createDataFrame(b, "id string, s long, loaded double").withColumn("instant", F.timestamp_seconds("s"))
    assert pairs(matching.unique_pairs(left, right)) == ones and len(ones) > 5


def first_cheapest(a, b):
    """All assignments, refuel by refuel in order of id, as the SQL does: least cost, then the first in order of ids."""
    best = None
    refuels = sorted(a)

    def walk(i, cost, taken):
        nonlocal best
        if i == len(refuels):
            key = (round(cost, 9), taken)
            best = key if best is None or key < best else best
            return
        f = refuels[i]
        for q in sorted(b):
            minutes = (a[f][0] - b[q][0]) / 60
            if q not in taken and -matching.MINUTES_AFTER <= minutes <= matching.MINUTES_BEFORE:
                one = float(matching.pair_cost(np.float64(minutes), a[f][1], b[q][1], b[q][2]))
                if one < matching.UNMATCHED_COST:
                    walk(i + 1, cost + one, (*taken, q))
        walk(i + 1, cost + matching.UNMATCHED_COST, (*taken, "~"))

    walk(0, 0.0, ())
    return {(f, q) for f, q in zip(refuels, best[1]) if q != "~"}


def as_group(a, b):
    rows = [(k, i, v[0] * 1_000_000, *v[1:]) for k, side in (("refuel", a), ("request", b)) for i, v in side.items()]
    kind, ids, at, litres, voided = zip(*rows)
    return {"kind": np.array(kind, object), "id": np.array(ids, object), "at": np.array(at, np.int64), "litres": np.array(litres), "voided": np.array(voided)}


@pytest.mark.parametrize("seed", range(60))
def test_ties_go_by_the_ids_whichever_side_bids(seed):
    """Equal times and litres on purpose: many assignments cost the same."""
    rng = np.random.default_rng(seed)
    n, m = (int(x) for x in rng.integers(1, 6, 2))
    at = lambda: int(rng.integers(0, 4)) * 1800
    a = {f"F{i}": (at() + 3600, float(rng.choice([20.0, 40.0])), False) for i in rng.permutation(n)}
    b = {f"Q{i}": (at(), float(rng.choice([20.0, 40.0])), bool(rng.random() < 0.2)) for i in rng.permutation(m)}
    assert set(matching.cheapest_pairs(as_group(a, b))) == first_cheapest(a, b)


MANY = "match_key string, component long, kind string, id string, at long, litres double, voided boolean"


@pytest.mark.parametrize("litres", ["all different", "few values"])
def test_slices_give_the_pairs_of_the_whole(spark, litres):
    """Six components of a week; cut into many slices they are matched as in one piece, ties and all."""
    rng = np.random.default_rng(len(litres))
    drawn = (lambda: float(rng.integers(100, 9000)) / 100) if litres == "all different" else (lambda: float(rng.choice([20.0, 40.0, 41.0])))
    rows, whole = [], set()
    for k in range(6):
        n, m = ((300, 200), (150, 300))[k % 2]
        at = lambda: int(rng.integers(0, 10_080)) * 60  # noqa: E731  whole minutes, so that times are equal too
        a = {f"F{k}-{i:03d}": (at(), drawn(), False) for i in range(n)}
        b = {f"Q{k}-{i:03d}": (at(), drawn(), bool(rng.random() < 0.2)) for i in range(m)}
        rows += [(f"K{k}", 1, kind, i, v[0] * 1_000_000, v[1], v[2]) for kind, side in (("refuel", a), ("request", b)) for i, v in side.items()]
        whole |= set(matching.cheapest_pairs(as_group(a, b)))
    df = spark.createDataFrame(rows, MANY)
    assert pairs(matching.auction_pairs(df, slice_rows=20)) == whole


def test_the_match_does_not_depend_on_what_counts_as_large(spark, vehicles):
    rng = np.random.default_rng(7)
    time = lambda: f"{int(rng.integers(8, 12)):02d}:{int(rng.integers(0, 12)) * 5:02d}:00"
    refuels = typed_refuels(spark.createDataFrame(
        [(f"C{i:02d}", "AA001BB", "T1", None, "PATENTE", "2024-03-05", time(), float(rng.choice([30.0, 31.0, 40.0]))) for i in range(60)], REFUEL))
    requests = typed_requests(spark.createDataFrame(
        [request(f"P{i:02d}", "AA001BB", time(), float(rng.choice([30.0, 40.0])), voided=str(rng.choice(["SI", "NO", "NO"]))) for i in range(50)], REQUEST))
    left, right = matching.keyed_refuels(refuels, vehicles), matching.keyed_requests(requests)
    assert pairs(matching.optimal_pairs(left, right)) == pairs(matching.optimal_pairs(left, right, component_rows=2))


def test_rows_of_the_same_id_are_matched_each(spark):
    rows = [("K", 1, "refuel", "F", 3_600_000_000, 20.0, False)] * 3 + [("K", 1, "request", "Q", 900_000_000, 20.0, False)] * 2
    got = [tuple(r) for r in matching.auction_pairs(spark.createDataFrame(rows, MANY)).collect()]
    group = {c: np.array([r[i] for r in rows], object if c in ("kind", "id") else None) for i, c in ((2, "kind"), (3, "id"), (4, "at"), (5, "litres"), (6, "voided"))}
    assert got == matching.cheapest_pairs(group) == [("F", "Q")] * 2
