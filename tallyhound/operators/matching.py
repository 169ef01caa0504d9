"""One-to-one matching of refuels with the requests of the internal register; they share no identifier."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.text import normalise_id
from tallyhound.operators.assignment import ALONE, ELSEWHERE, Assignment
from tallyhound.operators.linkage import is_personal, lookup, refuel_links
from tallyhound.operators.prepare import OFF_NETWORK
from tallyhound.operators.rangejoin import bucketed_range_join
from tallyhound.operators.runs import over_groups
from tallyhound.operators.sequence import without
from tallyhound.operators.settle import settle
from tallyhound.operators.skew import OrderedGroups, grown, per_heat, split_by_heat

# The window and the cost of a pair.
MINUTES_BEFORE = 180
MINUTES_AFTER = 30
USUAL_MINUTES = 45
UNMATCHED_COST = 5.0
LITRES_TOLERANCE = 0.5

# Costs are compared in whole numbers, so that equal ones are equal however they are added up.
GRAIN = 1000  # parts of a microsecond of the time between refuel and request
COST_UNIT = 3_600_000_000 * GRAIN  # a cost of one
EPSILON = 1 / COST_UNIT  # the least difference between costs

COMPONENT_ROWS = 2000  # larger components are matched slice by slice, with the same result
REACH_MICROS = (MINUTES_BEFORE + MINUTES_AFTER) * 60_000_000
SLICE_MICROS = 4 * REACH_MICROS  # the shortest slice
SLICE_ROWS = 50_000  # about as many rows as one of its tasks takes


def assign(cost: np.ndarray, unmatched: float = UNMATCHED_COST) -> np.ndarray:
    """Cheapest assignment of rows to columns; -1 where a row is better left alone at ``unmatched``. Impossible pairs are infinite."""
    weight = np.rint(np.maximum(unmatched - cost, 0) * COST_UNIT).astype(np.int64)
    n, m = weight.shape
    solved = Assignment(np.full(n, -1), np.zeros(m, np.int64), np.full(n, ALONE), np.full(m, ALONE), lambda i: (0, weight[i]))
    for i in range(n):
        solved.place(i)
    return solved.a


def pair_cost(minutes, litres, loaded, voided):
    """Cost of a pair, for columns and for numpy alike apart from the absolute value and the maximum."""
    if isinstance(minutes, Column):
        return (
            F.abs(minutes - USUAL_MINUTES) / 60 + F.abs(litres - loaded) * 2 / F.greatest(litres, F.lit(1.0))
            + F.when(voided, 2.0).otherwise(0.0)
        )
    return np.abs(minutes - USUAL_MINUTES) / 60 + 2 * np.abs(litres - loaded) / np.maximum(litres, 1) + 2 * voided


def keyed_refuels(refuels: DataFrame, vehicles: DataFrame | None, excluded: DataFrame | None = None) -> DataFrame:
    """Refuels with the match key: the person of a personal card, else the plate of the card's vehicle."""
    rows = without(refuels, excluded)
    plate = F.col("plate")
    if vehicles is not None and "card" in vehicles.columns and "card" in refuels.columns:
        owners = lookup(vehicles, F.col("card"), F.col("plate"), "card", "__owner_plate")
        rows = rows.join(grown(owners), "card", "left")
        plate = F.coalesce("__owner_plate", "plate")
    key = F.when(is_personal(rows), F.concat(F.lit("P:"), F.col("driver"))).otherwise(
        F.concat(F.lit("D:"), normalise_id(plate)))
    return rows.withColumn("match_key", key).drop("__owner_plate")


def keyed_requests(requests: DataFrame) -> DataFrame:
    """Requests of the supplier's own network with their match key."""
    person = F.coalesce(F.upper(F.col("personal_card").cast("string")) == "TRUE", F.lit(False))
    key = F.when(person, F.concat(F.lit("P:"), F.col("requester"))).otherwise(
        F.concat(F.lit("D:"), normalise_id(F.col("plate"))))
    return requests.filter(~F.col("station").eqNullSafe(F.lit(OFF_NETWORK))).withColumns(
        {"match_key": key, "by_person": person})


def match_components(refuels: DataFrame, requests: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Refuels and requests of each key cut into components that no candidate pair crosses.

    A refuel covers the request times it could take; components are the runs of overlapping cover. Returns
    ``match_key, component, kind, id, instant, litres, voided`` and how the row stands in its component.
    """
    none = F.lit(None).cast("double")
    start = F.timestamp_seconds(F.unix_seconds("instant") - MINUTES_BEFORE * 60)
    rows = refuels.select(
        "match_key", F.lit("refuel").alias("kind"), "id", "instant", F.col("litres").cast("double").alias("litres"),
        F.lit(False).alias("voided"), start.alias("start"),
        (F.unix_seconds("instant") + MINUTES_AFTER * 60).alias("end"),
    ).unionByName(requests.select(
        "match_key", F.lit("request").alias("kind"), "id", "instant", F.col("loaded").cast("double").alias("litres"),
        F.col("is_voided").alias("voided"), F.col("instant").alias("start"), F.unix_seconds("instant").alias("end"),
    )).filter(F.col("match_key").isNotNull() & F.col("instant").isNotNull() & F.col("litres").isNotNull())
    groups = OrderedGroups(["match_key"], ["start", "kind", "id"])

    def body(part: DataFrame, hot: bool) -> DataFrame:
        part = groups.running(part, {"__reach": ("max", F.col("end"), False)}, hot)
        opens = F.coalesce((F.unix_seconds("start") > F.col("__reach")).cast("long"), F.lit(1))
        part = groups.running(part, {"component": ("sum", opens.cast("long"), True)}, hot)
        record = F.struct("kind", "id", "instant", "litres", "voided")
        return groups.neighbours(part, {
            "__before": (F.col("component"), 1), "__before2": (F.col("component"), 2), "__after": (F.col("component"), -1),
            "__after2": (F.col("component"), -2), "partner": (record, -1),
        }, hot)

    same = lambda c: F.coalesce(F.col(c) == F.col("component"), F.lit(False))
    out = per_heat(rows, ["match_key"], body, hot_rows)
    return out.withColumns({
        "heads_pair": ~same("__before") & same("__after") & ~same("__after2"),
        "ends_pair": same("__before") & ~same("__before2") & ~same("__after"),
        "alone": ~same("__before") & ~same("__after"),
    }).drop("__reach", "start", "end", "__before", "__before2", "__after", "__after2")


def pair_weights(a: dict[str, np.ndarray], b: dict[str, np.ndarray], a_refuels: bool) -> Callable[[int], tuple[int, np.ndarray]]:
    """For ``Assignment``: what a match with each row of ``b`` saves the row of ``a``, as whole parts of ``COST_UNIT``; both are in order of time."""
    before, after = (MINUTES_BEFORE, MINUTES_AFTER) if a_refuels else (MINUTES_AFTER, MINUTES_BEFORE)
    low = np.searchsorted(b["at"], a["at"] - before * 60_000_000, side="left").tolist()
    high = np.searchsorted(b["at"], a["at"] + after * 60_000_000, side="right").tolist()
    usual, most = USUAL_MINUTES * 60_000_000, int(UNMATCHED_COST)
    loss = 2 * COST_UNIT * (a if not a_refuels else b)["voided"].astype(np.int64)
    sign = 1 if a_refuels else -1
    shift = sign * a["at"] - usual  # minus or plus the other's time: the minutes off the usual ones
    kept: dict[int, np.ndarray] = {}
    room = 2_000_000  # weights that are kept

    def weights(i: int) -> tuple[int, np.ndarray]:
        nonlocal room
        if i in kept:
            return low[i], kept[i]
        seen = slice(low[i], high[i])
        litres, loaded = (a["litres"][i], b["litres"][seen]) if a_refuels else (b["litres"][seen], a["litres"][i])
        off = 2 * np.abs(litres - loaded) / np.maximum(litres, 1)
        off = np.rint(np.where(off < most, off, most) * COST_UNIT).astype(np.int64)
        weight = most * COST_UNIT - np.abs(shift[i] - sign * b["at"][seen]) * GRAIN - off - (loss[seen] if a_refuels else loss[i])
        if len(weight) <= room:
            kept[i] = weight
            room -= len(weight)
        return low[i], weight

    return weights


def _sides(group: dict[str, np.ndarray], is_bidder: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Bidders and the others, each in order of time; ``place`` of a row by its id."""
    out = []
    for side in (np.flatnonzero(is_bidder), np.flatnonzero(~is_bidder)):
        rows = {c: v[side] for c, v in group.items()}
        order = np.lexsort((rows["id"], rows["at"]))
        rows = {c: v[order] for c, v in rows.items()}
        rows["place"] = np.empty(len(order), np.int64)
        rows["place"][np.argsort(rows["id"], kind="stable")] = np.arange(len(order))
        out.append(rows)
    return out[0], out[1]


def cheapest_pairs(group: dict[str, np.ndarray]) -> list[tuple]:
    """The cheapest pairs of a component: ``id`` of the refuel and of the request.

    Of equally cheap ones the first in order of ids: each refuel, by its id, takes the request of the smallest id that it can.
    """
    is_refuel = group["kind"] == "refuel"
    refuels = int(is_refuel.sum())
    if not 0 < refuels < len(is_refuel):
        return []
    a_refuels = 2 * refuels <= len(is_refuel)
    a, b = _sides(group, is_refuel if a_refuels else ~is_refuel)
    n, m = len(a["at"]), len(b["at"])
    solved = Assignment(np.full(n, -1), np.zeros(m, np.int64), np.full(n, ALONE), np.full(m, ALONE), pair_weights(a, b, a_refuels))
    for i in range(n):
        solved.place(i)
    solved.settle_ties(list(range(n)), None, a["place"], b["place"], a_refuels)
    pairs = [(a["id"][i], b["id"][j]) for i, j in enumerate(solved.a.tolist()) if j >= 0]
    return pairs if a_refuels else [(f, q) for q, f in pairs]


_SLICED = ("match_key string, component long, kind string, id string, at long, litres double, voided boolean, row long, bids boolean, worth long, "
           "partner long, done boolean, origin long, length long, rows long")


def _matching_slices(half: int, ties: bool):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["done"].all():
            return pdf[_SLICED_COLUMNS]
        pdf = pdf.sort_values(["at", "id", "row"], kind="stable").reset_index(drop=True)
        bids = pdf["bids"].to_numpy(dtype=bool)
        pdf = pd.concat([pdf[bids], pdf[~bids]], ignore_index=True)
        n = int(bids.sum())
        columns = {c: pdf[c].to_numpy(dtype=None if c != "voided" else bool) for c in ("id", "at", "litres", "voided", "row")}
        a, b = {c: v[:n] for c, v in columns.items()}, {c: v[n:] for c, v in columns.items()}
        a_refuels = n > 0 and pdf["kind"].iloc[0] == "refuel"
        origin, length, entire = int(pdf["origin"].iloc[0]), int(pdf["length"].iloc[0]), len(pdf) == int(pdf["rows"].iloc[0])
        shift = half * (length // 2) - origin
        start = (int(columns["at"].min()) + shift) // length * length - shift
        within = lambda at, before, after: (at - before >= start) & (at + after < start + length) | entire
        minute = 60_000_000
        before, after = (MINUTES_BEFORE, MINUTES_AFTER) if a_refuels else (MINUTES_AFTER, MINUTES_BEFORE)
        inside = within(a["at"], before * minute, after * minute)
        closed = within(b["at"], REACH_MICROS, REACH_MICROS)
        worth, partner, done = pdf["worth"].to_numpy(copy=True), pdf["partner"].to_numpy(copy=True), pdf["done"].to_numpy(dtype=bool, copy=True)
        number = {x: i for i, x in enumerate(b["row"].tolist())} | {x: i for i, x in enumerate(a["row"].tolist())}
        held = np.array([ALONE if x < 0 else number.get(x, ELSEWHERE) for x in partner.tolist()], np.int64)
        was = held.copy()
        solved = Assignment(worth[:n], worth[n:], held[:n], held[n:], pair_weights(a, b, a_refuels), inside)
        if not ties:
            for i in np.flatnonzero((solved.a == ALONE) & (solved.worth != 0)).tolist():
                solved.place(i)
        if ties or entire:
            place = lambda side: np.argsort(np.lexsort((side["row"], side["id"])))
            waiting = np.flatnonzero(~done[:n]).tolist()
            done[solved.settle_ties(waiting, None if entire else closed, place(a), place(b), a_refuels)] = True
            done[n:] |= entire
        changed = np.flatnonzero(held != was)
        other = np.concatenate([b["row"][np.maximum(held[:n], 0)] if len(b["row"]) else held[:n], a["row"][np.maximum(held[n:], 0)] if n else held[n:]])
        partner[changed] = np.where(held[changed] < 0, -1, other[changed])
        pdf["worth"], pdf["partner"], pdf["done"] = worth, partner, done
        return pdf[_SLICED_COLUMNS]

    return work


_SLICED_COLUMNS = [c.split()[0] for c in _SLICED.split(", ")]


def auction_pairs(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Cheapest one-to-one pairs of components of any size, those of ``cheapest_pairs``: ``refuel_id, request_id``.

    ``rows`` has ``match_key, component, kind, id, at`` (microseconds), ``litres, voided``. The side of a component with fewer rows bids
    for rows of the other. Time is cut into slices of about ``slice_rows`` rows, at least four times as long as a bidder's reach, and
    in every other round the cuts lie half a slice later. A slice places the bidders whose augmenting paths lie within
    it, with the prices as they stand, which no other task changes then; what is left meets other cuts, and slices twice as long every
    two rounds. So every step is one of the exact method, and the end is the least cost. Then ties are settled in the same way, by groups
    of tied rows. A task holds the rows of one slice, never pairs; only a path or a tie that spans more rows asks for longer slices.
    """
    keys = ["match_key", "component"]
    refuel = F.col("kind") == "refuel"
    # Slices start well before the first row and end well after the last, so that a single one holds every window.
    units = F.floor((F.max("at") - F.min("at")) / SLICE_MICROS) + 3
    slices = F.ceil(F.count(F.lit(1)) / slice_rows)
    sides = rows.groupBy(*keys).agg(
        (F.count_if(refuel) <= F.count_if(~refuel)).alias("few"), (F.min("at") - SLICE_MICROS).alias("origin"),
        (F.greatest(F.ceil(units / slices), F.lit(1)) * SLICE_MICROS).cast("long").alias("least"), F.count(F.lit(1)).alias("rows"))
    bids = refuel == F.col("few")
    state = settle(rows.join(sides, keys).select(
        *keys, "kind", "id", "at", "litres", "voided", F.monotonically_increasing_id().alias("row"), bids.alias("bids"),
        F.when(bids, -1).otherwise(0).cast("long").alias("worth"), F.lit(-1).cast("long").alias("partner"), F.lit(False).alias("done"),
        "origin", "least", "rows"))
    lengths = state.select(*keys, "least").distinct()
    state, half, factor, ties = state.drop("least"), 0, 1, False
    while True:
        sliced = state.join(lengths.withColumn("length", F.col("least") * factor), keys).withColumn(
            "slice", F.expr(f"(at - origin + {half} * (length div 2)) div length"))
        state = settle(sliced.groupBy(*keys, "slice").applyInPandas(_matching_slices(half, ties), _SLICED)).drop("length")
        waiting = state.filter("bids and not done").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("partner < 0 and worth <> 0")).alias("open")).first()
        if not waiting["n"]:
            break
        if not ties and not waiting["open"]:
            half, factor, ties = 0, 1, True
            continue
        factor, half = factor * (1 + half), 1 - half
    taken = state.filter("bids and partner >= 0").select(*keys, F.col("partner").alias("row"), F.col("id").alias("mine"), F.col("kind").alias("by"))
    pairs = state.filter("not bids").join(taken, [*keys, "row"])
    mine = F.col("by") == "refuel"
    return pairs.select(F.when(mine, F.col("mine")).otherwise(F.col("id")).alias("refuel_id"), F.when(mine, F.col("id")).otherwise(F.col("mine")).alias("request_id"))


def optimal_pairs(refuels: DataFrame, requests: DataFrame, hot_rows: int | None = None, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """Cheapest one-to-one pairs per component, of equally cheap ones the first in order of ids: ``refuel_id, request_id``.

    A component of two rows is settled by an expression; larger ones go to Python, one at a time, and those above
    ``component_rows`` in slices, which gives the same pairs.
    """
    rows = match_components(refuels, requests, hot_rows)
    in_pair = F.col("heads_pair") | F.col("ends_pair")
    rows = settle(rows.filter(~F.col("alone") & (F.col("heads_pair") | ~in_pair)))
    mine = F.struct("kind", "id", "instant", "litres", "voided")
    first = F.col("kind") == "refuel"
    pair = rows.filter(F.col("heads_pair") & (F.col("kind") != F.col("partner.kind"))).select(
        F.when(first, mine).otherwise(F.col("partner")).alias("a"), F.when(first, F.col("partner")).otherwise(mine).alias("b"))
    minutes = (F.unix_micros("a.instant") - F.unix_micros("b.instant")) / 60e6
    single = pair.filter(
        minutes.between(-MINUTES_AFTER, MINUTES_BEFORE)
        & (pair_cost(minutes, F.col("a.litres"), F.col("b.litres"), F.col("b.voided")) < UNMATCHED_COST)
    ).select(F.col("a.id").alias("refuel_id"), F.col("b.id").alias("request_id"))

    many = rows.filter(~F.col("heads_pair")).select(
        "match_key", "component", "kind", "id", F.unix_micros("instant").alias("at"), "litres", "voided")
    keys = ["match_key", "component"]
    many, large = split_by_heat(many, keys, component_rows)
    out = single.unionByName(over_groups(many, keys, ["at", "id"], cheapest_pairs, "refuel_id string, request_id string"))
    return out if large is None else out.unionByName(auction_pairs(large))


def _without_crowd(rows: DataFrame, at: str, litres: str, others: DataFrame, other_at: str, other_litres: str, halves: range) -> DataFrame:
    """``rows`` without those sure to have several candidates: two others in their own litre band and in ``halves``.

    Counts others per half hour and band and adds up the half hours (relative to the row's own) that the window of any row covers in
    full, so the work grows with rows and cells, not with pairs.
    """
    half = lambda c: F.floor(F.unix_seconds(c) / 1800).cast("long")
    band = lambda c: F.floor(F.col(c) / LITRES_TOLERANCE).cast("long")
    cells = others.groupBy(half(other_at).alias("__half"), band(other_litres).alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    seen = cells.select(F.explode(F.array(*[F.col("__half") - d for d in halves])).alias("__half"), "__cell", "__n")
    crowded = seen.groupBy("__half", "__cell").agg(F.sum("__n").alias("__n")).filter(F.col("__n") > 1).drop("__n")
    marked = rows.withColumns({"__half": half(at), "__cell": band(litres)})
    return marked.join(crowded, ["__half", "__cell"], "left_anti").drop("__half", "__cell")


def unique_pairs(refuels: DataFrame, requests: DataFrame) -> DataFrame:
    """Pairs by time and litres alone, where each is the other's only candidate: ``refuel_id, request_id``.

    Refuels and requests that are sure to have several candidates are counted out first, so that only the
    others are joined: dense hours give counts, not pairs.
    """
    width = LITRES_TOLERANCE
    left = settle(refuels.filter(F.col("instant").isNotNull() & F.col("litres").isNotNull()).select(
        F.col("id").alias("refuel_id"), F.col("instant").alias("__at"), F.col("litres").alias("__litres")))
    right = settle(requests.filter(F.col("instant").isNotNull() & F.col("loaded").isNotNull()).select(
        F.col("id").alias("request_id"), F.col("instant").alias("__asked"), F.col("loaded").alias("__loaded")))
    before, after = MINUTES_BEFORE // 30, MINUTES_AFTER // 30

    def candidates(some: DataFrame, others: DataFrame) -> DataFrame:
        banded = some.withColumn("__band", F.explode(F.array(*[F.floor(F.col("__litres") / width) + d for d in (-1, 0, 1)])))
        pairs = bucketed_range_join(banded, others.withColumn("__band", F.floor(F.col("__loaded") / width)), "__at", "__asked", ["__band"],
                                    -MINUTES_AFTER * 60, MINUTES_BEFORE * 60, F.abs(F.col("__litres") - F.col("__loaded")) <= width)
        return pairs.select("refuel_id", "request_id")

    # A refuel sees the half hours from ``before - 1`` ahead of its own to its own in full, a request the next ``before - 1``.
    few = _without_crowd(left, "__at", "__litres", right, "__asked", "__loaded", range(1 - before, after))
    alone = candidates(few, right).groupBy("refuel_id").agg(F.count(F.lit(1)).alias("n"), F.min("request_id").alias("request_id"))
    alone = settle(alone.filter(F.col("n") == 1).select("refuel_id", "request_id"))
    sought = right.join(alone.select("request_id").distinct(), "request_id", "left_semi")
    sought = _without_crowd(sought, "__asked", "__loaded", left, "__at", "__litres", range(after, before))
    wanted = candidates(left, sought).groupBy("request_id").agg(F.count(F.lit(1)).alias("m"))
    return alone.join(wanted.filter(F.col("m") == 1), "request_id").select("refuel_id", "request_id")


def context_pairs(refuels: DataFrame, requests: DataFrame, vehicles: DataFrame | None = None,
                  excluded: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """All pairs of the match with context: the optimal ones, then unlinked refuels by time and litres."""
    left, right = keyed_refuels(refuels, vehicles, excluded), keyed_requests(requests)
    pairs = settle(optimal_pairs(left, right, hot_rows))
    if vehicles is None:
        return pairs
    open_refuels = refuel_links(without(refuels, excluded), vehicles).filter(~F.col("link_card") & ~F.col("personal"))
    open_refuels = open_refuels.join(pairs.select(F.col("refuel_id").alias("id")), "id", "left_anti")
    open_requests = right.filter(~F.col("by_person")).join(pairs.select(F.col("request_id").alias("id")), "id", "left_anti")
    return pairs.unionByName(unique_pairs(open_refuels, open_requests))


def nearest_in_turn(group: dict[str, np.ndarray]) -> list[tuple]:
    """Each request, in the order given, takes the nearest free refuel; of equally near ones that with the smaller id.

    Refuels are kept in order of time with links to the next free one on either side, so n rows take about n log n steps.
    """
    is_refuel = group["kind"] == "refuel"
    order = np.lexsort((group["id"][is_refuel], group["at"][is_refuel]))
    at, ids = group["at"][is_refuel][order].tolist(), group["id"][is_refuel][order].tolist()
    n = len(at)
    right, left = list(range(n + 1)), list(range(n + 1))  # left is shifted by one: place 0 stands for nothing

    def free(links: list[int], i: int) -> int:
        end = i
        while links[end] != end:
            end = links[end]
        while links[i] != end:
            links[i], i = end, links[i]
        return end

    out = []
    for request, when in zip(group["id"][~is_refuel].tolist(), group["at"][~is_refuel].tolist()):
        place = bisect_right(at, when)
        before, after = free(left, place) - 1, free(right, place)
        if before < 0 and after == n:
            break
        if before >= 0:
            before = free(right, bisect_left(at, at[before]))  # the smallest id of that instant
        near = before if after == n else after if before < 0 else min((when - at[before], ids[before], before), (at[after] - when, ids[after], after))[2]
        right[near], left[near + 1] = near + 1, near
        out.append((ids[near], request))
    return out


def greedy_day_pairs(refuels: DataFrame, requests: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """The match of an operating system: each settled request, in order of id, takes the nearest refuel of its
    plate and day that is still free, however far in time; ``refuel_id, request_id``.
    """
    left = without(refuels, excluded).filter(~is_personal(refuels)).select(
        normalise_id(F.col("plate")).alias("plate"), F.to_date("instant").alias("day"), F.lit("refuel").alias("kind"), "id",
        "instant")
    right = requests.filter(
        ~F.col("station").eqNullSafe(F.lit(OFF_NETWORK)) & F.col("is_settled") & ~F.col("is_voided")
    ).select(normalise_id(F.col("plate")).alias("plate"), F.to_date("instant").alias("day"), F.lit("request").alias("kind"),
             "id", "instant")
    rows = left.unionByName(right).filter(F.col("plate").isNotNull() & F.col("day").isNotNull())
    is_refuel = F.col("kind") == "refuel"
    groups = rows.groupBy("plate", "day").agg(
        F.count_if(is_refuel).alias("n"), F.count_if(~is_refuel).alias("m"),
        F.min(F.when(is_refuel, F.col("id"))).alias("a"), F.min(F.when(~is_refuel, F.col("id"))).alias("b"),
    ).filter((F.col("n") > 0) & (F.col("m") > 0))
    single = groups.filter((F.col("n") == 1) & (F.col("m") == 1)).select(
        F.col("a").alias("refuel_id"), F.col("b").alias("request_id"))

    several = groups.filter((F.col("n") > 1) | (F.col("m") > 1)).select("plate", "day")
    many = rows.join(several, ["plate", "day"], "left_semi").select("plate", "day", "kind", "id", F.unix_micros("instant").alias("at"))
    return single.unionByName(over_groups(many, ["plate", "day"], ["id"], nearest_in_turn, "refuel_id string, request_id string"))


def matched_refuels(refuels: DataFrame, requests: DataFrame, pairs: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Every refuel with the fields of its request, null without one."""
    fields = requests.select(
        F.col("id").alias("request_id"), F.col("is_voided").alias("request_voided"), F.col("is_settled").alias("request_settled"),
        F.col("loaded").cast("double").alias("request_litres"), F.col("authorised").cast("double").alias("request_authorised"))
    found = pairs.join(fields, "request_id").withColumnRenamed("refuel_id", "id")
    return without(refuels, excluded).select("id", "litres").join(found, "id", "left")


def unserved_requests(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Settled requests, not voided and of the own network, that no refuel took."""
    return requests.filter(
        ~F.col("station").eqNullSafe(F.lit(OFF_NETWORK)) & F.col("is_settled") & ~F.col("is_voided")
    ).join(pairs.select(F.col("request_id").alias("id")), "id", "left_anti")
