"""Linking records to the vehicle register without a shared key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.text import deletion_keys, normalise_id, one_edit_kind
from tallyhound.operators.prepare import PERSONAL
from tallyhound.operators.skew import grown

ENGINE_SIGNS = 8  # fixed value: signs at the end of the engine number that identify a vehicle


def lookup(dim: DataFrame, key: Column, value: Column, key_name: str, value_name: str) -> DataFrame:
    """key -> value with one row per key (the lowest value wins); null and blank keys are left out."""
    pairs = dim.select(key.alias(key_name), value.alias(value_name))
    return pairs.filter(F.col(key_name).isNotNull() & (F.col(key_name).cast("string") != "")).groupBy(key_name).agg(
        F.min(value_name).alias(value_name)
    )


def engine_suffixes(vehicles: DataFrame) -> DataFrame:
    """Last eight signs, and last eight digits, of engine numbers that belong to a single vehicle."""
    engine = normalise_id(F.col("engine_number"))
    digits = F.regexp_replace(engine, r"\D", "")
    tail = lambda c: F.when(F.length(c) >= ENGINE_SIGNS, F.right(c, F.lit(ENGINE_SIGNS)))
    tails = vehicles.select("vehicle_id", F.explode(F.array_distinct(F.array_compact(F.array(tail(engine), tail(digits)))))
                            .alias("__suffix"))
    return tails.groupBy("__suffix").agg(
        F.min("vehicle_id").alias("__by_engine"), F.max("vehicle_id").alias("__max")
    ).filter(F.col("__by_engine") == F.col("__max")).drop("__max")


def link_identifiers(records: DataFrame, column: str, vehicles: DataFrame) -> DataFrame:
    """Add ``linked_vehicle`` and ``link_tier``: ``exacto``, ``normalizado`` or ``motor``, the first that links.

    Linking works on the distinct identifiers, so a much repeated one is looked up once.
    """
    ids = records.select(F.col(column).cast("string").alias("__raw")).filter(F.col("__raw").isNotNull()).distinct()
    ids = ids.withColumn("__norm", normalise_id(F.col("__raw")))
    vehicle = F.col("vehicle_id")
    exact = lookup(vehicles, F.col("plate").cast("string"), vehicle, "__raw", "__by_exact")
    norm = lookup(vehicles, normalise_id(F.col("plate")), vehicle, "__norm", "__by_norm")
    found = ids.join(grown(exact), "__raw", "left").join(grown(norm), "__norm", "left")
    if "engine_number" in vehicles.columns:
        found = found.join(grown(engine_suffixes(vehicles).withColumnRenamed("__suffix", "__norm")), "__norm", "left")
    else:
        found = found.withColumn("__by_engine", F.lit(None).cast(dict(vehicles.dtypes)["vehicle_id"]))
    tiers = found.select(
        F.col("__raw"), F.coalesce("__by_exact", "__by_norm", "__by_engine").alias("linked_vehicle"),
        F.when(F.col("__by_exact").isNotNull(), "exacto").when(F.col("__by_norm").isNotNull(), "normalizado")
        .when(F.col("__by_engine").isNotNull(), "motor").alias("link_tier"),
    ).filter(F.col("link_tier").isNotNull())
    return records.withColumn("__raw", F.col(column).cast("string")).join(grown(tiers), "__raw", "left").drop("__raw")


def with_membership(records: DataFrame, column: str, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a boolean telling whether ``column`` is among the values of ``key`` in another table."""
    known = keys.select(F.col(key).alias(column)).filter(F.col(column).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return records.join(grown(known), column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def cumulative_links(records: DataFrame, column: str, vehicles: DataFrame) -> DataFrame:
    """``link_exact``, ``link_normalised`` and ``link_engine``, each including the tiers before it."""
    linked = link_identifiers(records, column, vehicles)
    tier = F.col("link_tier")
    return linked.withColumns({
        "link_exact": F.coalesce(tier == "exacto", F.lit(False)),
        "link_normalised": F.coalesce(tier.isin("exacto", "normalizado"), F.lit(False)),
        "link_engine": tier.isNotNull(),
    })


def is_personal(refuels: DataFrame) -> Column:
    if "id_type" not in refuels.columns:
        return F.lit(False)
    return F.coalesce(F.col("id_type") == PERSONAL, F.lit(False))


def refuel_links(refuels: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Cumulative links of a refuel: by plate, then also by its card; ``personal`` marks cards of a person."""
    linked = cumulative_links(refuels, "plate", vehicles)
    if "card" in refuels.columns and "card" in vehicles.columns:
        linked = with_membership(linked, "card", vehicles, "card", "__card")
    else:
        linked = linked.withColumn("__card", F.lit(False))
    return linked.withColumns({
        "link_card": F.col("link_engine") | F.col("__card"), "personal": is_personal(refuels),
    }).drop("__card")


def request_links(requests: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Cumulative links of a request: by plate, then also by its vehicle id."""
    linked = cumulative_links(requests, "plate", vehicles)
    if "vehicle_id" not in requests.columns:
        return linked.withColumn("link_vehicle", F.col("link_engine"))
    linked = with_membership(linked, "vehicle_id", vehicles, "vehicle_id", "__own")
    return linked.withColumn("link_vehicle", F.col("link_engine") | F.col("__own")).drop("__own")


def plate_typos(refuels: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Refuels whose unlinked plate is one edit away from the plate of their card's vehicle.

    Returns ``id``, both normalised plates and the kind of edit.
    """
    owners = lookup(vehicles, F.col("card"), normalise_id(F.col("plate")), "card", "own_plate")
    candidates = refuel_links(refuels, vehicles).filter(~F.col("link_normalised") & ~F.col("personal"))
    return candidates.withColumn("written_plate", normalise_id(F.col("plate"))).join(owners, "card").select(
        "id", "written_plate", "own_plate", one_edit_kind(F.col("written_plate"), F.col("own_plate")).alias("edit_kind")
    ).filter(F.col("edit_kind").isNotNull())


def one_edit_matches(codes: DataFrame, register: DataFrame) -> DataFrame:
    """Pairs of ``code`` and ``register_code`` at one edit, found through shared deletion keys.

    Both inputs have one normalised text column (``code`` and ``register_code``). The exploded keys turn
    the comparison into an equi-join; pairs that only share a key are dropped by the exact test.
    """
    left = codes.distinct().withColumn("__key", F.explode(deletion_keys(F.col("code"))))
    right = register.distinct().withColumn("__key", F.explode(deletion_keys(F.col("register_code"))))
    pairs = left.join(grown(right), "__key").drop("__key").withColumn(
        "edit_kind", one_edit_kind(F.col("code"), F.col("register_code"))
    )
    return pairs.filter(F.col("edit_kind").isNotNull()).distinct()


def containment(records: DataFrame, intervals: DataFrame, key: str, date: str, start: str, end: str) -> DataFrame:
    """Records whose date lies in some interval of their key, both ends included."""
    spans = intervals.select(F.col(key), F.col(start).alias("__from"), F.col(end).alias("__to")).dropna()
    r = records.alias("r")
    s = spans.alias("s")
    inside = (F.col(f"r.{key}") == F.col(f"s.{key}")) & F.col(f"r.{date}").between(F.col("s.__from"), F.col("s.__to"))
    return r.join(s, inside, "left_semi")


def exempt_refuels(refuels: DataFrame, vehicles: DataFrame, exemptions: DataFrame | None = None) -> DataFrame:
    """Ids of refuels made while an odometer exemption was in force.

    With the history of exemptions, by date; without it, by the state of the register today.
    """
    if exemptions is not None:
        owner = lookup(vehicles, normalise_id(F.col("plate")), F.col("vehicle_id"), "__norm", "vehicle_id")
        spans = exemptions.withColumn("__norm", normalise_id(F.col("plate"))).join(owner, "__norm")
        return containment(refuels, spans, "vehicle_id", "date", "date_from", "date_to").select("id").distinct()
    if "odometer_exempt" not in vehicles.columns:
        return refuels.select("id").limit(0)
    from tallyhound.functions.dates import parse_date2

    yes = F.upper(F.trim("odometer_exempt")) == "SI"
    limits = vehicles.filter(yes).select("vehicle_id", parse_date2(F.col("exempt_until")).alias("__until")).dropna()
    limits = limits.groupBy("vehicle_id").agg(F.max("__until").alias("__until"))
    return refuels.join(limits, "vehicle_id").filter(F.col("date") <= F.col("__until")).select("id").distinct()
