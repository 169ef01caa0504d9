"""The relational form of a dataset with validity intervals, loads by key and integrity checks."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.functions.text import normalise_id
from tallyhound.operators.linkage import lookup
from tallyhound.operators.prepare import PERSONAL

# The natural key of each table, and the start of what has always been so.
KEYS = {
    "contract": ["contract"], "vehicle": ["vehicle_id"], "vehicle_state": ["vehicle_id", "state", "valid_from"], "card": ["card"],
    "card_assignment": ["card", "valid_from"], "station": ["code"], "device": ["alias"],
    "device_assignment": ["alias", "valid_from"], "exemption": ["vehicle_id", "date_from", "date_to"], "refuel": ["id"],
    "request": ["id"], "transfer": ["id"], "invoice": ["number"], "invoice_line": ["line"], "daily_position": ["vehicle_id", "date"],
}
ALWAYS = "1900-01-01"


def relational_tables(data: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
    """The tables of the relational form. A vehicle that left service has two states, before and since."""
    vehicles, refuels = data["vehicle"], data["refuel"]
    always, open_end = F.lit(ALWAYS).cast("date"), F.lit(None).cast("date")
    changed = F.col("state_date").cast("date")
    state = lambda name, since, until: F.struct(
        name.alias("state"), since.alias("valid_from"), until.alias("valid_to"))
    states = F.when(changed.isNull(), F.array(state(F.col("state"), always, open_end))).otherwise(
        F.array(state(F.lit("EN SERVICIO"), always, changed), state(F.col("state"), changed, open_end)))
    owner = lookup(vehicles, F.col("plate"), F.col("vehicle_id"), "plate", "vehicle_id")
    spelled = lookup(vehicles, normalise_id(F.col("plate")), F.col("vehicle_id"), "__norm", "vehicle_id")

    own_cards = vehicles.filter(F.col("card").isNotNull()).select(
        "card", F.lit("VEHICULO").alias("type"), "contract", "vehicle_id", F.lit(None).cast("string").alias("person"), F.lit(0).alias("__o"))
    used = refuels.filter(F.col("card").isNotNull())
    personal = F.coalesce(F.col("id_type") == PERSONAL, F.lit(False))
    other_cards = used.groupBy("card").agg(
        F.max(personal).alias("__p"), F.min("contract").alias("contract"), F.min(F.when(personal, F.col("driver"))).alias("person"))
    known = own_cards.select("card").distinct()
    other_cards = other_cards.join(known, "card", "left_anti").select(
        "card", F.when(F.col("__p"), "PERSONAL").otherwise("VEHICULO").alias("type"), "contract",
        F.lit(None).cast(dict(vehicles.dtypes)["vehicle_id"]).alias("vehicle_id"), "person", F.when(F.col("__p"), 1).otherwise(2).alias("__o"))
    cards = own_cards.unionByName(other_cards)
    out = {
        "vehicle": vehicles.drop("state", "state_date", "card", "odometer_exempt", "exempt_until"),
        "vehicle_state": vehicles.select("vehicle_id", F.inline(states)),
        "card": cards.groupBy("card").agg(F.min("type").alias("type"), F.min("contract").alias("contract")),
        "card_assignment": cards.filter(F.col("__o") < 2).select(
            "card", "vehicle_id", "person", always.alias("valid_from"), open_end.alias("valid_to")).dropDuplicates(["card"]),
        "refuel": refuels, "contract": data.get("contract"), "station": data.get("station"), "request": data.get("request"),
        "transfer": data.get("transfer"), "invoice": data.get("invoice"), "invoice_line": data.get("invoice_line"),
    }
    if data.get("device") is not None:
        out["device"] = data["device"].drop("plate")
        out["device_assignment"] = data["device"].select("alias", "plate").join(owner, "plate", "left").select(
            "alias", "vehicle_id", always.alias("valid_from"), open_end.alias("valid_to"))
    if data.get("exemption") is not None:
        out["exemption"] = data["exemption"].withColumn("__norm", normalise_id(F.col("plate"))).join(spelled, "__norm", "left").drop(
            "__norm", "plate")
    if data.get("daily_track") is not None:
        out["daily_position"] = data["daily_track"].join(owner, "plate", "left").drop("plate")
    return {k: v for k, v in out.items() if v is not None}


def load_until(tables: dict[str, DataFrame], date: str) -> dict[str, DataFrame]:
    """Operational tables up to a date; invoice lines follow the invoices that stay."""
    out = dict(tables)
    for name in ("refuel", "request", "transfer", "daily_position", "invoice"):
        if name in out and "date" in out[name].columns:
            out[name] = out[name].filter(F.col("date").cast("string") <= date)
    if "invoice_line" in out and "invoice" in out:
        out["invoice_line"] = out["invoice_line"].join(out["invoice"].select("number").distinct(), "number", "left_semi")
    return out


def upsert(target: DataFrame | None, rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The target with ``rows`` put in by key; a later row of a key replaces the one there.

    ``order`` tells which of several new rows of a key is the last, nulls before all; without it their content
    decides, so the result does not depend on how the rows are dealt out.
    """
    rest = [c for c in rows.columns if c not in key]
    last = F.max(F.struct(*[F.col(c) for c in order or []], *rest)).alias("__last")
    fresh = rows.groupBy(*key).agg(last).select(*[F.col(c) if c in key else F.col(f"__last.{c}") for c in rows.columns]) if rest else rows.distinct()
    return fresh if target is None else target.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


class KeyedTables:
    """Tables in a shared folder that loads put rows into by key, as Parquet partitioned by a hash bucket of the key.

    A load reads and rewrites the buckets that its rows fall into, by Spark's dynamic partition overwrite, and leaves
    the others alone. Old and new rows of a bucket meet in one task, so choose ``buckets``, which stay the same for the
    life of the folder, by the size a table will reach. Tasks may fail and be repeated; if the driver itself dies while
    Spark puts finished buckets in place, run that load again from its whole source.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        from tallyhound.sources.dataset import path_exists

        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._exists = lambda path: path_exists(spark, path)
        if self._exists(f"{self.folder}/_loads"):
            before = spark.read.json(f"{self.folder}/_loads").agg(F.max("buckets")).first()[0]
            if before != buckets:
                raise ValueError(f"the folder has {before} buckets, not {buckets}")

    def _stored(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        return self.spark.read.parquet(path) if self._exists(path) else None

    def read(self, name: str) -> DataFrame | None:
        """The table as it is now; None where nothing was loaded."""
        stored = self._stored(name)
        return None if stored is None else stored.drop("__bucket")

    def load(self, tables: dict[str, DataFrame], origin: str, until: str | None = None,
             keys: dict[str, list[str]] | None = None, order: dict[str, list[str]] | None = None) -> dict[str, int]:
        """Put the tables in by their keys and append a row to the load log; returns the rows put into each table.

        A new row replaces the one of its key. With ``order``, per table columns that tell which row of a key is the
        last (nulls before all), a row that arrives late leaves the later one there. Null keys are equal. Rows that tell apart in nothing
        else are chosen by content, so the result does not depend on how the rows are dealt out.
        """
        counts = {}
        for name, rows in tables.items():
            key = (keys or KEYS)[name]
            fresh = rows.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int"))
            touched = {b: n for b, n in fresh.groupBy("__bucket").count().collect()}  # at most ``buckets`` rows
            counts[name] = sum(touched.values())
            if not touched:
                continue
            both, stored = fresh.withColumn("__new", F.lit(1)), self._stored(name)
            if stored is not None:
                kept = stored.filter(F.col("__bucket").isin(list(touched))).withColumn("__new", F.lit(0))
                both = both.unionByName(kept, allowMissingColumns=True)
            rest = [c for c in both.columns if c not in {*key, "__bucket", "__new"}]
            last = F.max(F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate((order or {}).get(name, []))], "__new", *rest)).alias("__last")
            merged = both.repartition("__bucket").groupBy("__bucket", *key).agg(last)
            merged = merged.select(*key, *[F.col("__last")[c].alias(c) for c in rest], "__bucket")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(f"{self.folder}/{name}")
        stamp = datetime.now(timezone.utc).isoformat(timespec="microseconds")
        self.spark.createDataFrame(
            [(stamp, origin, until, json.dumps(counts), self.buckets)], "instant string, origin string, until string, rows string, buckets int"
        ).coalesce(1).write.mode("append").json(f"{self.folder}/_loads")
        return counts


RELATIONS = [
    ("card_assignment", "card", "card", "card"), ("card_assignment", "vehicle_id", "vehicle", "vehicle_id"),
    ("vehicle_state", "vehicle_id", "vehicle", "vehicle_id"), ("device_assignment", "alias", "device", "alias"),
    ("device_assignment", "vehicle_id", "vehicle", "vehicle_id"), ("exemption", "vehicle_id", "vehicle", "vehicle_id"),
    ("refuel", "vehicle_id", "vehicle", "vehicle_id"), ("refuel", "card", "card", "card"),
    ("request", "vehicle_id", "vehicle", "vehicle_id"), ("transfer", "from_contract", "contract", "contract"),
    ("transfer", "to_contract", "contract", "contract"), ("invoice_line", "number", "invoice", "number"),
    ("daily_position", "vehicle_id", "vehicle", "vehicle_id"),
]


def check_integrity(tables: dict[str, DataFrame], relations: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Rows per relation whose key has no parent: ``child, column, parent, orphans``; only broken ones."""
    out = None
    for child, column, parent, key in relations or RELATIONS:
        if child not in tables or parent not in tables:
            continue
        keys = tables[parent].select(F.col(key).alias(column)).distinct()
        orphans = tables[child].filter(F.col(column).isNotNull()).join(keys, column, "left_anti").agg(
            F.count(F.lit(1)).alias("orphans")).select(
            F.lit(child).alias("child"), F.lit(column).alias("column"), F.lit(parent).alias("parent"), "orphans")
        out = orphans if out is None else out.unionByName(orphans)
    return out.filter(F.col("orphans") > 0)


def repeated_active_exemptions(exemptions: DataFrame) -> DataFrame:
    """Vehicles with more than one active exemption."""
    return exemptions.filter(F.col("active") == "SI").groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("active")).filter(
        F.col("active") > 1)


def written_off_active(tables: dict[str, DataFrame], days: int = 7) -> DataFrame:
    """Written-off vehicles whose device still transmits, over the current intervals of the relational form."""
    state = tables["vehicle_state"].filter(F.col("valid_to").isNull() & F.col("state").contains("BAJA"))
    assigned = tables["device_assignment"].filter(F.col("valid_to").isNull() & F.col("vehicle_id").isNotNull())
    at = F.col("last_contact").try_cast("timestamp")
    latest = tables["device"].select(at.alias("at")).agg(F.max("at")).scalar()
    recent = tables["device"].filter(F.unix_seconds(latest) - F.unix_seconds(at) <= days * 86_400)
    return tables["vehicle"].join(state, "vehicle_id").join(assigned.select("vehicle_id", "alias"), "vehicle_id").join(
        recent, "alias").select("vehicle_id", "plate", "state", "alias", "device_group", "last_contact")
