"""Ordered and grouped work that survives a key holding a large share of all rows.

A window or a median partitioned by one key puts all rows of that key into one task. The helpers here
split the input into the keys of ordinary size, which take the plain window, and the few keys above
``hot_rows``, which are worked on in slices of time and stitched together at the slice edges. Both
paths give the same result; without hot keys only the plain one is planned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.operators.settle import settle

HOT_ROWS = 5_000_000
SLICE_SECONDS = 86_400


def grown(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: joined by a shuffle, whatever its size looks like.

    Shuffled rows are weighed packed; as a broadcast table in the driver they take up to a hundred times as much.
    """
    return df.hint("merge")


def split_by_heat(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None). Rows with a null key count as ordinary.

    The keys are counted first, reading the key columns only, whatever the size of the input. Without hot keys
    the plan stays as it was.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    heat = settle(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > hot_rows).select(*keys)
    )
    if heat.isEmpty():
        return df, None
    return df.join(heat, keys, "left_anti"), df.join(heat, keys, "left_semi")


def per_heat(
    df: DataFrame, keys: list[str], body: Callable[[DataFrame, bool], DataFrame], hot_rows: int | None = None
) -> DataFrame:
    """Apply ``body(rows, hot)`` to the ordinary and to the hot keys and put both results together."""
    cold, hot = split_by_heat(df, keys, hot_rows)
    return body(cold, False) if hot is None else body(cold, False).unionByName(body(hot, True))


class OrderedGroups:
    """Rows grouped by ``keys`` and ordered by ``order``; the first order column is an instant, never null.

    ``order`` names columns that together give a total order inside a group.
    """

    def __init__(self, keys: list[str], order: list[str], slice_seconds: int = SLICE_SECONDS):
        self.keys, self.order, self.slice_seconds = keys, order, slice_seconds

    def window(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def _sliced(self, df: DataFrame) -> DataFrame:
        seconds = F.unix_seconds(F.col(self.order[0]).cast("timestamp"))
        return df.withColumn("__slice", F.floor(seconds / self.slice_seconds).cast("long"))

    def neighbours(self, df: DataFrame, picks: dict[str, tuple[Column, int]], hot: bool) -> DataFrame:
        """Add columns holding an expression of the n-th previous (n > 0) or next (n < 0) row."""
        w = self.window()
        if not hot:
            return df.select("*", *[F.lag(e, n).over(w).alias(name) for name, (e, n) in picks.items()])
        reach = max(abs(n) for _, n in picks.values())
        sliced = self._sliced(df)
        for i, (expr, _) in enumerate(picks.values()):
            sliced = sliced.withColumn(f"__v{i}", expr)
        ws = Window.partitionBy(*self.keys, "__slice").orderBy(*self.order)
        marks = {n for _, n in picks.values()} | {reach, -reach}
        inner = sliced.select(
            "*",
            *[F.lag(f"__v{i}", n).over(ws).alias(name) for i, (name, (_, n)) in enumerate(picks.items())],
            *[F.lag(F.lit(1), n).over(ws).isNotNull().alias(f"__in{n}") for n in marks],
        )
        # The first and last ``reach`` rows of every slice see across edges. They form one group per key, a few
        # rows per slice; all other rows stay grouped by their slice.
        at_edge = ~F.col(f"__in{reach}") | ~F.col(f"__in{-reach}")
        inner = inner.withColumn("__part", F.when(~at_edge, F.col("__slice")))
        across = Window.partitionBy(*self.keys, "__part").orderBy(*self.order)
        fixed = [
            F.when(F.col("__part").isNotNull() | F.col(f"__in{n}"), F.col(name))
            .otherwise(F.lag(f"__v{i}", n).over(across)).alias(name)
            for i, (name, (_, n)) in enumerate(picks.items())
        ]
        return inner.select(*df.columns, *fixed)

    def running(self, df: DataFrame, specs: dict[str, tuple[str, Column, bool]], hot: bool,
                reverse: bool = False) -> DataFrame:
        """Add running aggregates from the start of the group: kind, expression, current row included.

        Kinds: ``sum``, ``max`` and ``last`` (the last non-null value). With ``reverse`` the order runs
        backwards, so ``last`` finds the first non-null value that follows.
        """
        ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        base = df
        for i, (_, expr, _) in enumerate(specs.values()):
            base = base.withColumn(f"__v{i}", expr)

        def over(kind: str, column: Column, frame) -> Column:
            if kind == "last":
                return F.last(column, ignorenulls=True).over(frame)
            return {"sum": F.sum, "max": F.max}[kind](column).over(frame)

        start = Window.unboundedPreceding
        if not hot:
            w = Window.partitionBy(*self.keys).orderBy(*ordering)
            return base.select(*df.columns, *[
                over(kind, F.col(f"__v{i}"), w.rowsBetween(start, 0 if inclusive else -1)).alias(name)
                for i, (name, (kind, _, inclusive)) in enumerate(specs.items())
            ])
        base = self._sliced(base)
        ws = Window.partitionBy(*self.keys, "__slice").orderBy(*ordering)
        whole = ws.rowsBetween(start, Window.unboundedFollowing)
        inner = base.select(
            "*",
            *[over(kind, F.col(f"__v{i}"), ws.rowsBetween(start, 0 if inclusive else -1)).alias(name)
              for i, (name, (kind, _, inclusive)) in enumerate(specs.items())],
            *[over(kind, F.col(f"__v{i}"), whole).alias(f"__t{i}") for i, (kind, _, _) in enumerate(specs.values())],
            F.lag(F.lit(1)).over(ws).isNull().alias("__leads"),
        )
        # The row that leads each slice adds up the slices before it, then hands the sum to its slice.
        inner = inner.withColumn("__part", F.when(~F.col("__leads"), F.col("__slice")))
        before = Window.partitionBy(*self.keys, "__part").orderBy(*ordering).rowsBetween(start, -1)
        inner = inner.select("*", *[
            F.when(F.col("__leads"), over(kind, F.col(f"__t{i}"), before)).alias(f"__c{i}")
            for i, (kind, _, _) in enumerate(specs.values())
        ])
        spread = Window.partitionBy(*self.keys, "__slice")
        out = []
        for i, (name, (kind, _, _)) in enumerate(specs.items()):
            own, carried = F.col(name), F.max(f"__c{i}").over(spread)
            value = {
                "sum": F.when(own.isNull() & carried.isNull(), F.lit(None))
                .otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))),
                "max": F.greatest(own, carried),
                "last": F.coalesce(own, carried),
            }[kind]
            out.append(value.alias(name))
        return inner.select(*[F.col(c) for c in df.columns], *out)


def ranged_running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add running sums, the current row included, per ``keys`` in ``order`` (ascending, total inside a key).

    Rows are dealt by ranges of key and order, as many of each as of any other, summed inside a range, and moved on by the
    totals of the ranges before. So a key of any size is spread, however close together its values lie.
    """
    values = df.select("*", *[e.alias(f"__v{i}") for i, e in enumerate(sums.values())])
    ranged = settle(values.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "__range").agg(*[F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(sums))])
    carried = totals.select(*[F.col(k).alias(f"__k_{k}") for k in [*keys, "__range"]], *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__c{i}") for i in range(len(sums))])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in [*keys, "__range"]]
    out = ranged.select("*", *[F.sum(f"__v{i}").over(inside).alias(f"__s{i}") for i in range(len(sums))])
    return out.join(carried, same).select(*df.columns, *[(F.col(f"__s{i}") + F.col(f"__c{i}")).alias(name) for i, name in enumerate(sums)])


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; combined on the map side, so repeats of a key cost little.

    Nulls in ``order`` come last. Rows with a null key are kept as one group.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    packed = F.struct(*[e.alias(f"__o{i}") for i, e in enumerate(ranked)], F.struct(*rest).alias("__row"))
    return df.groupBy(*keys).agg(F.min(packed).alias("__first")).select(
        *keys, *[F.col("__first.__row")[c].alias(c) for c in rest]
    ).select(*df.columns)


def _bucket(value: Column) -> Column:
    """Order-preserving bucket of a double, about 0.4 % wide, so a few thousand buckets cover any data."""
    size = F.floor(F.log2(F.abs(value)) * 177).cast("long") + 200_000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def sliced_quantiles(values: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of ``__x`` per key without bringing a key's values together.

    Values are counted per distinct value (before the shuffle), ranked inside narrow buckets, and the
    buckets of a key, a few thousand at most, are added up to turn ranks inside a bucket into ranks overall.
    """
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    counted = values.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", _bucket(F.col("__x")))
    inside = Window.partitionBy(*keys, "__b").orderBy("__x")
    ranked = counted.select(
        "*",
        F.coalesce(F.sum("__n").over(inside.rowsBetween(start, -1)), F.lit(0)).alias("__skip"),
        F.sum("__n").over(inside.rowsBetween(start, end)).alias("__bn"),
    ).withColumn("__leads", F.col("__skip") == 0)
    ranked = ranked.withColumn("__part", F.when(~F.col("__leads"), F.col("__b")))
    across = Window.partitionBy(*keys, "__part").orderBy("__x")
    ranked = ranked.select(
        "*",
        F.when(F.col("__leads"), F.coalesce(F.sum("__bn").over(across.rowsBetween(start, -1)), F.lit(0))).alias("__c"),
        F.when(F.col("__leads"), F.sum("__bn").over(across.rowsBetween(start, end))).alias("__t"),
    )
    bucket = Window.partitionBy(*keys, "__b")
    ranked = ranked.select(
        *keys, "__x", "__n", (F.col("__skip") + F.max("__c").over(bucket)).alias("__from"), F.max("__t").over(bucket).alias("__total")
    )

    def at(rank: Column) -> Column:
        hit = (F.col("__from") <= rank) & (rank < F.col("__from") + F.col("__n"))
        return F.max(F.when(hit, F.col("__x")))

    picks = []
    for i, q in enumerate(quantiles.values()):
        position = (F.col("__total") - 1) * q
        picks += [at(F.floor(position)).alias(f"__lo{i}"), at(F.ceil(position)).alias(f"__hi{i}"),
                  F.max(position - F.floor(position)).alias(f"__f{i}")]
    summed = ranked.groupBy(*keys).agg(*picks)
    return summed.select(*keys, *[
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(name)
        for i, name in enumerate(quantiles)
    ])


def group_quantiles(
    df: DataFrame, keys: list[str], column: str, quantiles: dict[str, float], hot_rows: int | None = None
) -> DataFrame:
    """Exact interpolated quantiles per key (the usual linear rule); nulls are left out.

    Ordinary keys use the built-in percentile, hot ones ``sliced_quantiles``; with ``hot_rows=0`` all keys
    do, which suits few keys with much data each.
    """
    values = df.select(*keys, F.col(column).cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    if hot_rows == 0:
        return sliced_quantiles(values, keys, quantiles)
    cold, hot = split_by_heat(values, keys, hot_rows)
    plain = cold.groupBy(*keys).agg(*[F.percentile("__x", q).alias(name) for name, q in quantiles.items()])
    return plain if hot is None else plain.unionByName(sliced_quantiles(hot, keys, quantiles))
