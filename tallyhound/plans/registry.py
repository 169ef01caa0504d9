"""Registry of the queries offered to the driver, each with its independent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyhound.plans import derive


@dataclass(frozen=True)
class Inputs:
    """The tables of one scale, as they are (``table``) or in fleet shape (``view``)."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return derive.table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        return derive.view(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BODIES: dict[str, tuple[list[str], str]] = {}  # of the SQL: the views it names, and the text without them


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Register ``fn(inputs)``; ``sql`` may refer to ``views`` and to the plain tables."""

    def add(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Inputs(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            BODIES[name] = views or [], sql
            ORACLES[name] = derive.with_views(*BODIES[name])
        return fn

    return add
