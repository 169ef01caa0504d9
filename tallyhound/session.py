"""Session defaults shared by the tests, the bench and stand-alone use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tallyhound", cores: str | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution on. On a cluster pass nothing and let the submit command decide."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(os.environ.get("TALLYHOUND_PARTITIONS", cores)))
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
