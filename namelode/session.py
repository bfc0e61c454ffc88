"""The session settings that the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The most candidates any query can have; the rank cut is pushed below the sort only up to this many rows.
MOST_CANDIDATES = 3000


def configure(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", MOST_CANDIDATES)
    return spark


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
