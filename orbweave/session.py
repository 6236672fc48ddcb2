"""Spark session of the library's own scripts and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session: UTC, adaptive execution, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orbweave")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.ui.retainedExecutions", "20")
        .config("spark.ui.retainedJobs", "50")
        .config("spark.ui.retainedStages", "50")
        .getOrCreate()
    )
