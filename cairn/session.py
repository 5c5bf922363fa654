"""The SparkSession that tests, the benchmark and local runs share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "cairn", cpus: int | str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with UTC time, adaptive execution and few shuffle partitions."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CAIRN_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
