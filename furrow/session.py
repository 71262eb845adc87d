"""The session that tests, benchmarks and examples use. On a cluster, bring your own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A local session: UTC, adaptive execution, shuffle partitions to match the cores."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("furrow")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
