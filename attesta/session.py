"""SparkSession settings: adaptive plans, UTC, partition sizes that fit executor memory."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str, cpus: int = 8, shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """A single-machine session with the settings above; on a cluster set the same keys in its own configuration."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name).config("spark.driver.memory", "8g")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | (extra or {})
    session = builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
