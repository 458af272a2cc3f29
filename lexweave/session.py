"""Session defaults. On a cluster the submitter's own settings win; nothing here is required."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "lexweave", shared: str | None = None) -> SparkSession:
    """A single-JVM session for tests and the bench; ``shared`` is its folder for written intermediate tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("LEXWEAVE_SHUFFLE", str(cores)))
        .config("spark.driver.memory", os.environ.get("LEXWEAVE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
