"""Sessions with the settings the engine is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: On a cluster these go to spark-submit; adaptive execution sizes and splits partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "6g", shared: str | None = None, name: str = "loamdex") -> SparkSession:
    """A session on this machine: as many shuffle partitions as cores."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cores))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
