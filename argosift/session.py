"""A session with the settings that the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Left to the cluster: master, memory, spark.sql.shuffle.partitions (AQE coalesces), spark.checkpoint.dir.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "argosift", **more: str) -> SparkSession:
    """A session with SETTINGS; `more` by names whose dots are written as double underscores."""
    builder = SparkSession.builder.appName(name)
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    for k, v in more.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
