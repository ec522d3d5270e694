"""Session factory: adaptive execution on, UTC, no UI."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "loam", cores: int | None = None, **conf: str) -> SparkSession:
    """The session that spark-submit sets up. With ``cores``, a local one of so many threads, for
    tests and the bench."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "8g")
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
