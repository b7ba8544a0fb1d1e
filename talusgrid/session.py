"""Session helper for tests, benchmarks and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tuned for.

    On a cluster the caller brings its own session; nothing in the library
    depends on this one.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("talusgrid")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
