"""Session factory with the settings the operators rely on."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "barloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """Local session for tests and the bench. On a cluster, bring your own session.

    AQE is on: it sizes the shuffle partitions, picks broadcast joins from measured
    sizes and splits skewed join partitions.
    """
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
