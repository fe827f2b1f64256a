"""One place that builds a SparkSession for local use; a cluster's own session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "lodestone", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session: UTC, AQE on, as many shuffle partitions as cores."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.files.minPartitionNum", str(n))  # a small file still feeds all cores
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # the stemmer's generated code is longer than what the JVM compiles by default; set it for executors, too
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "6g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
