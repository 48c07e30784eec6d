"""Spark sessions and what Python workers need."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks: UTC, adaptive plans, few shuffle partitions."""
    return share_package(
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def share_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, if they don't find it elsewhere."""
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in path:
        environment["PYTHONPATH"] = os.pathsep.join([x for x in path if x] + [root])
    return spark
