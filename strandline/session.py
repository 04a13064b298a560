"""Session settings that the operators expect. Under ``spark-submit`` its master, memory and number of
shuffle partitions stay; otherwise a local session is made."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "strandline", cores: int | None = None, **settings: str) -> SparkSession:
    cores = cores or os.cpu_count() or 1
    builder = SparkSession.builder.appName(app)
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # not started by spark-submit
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "8g")
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
