"""Session settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tessera", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's settings hold.

    ANSI arithmetic and UTC are part of the operators' meaning. AQE picks partition counts and splits
    skewed joins, so ``spark.sql.shuffle.partitions`` is an upper bound rather than a tuned number.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(cores), "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
