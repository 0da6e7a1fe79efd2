"""The session every part of the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "crosslake", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; what a cluster already set (master, memory, partitions) stays."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master and master.startswith("local"):
        settings |= {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(os.cpu_count() or 8)}
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
