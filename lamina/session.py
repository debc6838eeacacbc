"""SparkSession with the settings that the operators' semantics assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with DEFAULTS; settings use underscores for dots."""
    builder = SparkSession.builder.appName("lamina")
    if master:
        cores = master.partition("[")[2].rstrip("]")
        cores = int(cores) if cores.isdigit() else os.cpu_count() or 1
        # On a cluster the number of shuffle partitions is AQE's to choose from the default.
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cores))
    for k, v in (DEFAULTS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
