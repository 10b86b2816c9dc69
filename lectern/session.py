"""One place for the session settings that every operator relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", app: str = "lectern", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own.

    Adaptive execution splits skewed joins and coalesces small shuffle
    partitions; UTC keeps date arithmetic independent of the host.
    """
    # Python workers import the package by name, so they need the same path as the driver.
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LECTERN_DRIVER_MEMORY", "6g"),
    }
    return SparkSession.builder.config(map={**conf, **extra}).getOrCreate()
