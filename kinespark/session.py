"""Session settings for local work; on a cluster the session comes from outside."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "kinespark", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; keyword names use __ for dots."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app).master(master)
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a local or shared folder)."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
