"""Session settings that the engine expects."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS, overridden by settings (dots written as __)."""
    builder = SparkSession.builder.appName("corpuloom")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workers_find_us(spark: SparkSession) -> SparkSession:
    """Python workers import this package from where the driver has it (on a cluster: ship it with --py-files).

    Needed where the driver's own path was extended after Spark had started.
    """
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)
    return spark


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow with workers that find this package."""
    workers_find_us(df.sparkSession)
    return df.mapInArrow(function, schema)
