"""Registry of the queries over the driver's tables and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.plans import detections, evaluation, shaping, timeline

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [timeline, detections, evaluation, shaping]


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.O.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.flagship(spark, sf_dir)
