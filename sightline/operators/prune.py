"""Shaping datasets: semi and anti joins, id remapping and checks that raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.runtime import materialize


class MissingReference(ValueError):
    """Rows refer to something that isn't there."""


def require_subset(df: DataFrame, within: DataFrame, keys: list[str]) -> DataFrame:
    """df, after a check that all its keys occur in `within`."""
    if (row := df.join(within, keys, "left_anti").select(*keys).first()) is not None:
        raise MissingReference(f"not found: {row.asDict()}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if (row := df.groupBy(*keys).count().filter("count > 1").first()) is not None:
        raise MissingReference(f"not unique: {row.asDict()}")
    return df


def dense_ids(df: DataFrame, keys: list[str], name: str, start: int = 1) -> DataFrame:
    """df with ids start, start + 1, ... for the distinct keys in order.

    The order is made by a range exchange and numbered in two steps, counts of the parts and places inside them, so no
    task sees all keys.
    """
    spark = df.sparkSession
    keyed = df.select(*keys).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    ranged = materialize(keyed.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "range")
    counts = ranged.groupBy("_part").count().orderBy("_part").collect()  # one row a partition
    base, total = {}, start
    for r in counts:
        base[r["_part"]], total = total, total + r["count"]
    offsets = spark.createDataFrame([(k, v) for k, v in base.items()] or [(-1, 0)], "_part int, _base long")
    w = Window.partitionBy("_part").orderBy(*keys)
    numbered = ranged.withColumn("_i", F.row_number().over(w)).join(F.broadcast(offsets), "_part").select(*keys, (F.col("_base") + F.col("_i") - 1).alias(name))
    return df.join(numbered, keys)


def compact(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Values numbered 0, 1, ... without gaps inside each key."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)) - 1)


def to_one_based(df: DataFrame, ids: list[str]) -> DataFrame:
    """Each id family that has a 0 counted from 1 instead."""
    flags = df.agg(*[F.coalesce(F.bool_or(F.col(c) == 0), F.lit(False)).cast("int").alias(f"_{c}") for c in ids])
    return df.crossJoin(F.broadcast(flags)).withColumns({c: F.col(c) + F.col(f"_{c}") for c in ids}).drop(*[f"_{c}" for c in ids])


def keep_available(tables: list[tuple[DataFrame, list[str]]], available: DataFrame) -> list[DataFrame]:
    """Every table's rows whose keys are available: a cascade of left semi joins."""
    return [t.join(available.select(*k).distinct(), k, "left_semi") for t, k in tables]


def sample_queries(df: DataFrame, keys: list[str], positive: str, most: int, seed: int, order: list[str]) -> DataFrame:
    """All positive rows and, up to `most` in all, others in the order of a seeded hash: the same rows on every run."""
    w = Window.partitionBy(*keys).orderBy(F.col(positive).desc(), F.md5(F.concat(F.concat_ws("/", *[F.col(c).cast("string") for c in order]), F.lit(f"/{seed}"))), *order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col(positive) | (F.col("_r") <= most)).drop("_r")
