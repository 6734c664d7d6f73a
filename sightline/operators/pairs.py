"""Pairs of detections, tracks and identities that meet on a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import boxes as bx

XYXY = ["x1", "y1", "x2", "y2"]


def prefixed(df: DataFrame, prefix: str, keys: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in cols])


def co_presence(tracks: DataFrame, keys: list[str], track: str, frame: str, least: int) -> DataFrame:
    """Pairs of tracks with at least `least` common frames: mean and median IoU and centre distance over those."""
    a, b = (prefixed(tracks, p, [*keys, frame], [track, *XYXY]) for p in ("a_", "b_"))
    met = a.join(b, [*keys, frame]).filter(F.col(f"a_{track}") < F.col(f"b_{track}"))
    p, q = bx.box("a_"), bx.box("b_")
    met = met.withColumns({"_iou": bx.iou(p, q), "_dist": bx.centre_distance(p, q)})
    grouped = met.groupBy(*keys, f"a_{track}", f"b_{track}").agg(
        F.count("*").alias("n_frames"), F.avg("_iou").alias("mean_iou"), F.median("_iou").alias("median_iou"), F.avg("_dist").alias("mean_dist"), F.median("_dist").alias("median_dist")
    )
    return grouped.filter(F.col("n_frames") >= least)


def link_kind(iou: Column, dist: Column, similarity: Column | None = None) -> Column:
    """must, cannot or null for a pair of tracks seen together."""
    must = (iou >= 0.70) | (dist <= 0.12)
    if similarity is not None:
        must = must | ((similarity >= 0.72) & ((iou >= 0.35) | (dist <= 0.18)))
    return F.when(must, "must").when((iou <= 0.10) & (dist >= 0.40), "cannot")


def upper_median(values: Column) -> Column:
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def pair_table(left: DataFrame, right: DataFrame, keys: list[str], ids: tuple[str, str], extra: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """All pairs inside a group with their IoU: an equi join on the keys, so a group's pairs are its own concern."""
    a = prefixed(left, "gt_", keys, [ids[0], *XYXY, *extra[0]])
    b = prefixed(right, "dt_", keys, [ids[1], *XYXY, *extra[1]])
    return a.join(b, keys).withColumn("iou", bx.iou(bx.box("gt_"), bx.box("dt_")))


def top_k(df: DataFrame, keys: list[str], score: str, k: int, ties: list[str], rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows of the first source (by `order`) of each key."""
    return df.withColumn("_f", F.min(order).over(Window.partitionBy(*keys))).filter(F.col(order) == F.col("_f")).drop("_f")
