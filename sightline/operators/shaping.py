"""Small relational steps between stages: times of frames, orders of work, budgets, views of annotations, training targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import boxes as bx
from sightline.operators.prune import dense_ids


def frame_times(rows: DataFrame, times: DataFrame, frame: str = "frame") -> DataFrame:
    """rows with the time of their frame; rows of frames that times (frame, pts) doesn't have go."""
    return rows.join(times.select(F.col("frame").alias(frame), "pts"), frame)


def last_track_only(rows: DataFrame, identity: list[str], track: str) -> DataFrame:
    """The rows of each identity's last track: activity totals as they are where a later track replaces an earlier one."""
    last = rows.groupBy(*identity).agg(F.max(track).alias(track))
    return rows.join(last, [*identity, track], "left_semi")


def plain_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, i, value): the mean of the vectors, scaled to length 1, a row a dimension."""
    mean = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(*keys)))
    return mean.select(*keys, "i", F.coalesce(F.try_divide("m", size), F.lit(0.0)).alias("value"))


def by_position(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """The n-th row of either side as one row, for as many as both have; positions come from a range exchange."""
    a, b = dense_ids(left, left_order, "position", 0), dense_ids(right, right_order, "position", 0)
    return a.join(b, "position")


def within_budget(found: DataFrame, held: DataFrame, keys: list[str], score: str, ties: list[str], most: int) -> DataFrame:
    """The new objects that there is room for: the best by score until held (keys, n_held) and they are `most`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    room = ranked.join(held, keys, "left").filter(F.col("rank") + F.coalesce("n_held", F.lit(0)) <= most)
    return room.drop("n_held")


def processing_order(start: Column, most: Column, n_frames: Column, backwards: bool = False) -> Column:
    """The frames to go through: from start forward, `most` more and the last one included, or from the one before it back."""
    if backwards:
        last = F.greatest(start - most, F.lit(0))
        return F.when(start > last, F.sequence(start - 1, last, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    last = F.least(start + most, n_frames - 1)
    return F.when(last >= start, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))


def needs_reconditioning(iou: Column, score: Column, frame: Column, every: int, iou_least: float, score_least: float) -> Column:
    """Whether a track is set anew from its best detection: at every n-th frame, or where a sure detection has moved off."""
    periodic = (frame % every == 0) if every > 0 else F.lit(False)
    return periodic | ((iou < iou_least) & (score >= score_least))


def top_k_hits(ranked: Column, truth: Column, ks: list[int]) -> list[Column]:
    """For each k whether truth is among the first k of an array, as 1 or 0."""
    place = F.array_position(ranked, truth)
    return [((place > 0) & (place <= k)).cast("int").alias(f"top_{k}") for k in ks]


def relative_box(box: Column, width: Column, height: Column) -> Column:
    """An array x, y, w, h as shares of the frame; one with no value above 1 is taken to be that already."""
    scaled = F.array(box[0] / width, box[1] / height, box[2] / width, box[3] / height)
    return F.when(F.array_max(box) > 1, scaled).otherwise(box)


def at_frame(values: Column, frame: Column) -> Column:
    """A track's value at a frame number from 0, null beyond its end."""
    return F.get(values, frame)


def flat_keypoints(points: Column) -> Column:
    """Structs x, y, v as one array of numbers."""
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"], p["v"].cast("double"))))


def flip(b: bx.Box, width: float | Column) -> bx.Box:
    """A box mirrored from left to right."""
    width = F.lit(width) if isinstance(width, (int, float)) else width
    return width - b[2], b[1], width - b[0], b[3]


def pad(b: bx.Box, left: float, top: float) -> bx.Box:
    """A box in a frame with a border on its left and top."""
    return b[0] + left, b[1] + top, b[2] + left, b[3] + top


def crop(b: bx.Box, x: float, y: float, width: float, height: float) -> bx.Box:
    """A box inside a cut of the frame; empty ones are told by boxes.non_empty()."""
    return bx.clip((b[0] - x, b[1] - y, b[2] - x, b[3] - y), width, height)


def jitter(b: bx.Box, u: tuple[Column, Column, Column, Column], noise: float, width: float, height: float) -> bx.Box:
    """A box whose corners are moved by up to `noise` of its sides, each by its draw u from [0, 1)."""
    w, h = b[2] - b[0], b[3] - b[1]
    moved = tuple(c + (2 * d - 1) * noise * side for c, d, side in zip(b, u, (w, h, w, h), strict=True))
    return bx.clip(moved, width, height)
