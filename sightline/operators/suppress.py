"""Greedy suppression inside groups: rows in falling order of score stay unless they conflict with one that stayed.

Groups (a frame, an image, a shot's tracks) are bounded by what one frame or shot holds and run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import boxes as bx
from sightline.operators.grouped import column, map_groups, map_rows

Conflict = Callable[[np.ndarray, np.ndarray], np.ndarray]
XYXY = ["x1", "y1", "x2", "y2"]


# Measures of a box `a` with many boxes `b` (n, 4), or of n boxes a (4, n) with one of b each.


def pair_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU, 0 where the union is empty."""
    w = np.clip(np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]), 0, None)
    h = np.clip(np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]), 0, None)
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def pair_iom(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over the smaller area."""
    w = np.clip(np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]), 0, None)
    h = np.clip(np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]), 0, None)
    small = np.minimum((a[2] - a[0]) * (a[3] - a[1]), (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]))
    return np.divide(w * h, small, out=np.zeros_like(w), where=small > 0)


def pair_centre(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of centres over the longest side of either, at least 1."""
    d = np.hypot((a[0] + a[2] - b[:, 0] - b[:, 2]) / 2, (a[1] + a[3] - b[:, 1] - b[:, 3]) / 2)
    side = np.maximum(np.maximum(1.0, np.maximum(a[2] - a[0], a[3] - a[1])), np.maximum(b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]))
    return d / side


def iou_at_least(least: float) -> Conflict:
    return lambda a, b: pair_iou(a, b) >= least


def iou_above(most: float) -> Conflict:
    return lambda a, b: pair_iou(a, b) > most


def iom_above(most: float) -> Conflict:
    return lambda a, b: pair_iom(a, b) > most


def iou_or_centre(least: float, near: float) -> Conflict:
    return lambda a, b: (pair_iou(a, b) >= least) | (pair_centre(a, b) <= near)


def greedy(boxes: np.ndarray, order: np.ndarray, conflict: Conflict) -> np.ndarray:
    """Which rows stay when they are taken in this order."""
    kept = np.zeros(len(boxes), bool)
    alive = np.ones(len(boxes), bool)
    for i in order:
        if alive[i]:
            kept[i] = True
            alive &= ~conflict(boxes[i], boxes)
    return kept


#: Rows of a group beyond which it is gone through alone.
SMALL = 48


def greedy_groups(boxes: np.ndarray, cut: np.ndarray, conflict: Conflict) -> np.ndarray:
    """greedy() of many groups, runs of rows in their order: the i-th rows of all small groups meet their later rows at once."""
    size = np.diff(cut)
    alive = np.ones(len(boxes), bool)
    for s, e in zip(cut[:-1][size > SMALL], cut[1:][size > SMALL], strict=True):
        alive[s:e] = greedy(boxes[s:e], np.arange(e - s), conflict)
    first, size = cut[:-1][size <= SMALL], size[size <= SMALL]
    for i in range(int(size.max(initial=0)) - 1):
        first, size = first[size > i + 1], size[size > i + 1]
        on = alive[first + i]
        row, left = first[on] + i, size[on] - i - 1
        for step in range(1, int(left.max(initial=0)) + 1):
            row, left = row[left >= step], left[left >= step]
            later = row + step
            open_ = alive[later]
            alive[later[open_]] = ~conflict(boxes[row[open_]].T, boxes[later[open_]])
    return alive


def suppress(df: DataFrame, keys: list[str], score: str, ties: list[str], conflict: Conflict, boxes: list[str] | None = None) -> DataFrame:
    """The rows of df that stay; equal scores go in the order of `ties`."""
    cols = boxes or XYXY

    def run(t: pa.Table, cut: np.ndarray) -> pa.Table:
        xyxy = np.stack([column(t, c).astype(float) for c in cols], 1)
        return t.filter(pa.array(greedy_groups(xyxy, cut, conflict)))

    return map_groups(df, keys, [F.desc(score), *ties], run, df.schema)


def track_pairs(df: DataFrame, keys: list[str], track: str, frame: str) -> DataFrame:
    """(keys, a, b, n, shared, median_iou, median_dist) of tracks a < b with common frames.

    shared is the summed intersection over the summed union of their boxes on those.
    """
    a, b = (df.select(*keys, frame, F.col(track).alias(n), F.struct(*XYXY).alias(f"box_{n}")) for n in ("a", "b"))
    p, q = ([F.col(f"box_{n}.{c}") for c in XYXY] for n in ("a", "b"))
    met = a.join(b, [*keys, frame]).filter("a < b").select(*keys, "a", "b", bx.intersection(p, q).alias("i"), (bx.area(p) + bx.area(q)).alias("both"), bx.iou(p, q).alias("iou"), bx.centre_distance(p, q).alias("dist"))
    over = F.coalesce(F.try_divide(F.sum("i"), F.sum(F.col("both") - F.col("i"))), F.lit(0.0))
    return met.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"), over.alias("shared"), F.median("iou").alias("median_iou"), F.median("dist").alias("median_dist"))


def _with_conflicts(tracks: DataFrame, conflicts: DataFrame, keys: list[str], track: str) -> DataFrame:
    """tracks with `against`, the tracks of the pairs (keys, a, b) that they are in."""
    both = conflicts.select(*keys, F.col("a").alias(track), F.col("b").alias("other")).union(conflicts.select(*keys, "b", "a"))
    return tracks.join(both.groupBy(*keys, track).agg(F.sort_array(F.collect_list("other")).alias("against")), [*keys, track], "left")


def track_nms(df: DataFrame, keys: list[str], track: str, frame: str, score: str, least: float) -> DataFrame:
    """(keys, track) of the tracks that stay: conflict is summed intersection over summed union on common frames >= least.

    Tracks are taken by falling mean score, of equal ones (to nine digits) the smaller id first.
    """
    tracks = df.groupBy(*keys, track).agg(F.round(F.avg(score), 9).alias("rated"))
    met = track_pairs(df, keys, track, frame).filter(F.col("shared") >= least)

    def run(rows: list[tuple]) -> list[tuple]:
        kept: dict = {}
        for t, _, against in rows:
            if not any(o in kept for o in against or ()):
                kept[t] = (t,)
        return list(kept.values())

    kind = df.schema[track].dataType.simpleString()
    return map_rows(_with_conflicts(tracks, met, keys, track), keys, [F.desc("rated"), track], run, f"{track} {kind}")


def track_dedupe(df: DataFrame, keys: list[str], track: str, frame: str, iou: float, centre: float, frames: int) -> DataFrame:
    """(keys, track) of the tracks that stay after pairs with median IoU or distance beyond the limits lose the shorter.

    Pairs are taken in track order; of equal lengths the later goes; a track that goes takes no further part.
    """
    tracks = df.groupBy(*keys, track).agg(F.count("*").alias("size"))
    near = (F.col("median_iou") >= iou) | (F.col("median_dist") <= centre)
    met = track_pairs(df, keys, track, frame).filter((F.col("n") >= frames) & near)

    def run(rows: list[tuple]) -> list[tuple]:
        size = {t: n for t, n, _ in rows}
        gone: set = set()
        for a, _, against in rows:
            for b in against or ():
                if b > a and a not in gone and b not in gone:
                    gone.add(a if size[a] < size[b] else b)
        return [(t,) for t in size if t not in gone]

    kind = df.schema[track].dataType.simpleString()
    return map_rows(_with_conflicts(tracks, met, keys, track), keys, [track], run, f"{track} {kind}")
