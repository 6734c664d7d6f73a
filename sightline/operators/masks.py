"""Suppression among the run-length masks of one frame: overlaps, ownership of pixels, shrinkage and recent occlusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.functions import rle
from sightline.operators.grouped import map_groups, map_rows


def mask_nms(df: DataFrame, keys: list[str], ident: str, score: str, counts: str, least: float, most: float) -> DataFrame:
    """(keys, ident) of the masks above `least` that stay: by falling score, each goes if it overlaps a kept one by more than `most`."""

    def run(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for name, _, runs in rows:
            if all(rle.iou(runs, other) <= most for _, other in kept):
                kept.append((name, runs))
        return [(name,) for name, _ in kept]

    kind = df.schema[ident].dataType.simpleString()
    rows = df.filter(F.col(score) > least).select(*keys, ident, score, counts)
    return map_rows(rows, keys, [F.desc(score), ident], run, f"{ident} {kind}")


def pixel_owners(df: DataFrame, keys: list[str], ident: str, score: str, counts: str) -> DataFrame:
    """(keys, ident, area, owned): a mask's pixels and those that no mask of higher score in its frame claims.

    Of equal scores the first by ident claims. Masks of a frame have one size.
    """
    schema = StructType([df.schema[k] for k in [*keys, ident]] + StructType.fromDDL("area long, owned long").fields)

    def run(t: pa.Table, cut: np.ndarray) -> pa.Table:
        runs = t[counts].combine_chunks()
        area, owned = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            owner = np.full(int(sum(runs[s].as_py())), -1, np.int64)
            for i in range(e - 1, s - 1, -1):  # the highest score is painted last
                for a, b in rle.spans(np.asarray(runs[i].as_py())):
                    owner[a:b] = i - s
                    area[i] += b - a
            owned[s:e] = np.bincount(owner[owner >= 0], minlength=e - s)
        return t.select([*keys, ident]).append_column("area", pa.array(area)).append_column("owned", pa.array(owned))

    return map_groups(df.select(*keys, ident, score, counts), keys, [F.desc(score), ident], run, schema)


def has_shrunk(area: Column, owned: Column, least: float = 0.3) -> Column:
    """Whether less than `least` of a mask is left to it."""
    return owned / F.greatest(area, F.lit(1)) < least


def recently_occluded(pairs: DataFrame, keys: list[str], least: float, backwards: bool = False) -> DataFrame:
    """(keys, ident) of the objects to hide: in a pair (a, b, iou, a_last, b_last) that overlaps by `least`, the one occluded last.

    That counts only if the other one was occluded before at all (-1 is never); backwards in time the earlier one is the last.
    """
    later = (lambda x, y: x < y) if backwards else (lambda x, y: x > y)
    a, b = F.col("a_last"), F.col("b_last")
    gone = F.when(later(a, b) & (b > -1), F.col("a")).when(later(b, a) & (a > -1), F.col("b"))
    return pairs.filter(F.col("iou") >= least).select(*keys, gone.alias("ident")).filter("ident is not null").distinct()
