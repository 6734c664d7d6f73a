"""Sequence operators over positions or frames: gaps, interpolation, filters and resampling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.intervals import runs


def gap_split(df: DataFrame, keys: list[str], frame: str, most: int, least: int = 2) -> DataFrame:
    """df with `segment`, a new one after more than `most` frames without a row; shorter ones than `least` are dropped."""
    w = Window.partitionBy(*keys).orderBy(frame)
    split = runs(df, keys, [frame], F.col(frame) - F.lag(frame).over(w) <= most, "segment")
    return split.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "segment"))).filter(F.col("_n") >= least).drop("_n")


def interpolate(df: DataFrame, keys: list[str], frame: str, values: list[str]) -> DataFrame:
    """Every frame between a row and the next of its keys, values on the straight line between; one row per frame."""
    w = Window.partitionBy(*keys).orderBy(frame)
    ahead = df.withColumns({"_next": F.lead(frame).over(w), **{f"_{v}": F.lead(v).over(w) for v in values}})
    filled = ahead.withColumn("_f", F.explode(F.sequence(F.col(frame), F.greatest(F.col(frame), F.coalesce(F.col("_next") - 1, F.col(frame))))))
    share = (F.col("_f") - F.col(frame)) / F.coalesce(F.nullif(F.col("_next") - F.col(frame), F.lit(0)), F.lit(1))
    line = lambda v: (F.col(v) + F.when(F.col("_f") == F.col(frame), 0.0).otherwise((F.col(f"_{v}") - F.col(v)) * share)).alias(v)
    return filled.select(*keys, F.col("_f").alias(frame), *[line(v) for v in values])


def median_filter(df: DataFrame, keys: list[str], order: str, value: str, kernel: int, name: str) -> DataFrame:
    """The median of `kernel` neighbours, those beyond either end counting as 0."""
    half = kernel // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    near = F.collect_list(value).over(w)
    padded = F.concat(near, F.array_repeat(F.lit(0.0), F.lit(kernel) - F.size(near)))
    return df.withColumn(name, F.element_at(F.array_sort(padded), half + 1))


def fill_times(df: DataFrame, keys: list[str], order: str, t: str, name: str = "filled") -> DataFrame:
    """Times without nulls that never fall: gaps step on by the median positive difference of neighbouring known times.

    What comes before the first known time steps back from it, not below 0; keys without any known time give nulls.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(t).isNotNull()
    prior = F.last(t, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    delta = F.when(known & (F.col(t) - prior > 0), F.col(t) - prior)
    marked = df.withColumns({"_delta": delta, "_i": F.row_number().over(w)})
    step = marked.withColumns({
        "_dt": F.coalesce(F.median("_delta").over(whole), F.lit(0.0)), "_back": F.last(F.when(known, F.col("_i")), ignorenulls=True).over(up), "_tb": F.last(t, ignorenulls=True).over(up),
        "_fore": F.last(F.when(known, F.col("_i")), ignorenulls=True).over(down), "_tf": F.last(t, ignorenulls=True).over(down),
    })
    value = F.coalesce(F.col("_tb") + (F.col("_i") - F.col("_back")) * F.col("_dt"), F.when(F.col("_tf").isNotNull(), F.greatest(F.lit(0.0), F.col("_tf") - (F.col("_fore") - F.col("_i")) * F.col("_dt"))))
    return step.withColumn("_v", value).withColumn(name, F.max("_v").over(up)).drop("_delta", "_i", "_dt", "_back", "_tb", "_fore", "_tf", "_v")


def ensemble(scores: DataFrame, keys: list[str], pos: str, duration: str, score: str, weights: Mapping[int, float]) -> DataFrame:
    """Weighted mean by position over several window durations, cut to the shortest of them, to one half-even decimal."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(duration))
    used = scores.withColumn("_w", weight).filter("_w is not null")
    ends = used.groupBy(*keys, duration).agg((F.max(pos) + 1).alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_n"))
    return used.join(ends, keys).filter(F.col(pos) < F.col("_n")).groupBy(*keys, pos).agg((F.rint(F.round(F.sum(F.col("_w") * F.col(score)) / F.sum("_w"), 9) * 10) / 10).alias(score))


def resample(df: DataFrame, keys: list[str], pos: str, values: list[str], points: int) -> DataFrame:
    """`points` values evenly spread over each sequence of positions 0 .. n - 1, on straight lines between them."""
    w = Window.partitionBy(*keys).orderBy(pos)
    size = df.groupBy(*keys).agg(F.max(pos).alias("_last"))
    ahead = df.withColumns({f"_{v}": F.lead(v).over(w) for v in values})
    grid = size.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("_x", F.col("_k") * F.col("_last") / F.lit(max(points - 1, 1)))
    grid = grid.withColumn(pos, F.least(F.floor("_x"), F.greatest(F.col("_last") - 1, F.lit(0))).cast("long"))
    part = F.col("_x") - F.col(pos)
    met = grid.join(ahead.withColumn(pos, F.col(pos).cast("long")), [*keys, pos])
    return met.select(*keys, F.col("_k").alias("k"), *[(F.col(v) + F.coalesce((F.col(f"_{v}") - F.col(v)) * part, F.lit(0.0))).alias(v) for v in values])


def run_length(df: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """(keys, label, first, last, n) of the runs of equal labels."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = runs(df, keys, [order], F.col(label).eqNullSafe(F.lag(label).over(w)) & F.lag(order).over(w).isNotNull())
    return r.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")


def streak(df: DataFrame, keys: list[str], order: str, hit: str, name: str = "streak") -> DataFrame:
    """How many hits in a row end at each row; 0 where it is none."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    block = df.withColumn("_miss", F.sum(F.when(F.col(hit), 0).otherwise(1)).over(w))
    own = Window.partitionBy(*keys, "_miss").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return block.withColumn(name, F.sum(F.when(F.col(hit), 1).otherwise(0)).over(own)).drop("_miss")
