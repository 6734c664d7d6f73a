"""Interval operators: joins over time, runs of activity, merging, cutting and collapsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: float, closed: bool = False) -> DataFrame:
    """Pairs of equal keys whose intervals a of left and b of right overlap, each pair once.

    An equi join on buckets of `width`: either side is listed once for each bucket that it touches, and a pair counts in
    the bucket where its overlap begins. Ends are open unless closed=True. Columns of left and right must differ but for
    the keys.
    """

    def spread(df: DataFrame, se: tuple[str, str]) -> DataFrame:
        s, e = (F.floor(F.col(c) / width).cast("long") for c in se)
        return df.filter(F.col(se[0]) <= F.col(se[1])).withColumn("_bucket", F.explode(F.sequence(s, e)))

    low = F.greatest(F.col(a[0]), F.col(b[0]))
    if closed:
        meets = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1]))
    else:
        meets = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))
    joined = spread(left, a).join(spread(right, b), [*keys, "_bucket"])
    return joined.filter(meets & (F.col("_bucket") == F.floor(low / width))).drop("_bucket")


def point_join(points: DataFrame, spans: DataFrame, keys: list[str], t: str, span: tuple[str, str], width: float, closed: bool = False) -> DataFrame:
    """Points t inside spans [start, end), or [start, end] if closed; spans are listed by bucket, points fall in one."""
    s, e = (F.floor(F.col(c) / width).cast("long") for c in span)
    listed = spans.filter(F.col(span[0]) <= F.col(span[1])).withColumn("_bucket", F.explode(F.sequence(s, e)))
    joined = points.withColumn("_bucket", F.floor(F.col(t) / width).cast("long")).join(listed, [*keys, "_bucket"])
    ends = F.col(t) <= F.col(span[1]) if closed else F.col(t) < F.col(span[1])
    return joined.filter((F.col(t) >= F.col(span[0])) & ends).drop("_bucket")


def overlap(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(a[1]), F.col(b[1])) - F.greatest(F.col(a[0]), F.col(b[0])))


def runs(df: DataFrame, keys: list[str], order: list[str], same: Column, name: str = "run") -> DataFrame:
    """df with the number of the run each row is in: a run goes on while `same` holds, which may look at lag()s."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return flagged.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def active_intervals(scores: DataFrame, keys: list[str], pos: str, score: str, first: Column, fps: float) -> DataFrame:
    """(keys, start_s, end_s) of the runs of positive scores at adjacent positions; `first` is the frame of position 0."""
    w = Window.partitionBy(*keys).orderBy(pos)
    on = scores.filter(F.col(score) > 0)
    r = runs(on, keys, [pos], F.col(pos) == F.lag(pos).over(w) + 1)
    return r.groupBy(*keys, "run").agg(((F.min(F.col(pos) + first)) / fps).alias("start_s"), ((F.max(F.col(pos) + first) + 1) / fps).alias("end_s")).drop("run")


def merge_adjacent(df: DataFrame, keys: list[str], label: str, span: tuple[str, str], gap: float, ties: list[str]) -> DataFrame:
    """Neighbours of equal label whose gap is at most `gap` as one row; the running end reaches over contained rows."""
    w = Window.partitionBy(*keys).orderBy(*span, *ties)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    labelled = runs(df, keys, [*span, *ties], F.col(label).eqNullSafe(F.lag(label).over(w)) & F.lag(span[0]).over(w).isNotNull(), "_label_run")
    own = Window.partitionBy(*keys, "_label_run").orderBy(*span, *ties)
    reach = F.max(span[1]).over(own.rowsBetween(Window.unboundedPreceding, -1))
    r = runs(labelled, [*keys, "_label_run"], [*span, *ties], F.col(span[0]) - reach <= gap, "_merge")
    del before
    return r.groupBy(*keys, "_label_run", "_merge").agg(F.first(label).alias(label), F.min(span[0]).alias(span[0]), F.max(span[1]).alias(span[1]), F.count("*").alias("n_merged")).drop("_label_run", "_merge")


def collapse(df: DataFrame, keys: list[str], span: tuple[str, str], ties: list[str], least: float = 1e-3) -> DataFrame:
    """One line at a time: each end is cut to the next start, and rows not longer than `least` are dropped."""
    w = Window.partitionBy(*keys).orderBy(*span, *ties)
    cut = df.withColumn(span[1], F.least(F.col(span[1]), F.coalesce(F.lead(span[0]).over(w), F.col(span[1]))))
    return cut.filter(F.col(span[1]) - F.col(span[0]) > least)


def cut_at(df: DataFrame, keys: list[str], span: tuple[str, str], cuts: str) -> DataFrame:
    """Each span as the pieces between its ends and the points of the array `cuts` strictly inside."""
    s, e = F.col(span[0]), F.col(span[1])
    points = F.array_sort(F.array_distinct(F.concat(F.array(s, e), F.filter(F.coalesce(F.col(cuts), F.array().cast("array<double>")), lambda x: (x > s) & (x < e)))))
    pieces = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda x, y: F.struct(x.alias("s"), y.alias("e")))
    return df.filter(e > s).withColumn("_p", F.explode(pieces)).withColumns({span[0]: F.col("_p.s"), span[1]: F.col("_p.e")}).drop("_p", cuts)


def windows(length: Column, size: float, lap: float) -> Column:
    """Starts of windows of `size` that overlap by `lap`, up to the one that reaches the end."""
    step = size - lap
    last = F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * F.lit(float(step)))
