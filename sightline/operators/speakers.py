"""Who speaks: from activity on screen and diarized speech to labelled segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators import intervals
from sightline.operators.grouped import map_rows


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, n): the commonest value, null counting as one; ties go to the value seen first."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "_first")
    return counted.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_first")


def speaker_prior(asd: DataFrame, visible: DataFrame, speaker: str, identity: str, weight: float = 0.7) -> DataFrame:
    """(speaker, identity, prior): weighted shares of the strongest activity and of visibility; the best one above 0."""
    both = asd.join(visible, [speaker, identity], "full").fillna(0.0, ["asd", "vis"])
    top = Window.partitionBy(speaker)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(c).over(top)), F.lit(0.0))
    scored = both.withColumn("prior", weight * share("asd") + (1 - weight) * share("vis"))
    w = Window.partitionBy(speaker).orderBy(F.desc("prior"), identity)
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1 and prior > 0").select(speaker, identity, "prior")


def label_segments(segments: DataFrame, active: DataFrame, width: float, tau: float, keys: list[str] | None = None) -> DataFrame:
    """segments (seg_id, speaker, start_s, end_s) with the track that is active longest in each, and the overlap.

    A track whose overlap is less than `tau` of the segment leaves the segment to its speaker.
    """
    pairs = intervals.interval_join(segments, active.withColumnsRenamed({"start_s": "a_s", "end_s": "a_e"}), keys or [], ("start_s", "end_s"), ("a_s", "a_e"), width)
    total = pairs.groupBy("seg_id", "track_id").agg(F.sum(intervals.overlap(("start_s", "end_s"), ("a_s", "a_e"))).alias("overlap_s"))
    best = total.groupBy("seg_id").agg(F.max_by("track_id", F.struct(F.round("overlap_s", 6), -F.col("track_id"))).alias("track_id"), F.max(F.round("overlap_s", 6)).alias("overlap_s"))
    joined = segments.join(best, "seg_id", "left")
    enough = F.col("overlap_s") >= tau * (F.col("end_s") - F.col("start_s"))
    return joined.withColumn("label", F.when(enough, F.concat(F.lit("Person_"), F.col("track_id").cast("string"))).otherwise(F.col("speaker")))


def weighted_activity(events: DataFrame, segments: DataFrame, width: float, key: list[str] | None = None) -> DataFrame:
    """(seg_id, identity, asd): positive scores of the events inside each segment [start, end), summed."""
    met = intervals.point_join(events, segments, key or [], "t", ("start_s", "end_s"), width)
    return met.groupBy("seg_id", "identity").agg(F.sum(F.greatest(F.col("score"), F.lit(0.0))).alias("asd"))


def resolve(candidates: list[Column]) -> Column:
    """The first candidate that isn't null or the word None."""
    return F.coalesce(*[F.when(c != "None", c) for c in candidates])


def absorb_short(runs: list[tuple[float, float, str]], least: float) -> list[tuple[float, float, str]]:
    """Runs (start, end, label) from left to right, short ones joined to a neighbour.

    A short first run joins the next, a short last one the previous, any other the longer neighbour, of equal ones the
    previous, as long as that is by now. A run that took a short one before it isn't judged itself; a sole run stays. Equal
    neighbours are one run at the end.
    """
    out: list[tuple[float, float, str]] = []
    at = 0
    while at < len(runs):
        start, end, label = runs[at]
        at += 1
        if end - start < least and len(runs) > 1:
            ahead = runs[at] if at < len(runs) else None
            if out and (ahead is None or out[-1][1] - out[-1][0] >= ahead[1] - ahead[0]):
                out[-1] = out[-1][0], end, out[-1][2]
                continue
            _, end, label = ahead
            at += 1
        out.append((start, end, label))
    return join_equal(out)


def absorb_weak(runs: list[tuple[float, float, str]], prior: str | None, most: float = 0.6) -> list[tuple[float, float, str]]:
    """Runs of at most `most` become the prior's, if there is one and more than one run; equal neighbours are then one."""
    if not prior or len(runs) < 2:
        return list(runs)
    return join_equal([(s, e, prior if e - s <= most else label) for s, e, label in runs])


def join_equal(runs: list[tuple[float, float, str]]) -> list[tuple[float, float, str]]:
    out: list[list] = []
    for s, e, k in runs:
        if out and out[-1][2] == k:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, k])
    return [tuple(r) for r in out]


def smooth_flips(runs: list[tuple[float, float, str]], most: float) -> list[tuple[float, float, str]]:
    """A - B - A with a B of at most `most` becomes A, each change seen by the next comparison; neighbours then merge."""
    out = [list(r) for r in runs]
    for i in range(1, len(out) - 1):
        if out[i - 1][2] == out[i + 1][2] != out[i][2] and out[i][1] - out[i][0] <= most:
            out[i][2] = out[i - 1][2]
    return join_equal([tuple(r) for r in out])


def absorb_weak_runs(df: DataFrame, keys: list[str], start: str, end: str, label: str, prior: str, most: float) -> DataFrame:
    """absorb_weak() for each group, whose rows all have the group's prior."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = [start, end, label]

    def run(rows: list[tuple]) -> list[tuple]:
        return absorb_weak([r[:3] for r in rows], rows[0][3], most)

    return map_rows(df.select(*keys, *cols, prior), keys, cols, run, ", ".join(f"{c} {types[c]}" for c in cols))


def chain_runs(df: DataFrame, keys: list[str], start: str, end: str, label: str, step) -> DataFrame:
    """Each group's runs, in order of start, after a function such as absorb_short or smooth_flips."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = [start, end, label]
    return map_rows(df.select(*keys, *cols), keys, cols, step, ", ".join(f"{c} {types[c]}" for c in cols))
