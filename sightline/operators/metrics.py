"""Evaluation: image and track metrics as aggregations over pair tables, with one assignment step a frame.

Truth and predictions are two tables; `sim` holds the pairs of one frame that overlap. Pairs without overlap never match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from sightline.operators import assign
from sightline.operators.grouped import map_groups

EPS = 2.220446049250313e-16
#: Overlap thresholds of image metrics, and the localisation thresholds of the track metrics.
IOU_STEPS = [0.5 + 0.05 * k for k in range(10)]
HOTA_STEPS = [0.05 * k for k in range(1, 20)]
TETA_STEPS = [0.05 * k for k in range(20)]


def _levels(steps: list[float]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(a)).alias("alpha")) for k, a in enumerate(steps)]))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 with an epsilon of 1e-4 in precision, recall and their mean."""
    p, r = tp / (tp + fp + 1e-4), tp / (tp + fn + 1e-4)
    return 2 * p * r / (p + r + 1e-4)


def np_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Plain F1 of one video and phrase, 1 where there is nothing to find and nothing found."""
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(1.0))


def image_matches(truth: DataFrame, found: DataFrame, sim: DataFrame, keys: list[str], steps: list[float] = IOU_STEPS, images: DataFrame | None = None) -> DataFrame:
    """Per image and threshold: tp, fp, fn and the numbers of truths and predictions.

    Images of either side count, and those of the table `images` (keys) that have neither: the true negatives.
    """
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    found_in = n(truth, "n_gt").join(n(found, "n_dt"), keys, "full")
    if images is not None:
        found_in = found_in.join(images.select(*keys).distinct(), keys, "full")
    images = found_in.fillna(0, ["n_gt", "n_dt"])
    matched = assign.assign(sim.withColumn("cost", -F.col("iou")), keys, "gt_id", "dt_id", "cost", missing=0.0)
    hits = matched.select(*keys, (-F.col("cost")).alias("iou")).select("*", _levels(steps).alias("s")).filter("iou >= s.alpha").groupBy(*keys, "s.level").agg(F.count("*").alias("tp"))
    grid = images.select("*", _levels(steps).alias("s")).select(*keys, "n_gt", "n_dt", "s.level", "s.alpha")
    counted = grid.join(hits, [*keys, "level"], "left").fillna(0, ["tp"])
    return counted.withColumns({"fp": F.col("n_dt") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})


def concept_f1(matches: DataFrame) -> DataFrame:
    """Per threshold: micro, positive-micro and macro F1, image-level scores with their correlation, and their product.

    False positives of images without truth count in the micro score only; images without predictions aren't averaged. The
    image-level scores need the images with neither truth nor prediction among the matches.
    """
    pos = (F.col("n_gt") > 0) & (F.col("n_dt") > 0)
    local = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    s = lambda c: F.sum(c.cast("double")).alias
    a = matches.groupBy("level", "alpha").agg(
        s(F.col("tp"))("tp"), s(F.col("fp"))("fp"), s(F.col("fn"))("fn"), s(F.when(F.col("n_gt") > 0, F.when(F.col("n_dt") > 0, F.col("fp")).otherwise(0)).otherwise(0))("pm_fp"),
        F.sum(F.when(pos, local).otherwise(0.0)).alias("f_sum"), s(pos.cast("int"))("il_tp"), s(((F.col("n_gt") == 0) & (F.col("n_dt") > 0)).cast("int"))("il_fp"), s(((F.col("n_gt") > 0) & (F.col("n_dt") == 0)).cast("int"))("il_fn"),
        s(((F.col("n_gt") == 0) & (F.col("n_dt") == 0)).cast("int"))("il_tn"),
    )
    tp, fp, fn, tn = (F.col(f"il_{c}") for c in ("tp", "fp", "fn", "tn"))
    prec, rec = tp / (tp + fp + 1e-6), tp / (tp + fn + 1e-6)
    mcc = (tp * tn - fp * fn) / (F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + 1e-6)
    pm = f1(F.col("tp"), F.col("pm_fp"), F.col("fn"))
    return a.select(
        "level", "alpha", "tp", "fp", "fn", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("micro_f1"), pm.alias("positive_micro_f1"),
        F.try_divide("f_sum", "il_tp").alias("positive_macro_f1"), (2 * prec * rec / (prec + rec + 1e-6)).alias("il_f1"), mcc.alias("il_mcc"), (pm * mcc).alias("cg_f1"),
    )


def perfect_images(matches: DataFrame) -> DataFrame:
    """Per threshold: shares of positive and of negative images without an error, and macro F1 over all positive images."""
    positive, exact = F.col("n_gt") > 0, (F.col("fp") == 0) & (F.col("fn") == 0)
    local = F.when(positive & (F.col("n_dt") > 0), f1(F.col("tp"), F.col("fp"), F.col("fn"))).otherwise(0.0)
    share = lambda c, of: F.count_if(c) / (F.count_if(of) + 1e-9)
    return matches.groupBy("level", "alpha").agg(
        share(positive & exact, positive).alias("perfect_positive"), share(~positive & exact, ~positive).alias("perfect_negative"),
        F.try_divide(F.sum(local), F.count_if(positive)).alias("positive_w0dt_macro_f1"),
    )


def mean_overlap(sim: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the mean over images of the mean overlap of their matched pairs, and how many images have any."""
    matched = assign.assign(sim.withColumn("cost", -F.col("iou")), keys, "gt_id", "dt_id", "cost", missing=0.0)
    per_image = matched.groupBy(*keys).agg(F.avg(-F.col("cost")).alias("j"))
    return per_image.agg((F.sum("j") / (F.count("*") + 1e-9)).alias("mean_overlap"), F.count("*").alias("n_images"))


def aligned(truth: DataFrame, found: DataFrame, sim: DataFrame, seq: list[str]) -> DataFrame:
    """sim with `score`, the overlap times how well the two ids align over the whole sequence."""
    t = [*seq, "t"]
    total = F.sum("sim").over(Window.partitionBy(*t, "gt_id")) + F.sum("sim").over(Window.partitionBy(*t, "tk_id")) - F.col("sim")
    shared = sim.withColumn("_n", F.when(total > EPS, F.col("sim") / total).otherwise(0.0)).groupBy(*seq, "gt_id", "tk_id").agg(F.sum("_n").alias("potential"))
    g = truth.groupBy(*seq, "gt_id").agg(F.count("*").alias("gt_n"))
    k = found.groupBy(*seq, "tk_id").agg(F.count("*").alias("tk_n"))
    joint = shared.join(g, [*seq, "gt_id"]).join(k, [*seq, "tk_id"]).withColumn("jaccard", F.col("potential") / (F.col("gt_n") + F.col("tk_n") - F.col("potential")))
    return sim.join(joint, [*seq, "gt_id", "tk_id"]).withColumn("score", F.col("jaccard") * F.col("sim"))


def hota(truth: DataFrame, found: DataFrame, sim: DataFrame, seq: list[str], steps: list[float] = HOTA_STEPS) -> DataFrame:
    """Per sequence and threshold: counts, detection, association and localisation accuracy and their combination.

    truth (seq, t, gt_id), found (seq, t, tk_id), sim (seq, t, gt_id, tk_id, sim).
    """
    scored = aligned(truth, found, sim, seq).withColumn("cost", -F.col("score"))
    matched = assign.assign(scored, [*seq, "t"], "gt_id", "tk_id", "cost", missing=0.0, keep=("sim", "gt_n", "tk_n"))
    full = matched.select("*", _levels(steps).alias("s")).filter(F.col("sim") >= F.col("s.alpha") - EPS)
    by_pair = full.groupBy(*seq, "s.level", "gt_id", "tk_id").agg(F.count("*").alias("n"), F.sum("sim").alias("loc"), F.first("gt_n").alias("gt_n"), F.first("tk_n").alias("tk_n"))
    n = F.col("n")
    sums = by_pair.groupBy(*seq, "level").agg(
        F.sum("n").alias("tp"), F.sum("loc").alias("loc"), F.sum(n * n / F.greatest(F.lit(1), F.col("gt_n") + F.col("tk_n") - n)).alias("ass"),
        F.sum(n * n / F.greatest(F.lit(1), F.col("gt_n"))).alias("ass_re"), F.sum(n * n / F.greatest(F.lit(1), F.col("tk_n"))).alias("ass_pr"),
    )
    dets = truth.groupBy(*seq).agg(F.count("*").alias("n_gt")).join(found.groupBy(*seq).agg(F.count("*").alias("n_tk")), seq, "full").fillna(0, ["n_gt", "n_tk"])
    grid = dets.select("*", _levels(steps).alias("s")).select(*seq, "n_gt", "n_tk", "s.level", "s.alpha").join(sums, [*seq, "level"], "left").fillna(0, ["tp"]).fillna(0.0, ["loc", "ass", "ass_re", "ass_pr"])
    return hota_fields(grid.withColumns({"fn": F.col("n_gt") - F.col("tp"), "fp": F.col("n_tk") - F.col("tp")}), seq)


def hota_fields(sums: DataFrame, seq: list[str]) -> DataFrame:
    """The fields that follow from tp, fn, fp and the sums of localisation and association over matches."""
    one = F.lit(1)
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    a = lambda c: F.col(c) / F.greatest(one, tp)
    det = tp / F.greatest(one, tp + fn + fp)
    low = F.lit(1e-10)
    return sums.select(
        *seq, "level", "alpha", "tp", "fn", "fp", "loc", "ass", "ass_re", "ass_pr", det.alias("det_a"), (tp / F.greatest(one, tp + fn)).alias("det_re"), (tp / F.greatest(one, tp + fp)).alias("det_pr"),
        a("ass").alias("ass_a"), a("ass_re").alias("ass_re_mean"), a("ass_pr").alias("ass_pr_mean"), (F.greatest(low, F.col("loc")) / F.greatest(low, tp.cast("double"))).alias("loc_a"),
        F.sqrt(det * a("ass")).alias("hota"), F.sqrt(tp / F.greatest(one, tp + fn) * a("ass")).alias("owta"),
    )


def combine(per_sequence: DataFrame, keys: list[str]) -> DataFrame:
    """Sequences (or classes) as one: sums of counts, averages weighted by true positives."""
    s = per_sequence.groupBy(*keys, "level", "alpha").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "loc", "ass", "ass_re", "ass_pr")])
    return hota_fields(s, keys)


def class_average(per_class: DataFrame, ignore_empty: bool = True) -> DataFrame:
    """Plain means over classes, those without any detection left out if ignore_empty."""
    used = per_class.filter("tp + fn + fp > 0") if ignore_empty else per_class
    return used.groupBy("level", "alpha").agg(*[F.avg(c).alias(c) for c in ("hota", "det_a", "ass_a", "loc_a", "owta")], *[F.sum(c).alias(c) for c in ("tp", "fn", "fp")])


def teta(truth: DataFrame, found: DataFrame, sim: DataFrame, seq: list[str], steps: list[float] = TETA_STEPS, near: float = 0.5) -> DataFrame:
    """Per sequence and threshold: localisation, association and classification accuracy and their mean.

    A prediction is a false positive only if it overlaps some truth by `near` and isn't matched, so that missing labels
    cost nothing. Classes are compared for matches from 0.5 on; truth and found have the column cls.
    """
    scored = aligned(truth, found, sim, seq).withColumn("cost", -F.col("score"))
    matched = assign.assign(scored, [*seq, "t"], "gt_id", "tk_id", "cost", missing=0.0, keep=("sim", "gt_n", "tk_n"))
    full = matched.join(truth.select(*seq, "t", "gt_id", F.col("cls").alias("gt_cls")), [*seq, "t", "gt_id"]).join(found.select(*seq, "t", "tk_id", F.col("cls").alias("tk_cls")), [*seq, "t", "tk_id"])
    at = full.select("*", _levels(steps).alias("s")).filter(F.col("sim") >= F.col("s.alpha") - EPS)
    pair = at.groupBy(*seq, "s.level", "gt_id", "tk_id").agg(F.count("*").alias("n"), F.count_if(F.col("gt_cls") == F.col("tk_cls")).alias("same"), F.first("gt_n").alias("gt_n"), F.first("tk_n").alias("tk_n"))
    n = F.col("n")
    sums = pair.groupBy(*seq, "level").agg(F.sum("n").alias("tp"), F.sum("same").alias("cls_tp"), F.sum(n * n / F.greatest(F.lit(1), F.col("gt_n") + F.col("tk_n") - n)).alias("ass"))
    close = sim.filter(F.col("sim") >= near).select(*seq, "t", "tk_id").distinct()
    kept = at.filter(F.col("sim") >= near).select(*seq, "t", "tk_id", "s.level").distinct().groupBy(*seq, "level").agg(F.count("*").alias("n_kept"))
    n_gt = truth.groupBy(*seq).agg(F.count("*").alias("n_gt"))
    n_close = close.groupBy(*seq).agg(F.count("*").alias("n_close"))
    grid = n_gt.join(n_close, seq, "left").fillna(0, ["n_close"]).select("*", _levels(steps).alias("s")).select(*seq, "n_gt", "n_close", "s.level", "s.alpha")
    j = grid.join(sums, [*seq, "level"], "left").join(kept, [*seq, "level"], "left").fillna(0, ["tp", "cls_tp", "n_kept"]).fillna(0.0, ["ass"])
    one = F.lit(1)
    loc = F.col("tp") / F.greatest(one, F.col("n_gt") + F.col("n_close") - F.col("n_kept"))
    ass = F.col("ass") / F.greatest(one, F.col("tp"))
    cls = F.when(F.col("alpha") >= 0.5 - EPS, F.col("cls_tp") / F.greatest(one, F.col("tp")))
    return j.select(*seq, "level", "alpha", "tp", (F.col("n_gt") - F.col("tp")).alias("fn"), (F.col("n_close") - F.col("n_kept")).alias("fp"), "cls_tp", loc.alias("loc_a"), ass.alias("assoc_a"), cls.alias("cls_a"))


def class_sequences(truth: DataFrame, found: DataFrame, sim: DataFrame, seq: list[str], assigned: DataFrame | None = None, near: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Truth, predictions and pairs as they are evaluated class by class, with the class as a further key `of`.

    A predicted track takes part in a class, with all its frames, if in some frame it overlaps a truth of that class by `near` and
    isn't assigned (seq, t, gt_id, tk_id) to a truth of another class there.
    """
    own = truth.withColumn("of", F.col("cls"))
    classed = sim.join(own.select(*seq, "t", "gt_id", "of"), [*seq, "t", "gt_id"])
    close = classed.filter(F.col("sim") >= near)
    if assigned is not None:
        elsewhere = assigned.join(own.select(*seq, "t", "gt_id", F.col("of").alias("held")), [*seq, "t", "gt_id"]).select(*seq, "t", "tk_id", "held")
        close = close.join(elsewhere, [*seq, "t", "tk_id"], "left").filter(F.col("held").isNull() | (F.col("held") == F.col("of")))
    tracks = close.select(*seq, "of", "tk_id").distinct()
    return own, found.join(tracks, [*seq, "tk_id"]), classed.join(tracks, [*seq, "of", "tk_id"], "left_semi")


def assigned_pairs(truth: DataFrame, found: DataFrame, sim: DataFrame, seq: list[str]) -> DataFrame:
    """(seq, t, gt_id, tk_id) of the matching of all classes together, as in hota() and teta()."""
    scored = aligned(truth, found, sim, seq).withColumn("cost", -F.col("score"))
    return assign.assign(scored, [*seq, "t"], "gt_id", "tk_id", "cost", missing=0.0).drop("cost")


def teta_summary(per_sequence: DataFrame, keys: list[str]) -> DataFrame:
    """The three accuracies averaged over thresholds and their mean, in percent."""
    m = per_sequence.groupBy(*keys).agg(F.avg("loc_a").alias("loc_a"), F.avg("assoc_a").alias("assoc_a"), F.coalesce(F.avg("cls_a"), F.lit(0.0)).alias("cls_a"))
    return m.select(*keys, *[(100 * F.col(c)).alias(c) for c in ("loc_a", "assoc_a", "cls_a")], (100 * (F.col("loc_a") + F.col("assoc_a") + F.col("cls_a")) / 3).alias("teta"))


def ap_matches(found: DataFrame, sim: DataFrame, keys: list[str], steps: list[float] = IOU_STEPS) -> DataFrame:
    """found (keys, dt_id, score) with `hits` by threshold: 1 if it takes a truth, by falling score, 0 if not, -1 if it doesn't count.

    It doesn't count if it takes a truth that sim says is `ignored`, or if it takes none and found says that it is `outside`.
    """
    flag = lambda df, c: F.col(c) if c in df.columns else F.lit(False).alias(c)
    left = found.select(*keys, "dt_id", "score", flag(found, "outside"))
    joined = left.join(sim.select(*keys, "dt_id", "gt_id", "iou", flag(sim, "ignored")), [*keys, "dt_id"], "left")

    def run(t: pa.Table, cut: np.ndarray) -> pa.Table:
        dt = np.asarray(pc.dictionary_encode(t["dt_id"].combine_chunks()).indices, dtype=np.int64)
        gt = np.asarray(pc.fill_null(pc.dictionary_encode(t["gt_id"].combine_chunks()).indices, -1), dtype=np.int64)
        iou = np.asarray(pc.fill_null(t["iou"].combine_chunks(), 0.0))
        ignored = np.asarray(pc.fill_null(t["ignored"].combine_chunks(), False).cast(pa.int8())) == 1
        new = np.zeros(t.num_rows, bool)
        new[1:] = dt[1:] != dt[:-1]
        new[cut[:-1]] = True
        first = np.flatnonzero(new)
        place = np.cumsum(new) - 1
        outside = np.asarray(t["outside"].combine_chunks().cast(pa.int8()))[first] == 1
        hits = np.where(outside, -1, 0)[:, None] * np.ones(len(steps), np.int64)
        near = iou >= steps[0]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if not near[s:e].any():
                continue
            used = s + np.flatnonzero(near[s:e])  # no other pair can match at any threshold
            rows, row = np.unique(place[used], return_inverse=True)
            names, at, col = np.unique(gt[used], return_index=True, return_inverse=True)
            m = np.zeros((len(rows), len(names)))
            m[row, col] = iou[used]
            skip = ignored[used][at]
            taken = np.stack([assign.greedy_match(m, a, skip, np.zeros(len(names), bool)) for a in steps], 1)
            hits[rows] = np.where(taken >= 0, np.where(skip[taken], -1, 1), hits[rows])
        out = t.take(pa.array(first)).drop_columns(["gt_id", "iou", "ignored", "outside"])
        return out.append_column("hits", pa.array(hits.tolist(), pa.list_(pa.int32())))

    gone = ("gt_id", "iou", "ignored", "outside")
    schema = StructType([f for f in joined.schema.fields if f.name not in gone] + [StructField("hits", ArrayType(IntegerType()))])
    return map_groups(joined, keys, [F.desc("score"), "dt_id", "gt_id"], run, schema)


def average_precision(matches: DataFrame, truth_counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and threshold: precision interpolated at 101 recalls, averaged. truth_counts is (keys, n_gt)."""
    rows = matches.select(*keys, "dt_id", "score", F.posexplode("hits").alias("level", "hit")).filter("hit >= 0").join(truth_counts, keys)
    w = Window.partitionBy(*keys, "level").orderBy(F.desc("score"), "dt_id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.withColumns({"tp": F.sum(F.col("hit").cast("long")).over(up), "rank": F.row_number().over(w)})
    curve = curve.withColumns({"recall": F.col("tp") / F.col("n_gt"), "precision": F.col("tp") / F.col("rank")})
    # the best precision from here on, as a running maximum from the other end: frames that end unbounded are quadratic
    back = Window.partitionBy(*keys, "level").orderBy("score", F.desc("dt_id")).rowsBetween(Window.unboundedPreceding, 0)
    best = curve.withColumn("p", F.max("precision").over(back)).filter("hit = 1")
    # each true positive raises recall to tp / n_gt and answers the grid points above the previous one
    low, high = F.ceil(100 * (F.col("tp") - 1) / F.col("n_gt") + 1e-9), F.floor(100 * F.col("recall") + 1e-9)
    points = F.greatest(F.lit(0), high - F.when(F.col("tp") == 1, F.lit(0)).otherwise(low) + 1)
    got = best.groupBy(*keys, "level").agg((F.sum(F.col("p") * points) / 101).alias("ap"))
    grid = truth_counts.filter("n_gt > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(IOU_STEPS) - 1))).alias("level"))
    return grid.join(got, [*keys, "level"], "left").fillna(0.0, ["ap"])


def ranged_precision(found: DataFrame, truth: DataFrame, sim: DataFrame, image: list[str], keys: list[str], ranges: dict[str, tuple[float, float]], most: int) -> DataFrame:
    """Average precision (keys, range, level) of each range of areas, of the `most` best predictions of an image.

    A truth whose area is outside a range is ignored there, a prediction outside of it doesn't count unless it takes a truth
    inside. found is (image, dt_id, score, area), truth (image, gt_id, area), sim (image, dt_id, gt_id, iou).
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("range"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for n, (a, b) in ranges.items()])).alias("_r")
    spread = lambda df: df.select("*", each).select(*df.columns, "_r.range", ((F.col("area") < F.col("_r.low")) | (F.col("area") > F.col("_r.high"))).alias("out"))
    w = Window.partitionBy(*image).orderBy(F.desc("score"), "dt_id")
    best = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    owned = spread(truth)
    pairs = sim.join(owned.select(*image, "gt_id", "range", F.col("out").alias("ignored")), [*image, "gt_id"])
    matches = ap_matches(spread(best).withColumnRenamed("out", "outside"), pairs, [*image, "range"])
    counts = owned.groupBy(*keys, "range").agg(F.count_if(~F.col("out")).alias("n_gt"))
    return average_precision(matches, counts, [*keys, "range"])
