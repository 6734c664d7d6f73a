"""Queries of metrics, masks, clustering and tracking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sightline.functions import boxes as bx
from sightline.functions import rle, rotated
from sightline.operators import cluster, linking, metrics, pairs
from sightline.operators.components import components
from sightline.plans.detections import _dist, _iou, _matching_sql
from sightline.plans.views import oracle, table, view
from sightline.streaming import tracker

Q: dict = {}
O: dict = {}


def add(name: str, views: list[str] | None = None, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            O[name] = oracle(views or [], sql)
        return f

    return keep


def _sides(spark, d):
    """Truth and predictions as sequences: one row an id and frame on either side, and the overlapping pairs."""
    k = ["video_id", "frame", "track_id"]
    one = lambda v: view(spark, d, v).groupBy(*k).agg(F.max_by(F.struct(*pairs.XYXY, "category_id", "conf"), F.struct("conf", "det_id")).alias("b")).select(*k, "b.*")
    g = one("v_gt").withColumnsRenamed({"track_id": "gt_id", "frame": "t", "category_id": "cls"})
    p = one("v_pred").withColumnsRenamed({"track_id": "tk_id", "frame": "t", "category_id": "cls"})
    met = pairs.pair_table(g.withColumnRenamed("gt_id", "i"), p.withColumnRenamed("tk_id", "i"), ["video_id", "t"], ("i", "i")).filter("iou > 0")
    return g, p, met.select("video_id", "t", F.col("gt_i").alias("gt_id"), F.col("dt_i").alias("tk_id"), F.col("iou").alias("sim"))


_SEQUENCES = f"""with recursive g as (select video_id, frame as t, track_id as gt_id, b.c as cls, b.x1 as x1, b.y1 as y1, b.x2 as x2, b.y2 as y2 from
    (select video_id, frame, track_id, arg_max({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'c': category_id}}, (conf, det_id)) as b from v_gt group by 1, 2, 3)),
  h as (select video_id, frame as t, track_id as tk_id, b.c as cls, b.x1 as x1, b.y1 as y1, b.x2 as x2, b.y2 as y2 from
    (select video_id, frame, track_id, arg_max({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'c': category_id}}, (conf, det_id)) as b from v_pred group by 1, 2, 3)),
  sm as (select * from (select g.video_id, g.t, gt_id, tk_id, g.cls as gt_cls, h.cls as tk_cls, {_iou('g.', 'h.')} as sim from g join h on g.video_id = h.video_id and g.t = h.t) where sim > 0),
  sh as (select video_id, gt_id, tk_id, sum(sim / total) as potential from (select *, sum(sim) over (partition by video_id, t, gt_id) + sum(sim) over (partition by video_id, t, tk_id) - sim as total from sm) group by 1, 2, 3),
  gn as (select video_id, gt_id, count(*) as gt_n from g group by 1, 2), hn as (select video_id, tk_id, count(*) as tk_n from h group by 1, 2),
  sc as (select sm.*, gt_n, tk_n, {{'v': sm.video_id, 't': sm.t}} as k, sm.gt_id as gt, sm.tk_id as dt, sim * potential / (gt_n + tk_n - potential) as w
    from sm join sh on sm.video_id = sh.video_id and sm.gt_id = sh.gt_id and sm.tk_id = sh.tk_id join gn on gn.video_id = sm.video_id and gn.gt_id = sm.gt_id join hn on hn.video_id = sm.video_id and hn.tk_id = sm.tk_id),
  {_matching_sql('sc')},
  hit as (select sc.* from sc join mt on sc.k = mt.k and cast(sc.gt as varchar) = mt.gt and cast(sc.dt as varchar) = mt.dt)"""
_HOTA = f"""{_SEQUENCES},
  lv as (select unnest(range(19)) as level), la as (select cast(level as int) as level, cast(0.05 as double) * (level + 1) as alpha from lv),
  bp as (select video_id, level, gt_id, tk_id, count(*) as n, sum(sim) as loc, any_value(gt_n) as gt_n, any_value(tk_n) as tk_n from hit join la on sim >= alpha - 2.220446049250313e-16 group by 1, 2, 3, 4),
  su as (select video_id, level, sum(n) as tp, sum(loc) as loc, sum(n * n * 1.0 / greatest(1, gt_n + tk_n - n)) as ass from bp group by 1, 2),
  dn as (select coalesce(a.video_id, b.video_id) as video_id, coalesce(n_gt, 0) as n_gt, coalesce(n_tk, 0) as n_tk from (select video_id, count(*) as n_gt from g group by 1) a full join (select video_id, count(*) as n_tk from h group by 1) b on a.video_id = b.video_id),
  per as (select dn.video_id, la.level, coalesce(tp, 0) as tp, n_gt - coalesce(tp, 0) as fn, n_tk - coalesce(tp, 0) as fp, coalesce(loc, 0) as loc, coalesce(ass, 0) as ass from dn cross join la left join su on su.video_id = dn.video_id and su.level = la.level)"""
_HOTA_FIELDS = """cast(tp as bigint) as tp, cast(fn as bigint) as fn, cast(fp as bigint) as fp, tp * 1.0 / greatest(1, tp + fn + fp) as det_a, ass / greatest(1, tp) as ass_a, greatest(1e-10, loc) / greatest(1e-10, tp) as loc_a,
  sqrt(tp * 1.0 / greatest(1, tp + fn + fp) * ass / greatest(1, tp)) as hota"""


@add("hota", ["v_gt", "v_pred"], f"{_HOTA} select video_id, level, {_HOTA_FIELDS}, sqrt(tp * 1.0 / greatest(1, tp + fn) * ass / greatest(1, tp)) as owta from per")
def hota(spark, d):
    return metrics.hota(*_sides(spark, d), ["video_id"]).select("video_id", "level", "tp", "fn", "fp", "det_a", "ass_a", "loc_a", "hota", "owta")


@add("hota_combined", ["v_gt", "v_pred"], f"{_HOTA}, al as (select level, sum(tp) as tp, sum(fn) as fn, sum(fp) as fp, sum(loc) as loc, sum(ass) as ass from per group by level) select level, {_HOTA_FIELDS} from al")
def hota_combined(spark, d):
    return metrics.combine(metrics.hota(*_sides(spark, d), ["video_id"]), []).select("level", "tp", "fn", "fp", "det_a", "ass_a", "loc_a", "hota")


@add("hota_class_average", ["v_gt", "v_pred"], f"""{_HOTA}, f as (select level, {_HOTA_FIELDS}, sqrt(tp * 1.0 / greatest(1, tp + fn) * ass / greatest(1, tp)) as owta from per where tp + fn + fp > 0)
  select level, cast(0.05 as double) * (level + 1) as alpha, avg(hota) as hota, avg(det_a) as det_a, avg(ass_a) as ass_a, avg(loc_a) as loc_a, avg(owta) as owta, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from f group by level""")
def hota_class_average(spark, d):
    return metrics.class_average(metrics.hota(*_sides(spark, d), ["video_id"]))


@add("teta", ["v_gt", "v_pred"], f"""{_SEQUENCES},
  lv as (select unnest(range(20)) as level), la as (select cast(level as int) as level, cast(0.05 as double) * level as alpha from lv),
  av as (select hit.*, level from hit join la on sim >= alpha - 2.220446049250313e-16),
  bp as (select video_id, level, gt_id, tk_id, count(*) as n, count(*) filter (gt_cls = tk_cls) as same, any_value(gt_n) as gt_n, any_value(tk_n) as tk_n from av group by 1, 2, 3, 4),
  su as (select video_id, level, sum(n) as tp, sum(same) as cls_tp, sum(n * n * 1.0 / greatest(1, gt_n + tk_n - n)) as ass from bp group by 1, 2),
  cl as (select video_id, count(*) as n_close from (select distinct video_id, t, tk_id from sm where sim >= 0.5) group by 1),
  kp as (select video_id, level, count(*) as n_kept from (select distinct video_id, t, tk_id, level from av where sim >= 0.5) group by 1, 2),
  per as (select n.video_id, la.alpha, coalesce(tp, 0) * 1.0 / greatest(1, n_gt + coalesce(n_close, 0) - coalesce(n_kept, 0)) as loc_a, coalesce(ass, 0) / greatest(1, coalesce(tp, 0)) as assoc_a, coalesce(cls_tp, 0) * 1.0 / greatest(1, coalesce(tp, 0)) as cls_a
    from (select video_id, count(*) as n_gt from g group by 1) n cross join la left join cl on cl.video_id = n.video_id left join su on su.video_id = n.video_id and su.level = la.level left join kp on kp.video_id = n.video_id and kp.level = la.level),
  me as (select video_id, 100 * avg(loc_a) as loc_a, 100 * avg(assoc_a) as assoc_a, 100 * coalesce(avg(cls_a) filter (alpha >= 0.5 - 1e-12), 0.0) as cls_a from per group by 1)
  select *, (loc_a + assoc_a + cls_a) / 3 as teta from me""")
def teta(spark, d):
    return metrics.teta_summary(metrics.teta(*_sides(spark, d), ["video_id"]), ["video_id"])


@add("class_tracks", ["v_gt", "v_pred"], f"""{_SEQUENCES},
  cl as (select sm.video_id, sm.gt_cls as of, sm.tk_id from sm left join hit on hit.video_id = sm.video_id and hit.t = sm.t and hit.tk_id = sm.tk_id where sm.sim >= 0.5 and (hit.gt_cls is null or hit.gt_cls = sm.gt_cls) group by 1, 2, 3)
  select cl.video_id, cl.of, cl.tk_id, count(*) as n_frames, (select count(*) from sm where sm.video_id = cl.video_id and sm.tk_id = cl.tk_id and sm.gt_cls = cl.of) as n_pairs
  from cl join h on h.video_id = cl.video_id and h.tk_id = cl.tk_id group by 1, 2, 3""")
def class_tracks(spark, d):
    """The predicted tracks that are evaluated in each class, with their frames and pairs."""
    g, p, sim = _sides(spark, d)
    _, found, pairs_of = metrics.class_sequences(g, p, sim, ["video_id"], metrics.assigned_pairs(g, p, sim, ["video_id"]))
    k = ["video_id", "of", "tk_id"]
    n = pairs_of.groupBy(*k).agg(F.count("*").alias("n_pairs"))
    return found.groupBy(*k).agg(F.count("*").alias("n_frames")).join(n, k, "left").fillna(0, ["n_pairs"])


def _images(spark, d):
    """Truth, predictions, their overlapping pairs, the keys of an image and all images that were looked at."""
    k = ["video_id", "frame", "category_id"]
    g, p = view(spark, d, "v_gt"), view(spark, d, "v_pred").filter("conf >= 0.5")
    sim = pairs.pair_table(g, p, k, ("det_id", "det_id")).filter("iou > 0").select(*k, F.col("gt_det_id").alias("gt_id"), F.col("dt_det_id").alias("dt_id"), "iou")
    return g, p, sim, k, view(spark, d, "v_boxes").select(*k).distinct()


_IMAGES = f"""with recursive d as (select * from v_pred where conf >= 0.5),
  pr as (select * from (select {{'v': g.video_id, 'f': g.frame, 'c': g.category_id}} as k, g.det_id as gt, d.det_id as dt, {_iou('g.', 'd.')} as w from v_gt g join d on g.video_id = d.video_id and g.frame = d.frame and g.category_id = d.category_id) where w > 0),
  {_matching_sql('pr')},
  hit as (select mt.k, w from mt join pr on pr.k = mt.k and pr.gt = mt.gt and pr.dt = mt.dt),
  im as (select {{'v': b.video_id, 'f': b.frame, 'c': b.category_id}} as k, coalesce(ng, 0) as n_gt, coalesce(nd, 0) as n_dt from (select distinct video_id, frame, category_id from v_boxes) b
    left join (select video_id, frame, category_id, count(*) as ng from v_gt group by 1, 2, 3) g on g.video_id = b.video_id and g.frame = b.frame and g.category_id = b.category_id
    left join (select video_id, frame, category_id, count(*) as nd from d group by 1, 2, 3) e on e.video_id = b.video_id and e.frame = b.frame and e.category_id = b.category_id),
  la as (select cast(level as int) as level, cast(0.5 as double) + cast(0.05 as double) * level as alpha from (select unnest(range(10)) as level)),
  tps as (select k, level, count(*) as tp from hit join la on w >= alpha group by 1, 2),
  m as (select im.k, n_gt, n_dt, la.level, la.alpha, coalesce(tp, 0) as tp, n_dt - coalesce(tp, 0) as fp, n_gt - coalesce(tp, 0) as fn from im cross join la left join tps on tps.k = im.k and tps.level = la.level)"""


def _f1_sql(tp: str, fp: str, fn: str) -> str:
    p, r = f"({tp} / ({tp} + {fp} + 1e-4))", f"({tp} / ({tp} + {fn} + 1e-4))"
    return f"2 * {p} * {r} / ({p} + {r} + 1e-4)"


_CONCEPT = f"""{_IMAGES},
  a as (select level, alpha, cast(sum(tp) as double) as tp, cast(sum(fp) as double) as fp, cast(sum(fn) as double) as fn, cast(coalesce(sum(fp) filter (n_gt > 0), 0) as double) as pm,
    sum(case when n_gt > 0 and n_dt > 0 then {_f1_sql('tp', 'fp', 'fn')} else 0 end) as fs, cast(count(*) filter (n_gt > 0 and n_dt > 0) as double) as it, cast(count(*) filter (n_gt = 0 and n_dt > 0) as double) as ip,
    cast(count(*) filter (n_gt > 0 and n_dt = 0) as double) as im, cast(count(*) filter (n_gt = 0 and n_dt = 0) as double) as tn, cast(count(*) filter (n_gt > 0) as double) as pos,
    cast(count(*) filter (n_gt > 0 and fp = 0 and fn = 0) as double) as pp, cast(count(*) filter (n_gt = 0 and fp = 0) as double) as np from m group by level, alpha)"""


@add("concept_f1", ["v_boxes", "v_gt", "v_pred"], f"""{_CONCEPT}, c as (select *, (it * tn - ip * im) / (sqrt((it + ip) * (it + im) * (tn + ip) * (tn + im)) + 1e-6) as mcc, {_f1_sql('tp', 'pm', 'fn')} as pf, it / (it + ip + 1e-6) as ipr, it / (it + im + 1e-6) as irc from a)
  select level, alpha, tp, fp, fn, {_f1_sql('tp', 'fp', 'fn')} as micro_f1, pf as positive_micro_f1, fs / nullif(it, 0) as positive_macro_f1, 2 * ipr * irc / (ipr + irc + 1e-6) as il_f1, mcc as il_mcc, pf * mcc as cg_f1 from c""")
def concept_f1(spark, d):
    g, p, sim, k, images = _images(spark, d)
    return metrics.concept_f1(metrics.image_matches(g, p, sim, k, images=images))


@add("perfect_images", ["v_boxes", "v_gt", "v_pred"], f"""{_CONCEPT} select level, alpha, pp / (pos + 1e-9) as perfect_positive, np / (it + ip + im + tn - pos + 1e-9) as perfect_negative, fs / nullif(pos, 0) as positive_w0dt_macro_f1 from a""")
def perfect_images(spark, d):
    """Shares of images without any error, and macro F1 that counts images without predictions."""
    g, p, sim, k, images = _images(spark, d)
    return metrics.perfect_images(metrics.image_matches(g, p, sim, k, images=images))


@add("mean_overlap", ["v_boxes", "v_gt", "v_pred"], f"{_IMAGES} select sum(j) / (count(*) + 1e-9) as mean_overlap, count(*) as n_images from (select avg(w) as j from hit group by k)")
def mean_overlap(spark, d):
    _, _, sim, k, _ = _images(spark, d)
    return metrics.mean_overlap(sim, k)


@add("phrase_f1", ["v_boxes", "v_gt", "v_pred"], f"""{_IMAGES}, s as (select k.v as video_id, k.c as category_id, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from m where level = 0 and n_gt + n_dt > 0 group by 1, 2)
  select *, coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 1.0) as f1 from s""")
def phrase_f1(spark, d):
    """F1 of each video and category at an overlap of a half."""
    g, p, sim, k, _ = _images(spark, d)
    m = metrics.image_matches(g, p, sim, k, [0.5]).groupBy("video_id", "category_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return m.withColumn("f1", metrics.np_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def _ap_sql(found: str, truth: str, ranges: str, most: int) -> str:
    """Average precision of a table of predictions against one of truths, by falling score and 101 recalls, for ranges of areas."""
    area = "(x2 - x1) * (y2 - y1)"
    return f"""with recursive rg as (select * from (values {ranges}) as r(range, low, high)),
  f as (select p.*, range, area < low or area > high as outside from (select *, {area} as area, row_number() over (partition by video_id, frame, category_id order by conf desc, det_id) as nr from {found}) p cross join rg where nr <= {most}),
  u as (select t.*, range, area < low or area > high as ig from (select *, {area} as area from {truth}) t cross join rg),
  la as (select cast(level as int) as level, cast(0.5 as double) + cast(0.05 as double) * level as alpha from (select unnest(range(10)) as level)),
  o as (select {{'v': f.video_id, 'f': f.frame, 'c': f.category_id, 'r': f.range}} as k, f.det_id as dt, f.conf, f.outside, list({{'g': u.det_id, 'w': {_iou('u.', 'f.')}, 'ig': u.ig}} order by u.det_id) as near
    from f join u on u.video_id = f.video_id and u.frame = f.frame and u.category_id = f.category_id and u.range = f.range group by f.video_id, f.frame, f.category_id, f.range, f.det_id, f.conf, f.outside),
  r as (select *, row_number() over (partition by k order by conf desc, dt) as i from o),
  st as (select r.k, la.level, la.alpha, cast(0 as bigint) as i, cast([] as varchar[]) as used, cast(null as varchar) as dt, 0 as hit from (select distinct k from r) r cross join la union all
    select s.k, s.level, s.alpha, r.i, case when len(fit) > 0 then list_append(s.used, fit[-1].g) else s.used end, r.dt, case when len(fit) > 0 then case when fit[-1].ig then -1 else 1 end when r.outside then -1 else 0 end
    from st s join r on r.k = s.k and r.i = s.i + 1
      cross join lateral (select list_sort(list_transform(list_filter(r.near, lambda x: x.w >= s.alpha and not list_contains(s.used, x.g)), lambda x: {{'counts': not x.ig, 'w': x.w, 'g': x.g, 'ig': x.ig}})) as fit)),
  nt as (select category_id, range, count(*) filter (not ig) as n_gt from u group by 1, 2),
  al as (select f.category_id, f.range, la.level, f.conf, f.det_id, n_gt, coalesce(h.hit, case when f.outside then -1 else 0 end) as hit
    from f join nt on nt.category_id = f.category_id and nt.range = f.range cross join la left join st h on h.i > 0 and h.dt = f.det_id and h.level = la.level and h.k.r = f.range),
  cv as (select category_id, range, level, n_gt, row_number() over w as rank, sum(hit) over w as tp from al where hit >= 0 window w as (partition by category_id, range, level order by conf desc, det_id rows between unbounded preceding and current row)),
  pc as (select category_id, range, level, tp / cast(n_gt as double) as recall, max(tp / cast(rank as double)) as p from cv where n_gt > 0 group by 1, 2, 3, 4),
  mp as (select category_id, range, level, recall, max(p) over (partition by category_id, range, level order by recall desc rows between unbounded preceding and current row) as p from pc),
  gr as (select category_id, range, level, r / cast(100 as double) - 1e-11 as spot from nt cross join la cross join (select unnest(range(101)) as r) where n_gt > 0)
  select gr.category_id, gr.range, gr.level, sum(coalesce(p, 0)) / 101 as ap from gr asof left join mp on mp.category_id = gr.category_id and mp.range = gr.range and mp.level = gr.level and gr.spot <= mp.recall group by 1, 2, 3"""


@add("average_precision", ["v_gt", "v_pred"], _ap_sql("v_pred", "v_gt", "('all', 0, 1e12)", 1_000_000).replace("select gr.category_id, gr.range, gr.level, sum", "select gr.category_id, gr.level, sum").removesuffix("1, 2, 3") + "1, 2")
def average_precision(spark, d):
    k = ["video_id", "frame", "category_id"]
    g, p = view(spark, d, "v_gt"), view(spark, d, "v_pred")
    sim = pairs.pair_table(g, p, k, ("det_id", "det_id")).select(*k, F.col("gt_det_id").alias("gt_id"), F.col("dt_det_id").alias("dt_id"), "iou")
    found = p.select(*k, F.col("det_id").alias("dt_id"), F.col("conf").alias("score"))
    m = metrics.ap_matches(found, sim, k)
    return metrics.average_precision(m, g.groupBy("category_id").agg(F.count("*").alias("n_gt")), ["category_id"]).drop("n_gt")


@add("ranged_precision", ["v_gt", "v_pred"], _ap_sql("v_pred", "v_gt", "('all', 0, 1e12), ('small', 0, 4000), ('medium', 4000, 6500), ('large', 6500, 1e12)", 2))
def ranged_precision(spark, d):
    """Average precision of small, medium and large objects, from the two best predictions of an image."""
    k = ["video_id", "frame", "category_id"]
    g, p = view(spark, d, "v_gt"), view(spark, d, "v_pred")
    sim = pairs.pair_table(g, p, k, ("det_id", "det_id")).select(*k, F.col("gt_det_id").alias("gt_id"), F.col("dt_det_id").alias("dt_id"), "iou")
    found = p.select(*k, F.col("det_id").alias("dt_id"), F.col("conf").alias("score"), bx.area(bx.box()).alias("area"))
    truth = g.select(*k, F.col("det_id").alias("gt_id"), bx.area(bx.box()).alias("area"))
    ranges = {"all": (0, 1e12), "small": (0, 4000), "medium": (4000, 6500), "large": (6500, 1e12)}
    return metrics.ranged_precision(found, truth, sim, k, ["category_id"], ranges, 2).drop("n_gt")


@add("mask_boxes", ["v_boxes"], """select det_id, cast((floor(x2 / 10) - floor(x1 / 10)) * (floor(y2 / 10) - floor(y1 / 10)) as bigint) as area, cast(floor(x1 / 10) as int) as bx1, cast(floor(y1 / 10) as int) as by1, cast(floor(x2 / 10) as int) as bx2, cast(floor(y2 / 10) as int) as by2 from v_boxes""")
def mask_boxes(spark, d):
    """Boxes as run-length masks on a coarse grid; area and bounds read back from the runs."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            masks = [rle.from_box(*map(int, r), 100, 200) for r in np.floor(b[pairs.XYXY].to_numpy() / 10)]
            out = pd.DataFrame([rle.bounds(m, 100) for m in masks], columns=["bx1", "by1", "bx2", "by2"])
            yield out.assign(det_id=b["det_id"].to_numpy(), area=[rle.area(m) for m in masks])

    return view(spark, d, "v_boxes").select("det_id", *pairs.XYXY).mapInPandas(work, "det_id string, area long, bx1 int, by1 int, bx2 int, by2 int")


@add("mask_iou", ["v_gt", "v_pred"], """with g as (select video_id, frame, category_id, det_id, floor(x1 / 10) as x1, floor(y1 / 10) as y1, floor(x2 / 10) as x2, floor(y2 / 10) as y2 from v_gt),
  p as (select video_id, frame, category_id, det_id, floor(x1 / 10) as x1, floor(y1 / 10) as y1, floor(x2 / 10) as x2, floor(y2 / 10) as y2 from v_pred),
  m as (select g.det_id as gt_det_id, p.det_id as dt_det_id, greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0) as i, (g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) as s
    from g join p on g.video_id = p.video_id and g.frame = p.frame and g.category_id = p.category_id) select gt_det_id, dt_det_id, i / greatest(1, s - i) as iou from m""")
def mask_iou(spark, d):
    t = pairs.pair_table(view(spark, d, "v_gt"), view(spark, d, "v_pred"), ["video_id", "frame", "category_id"], ("det_id", "det_id"))
    cols = [f"{p}{c}" for p in ("gt_", "dt_") for c in pairs.XYXY]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.floor(b[cols].to_numpy() / 10).astype(int)
            yield b[["gt_det_id", "dt_det_id"]].assign(iou=[rle.iou(rle.from_box(*r[:4], 100, 200), rle.from_box(*r[4:], 100, 200)) for r in x])

    return t.select("gt_det_id", "dt_det_id", *cols).mapInPandas(work, "gt_det_id string, dt_det_id string, iou double")


@add("embedding_pool", [], """with n as (select label, vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as norm from embeddings),
  t as (select * from (select *, row_number() over (partition by label order by round(norm, 6) desc, vec_id) as r from n where norm > 0) where r <= 6),
  l as (select label, norm, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from t),
  m as (select label, i, sum(cast(x as double)) / (sum(norm) + 1e-8) as m, count(*) as n from l group by label, i)
  select label, cast(i as int) as i, round(m / sqrt(sum(m * m) over (partition by label)), 9) as value, n from m""")
def embedding_pool(spark, d):
    e = table(spark, d, "embeddings")
    return cluster.pool(e, ["label"], "embedding", ["vec_id"], 6).withColumn("value", F.round("value", 9))


@add("similar_embeddings", [], """with n as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as norm from embeddings),
  l as (select a.vec_id as a, b.vec_id as b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: cast(p[1] as double) * cast(p[2] as double))) / (a.norm * b.norm) as s from n a join n b on a.vec_id < b.vec_id)
  select a, b, round(s, 9) as similarity from l where s >= 0.3""")
def similar_embeddings(spark, d):
    """All close pairs of the table."""
    return cluster.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 9))


@add("identity_clusters")
def identity_clusters(spark, d):
    e = table(spark, d, "embeddings").withColumn("part", F.floor(F.col("vec_id") / 100))
    return cluster.identities(e, ["part"], "vec_id", "embedding", 0.2)


def _edges(spark, d):
    c = pairs.co_presence(view(spark, d, "v_track_frames"), ["video_id"], "track_id", "frame", 1).filter("mean_iou >= 0.03")
    return c.select(F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"))


_COMPONENTS = f"""with m as (select a.video_id, a.track_id as a, b.track_id as b, {_iou('a.', 'b.')} as iou from v_track_frames a join v_track_frames b on a.video_id = b.video_id and a.frame = b.frame and a.track_id < b.track_id),
  g as (select a, b from m group by video_id, a, b having avg(iou) >= 0.03), e as (select a, b from g union select b, a from g),
  r as (select a as id, least(a, b) as l0 from e), n as (select id, min(l0) as label from r group by id),
  n2 as (select n.id, least(n.label, min(x.label)) as label from n join e on e.a = n.id join n x on x.id = e.b group by n.id, n.label),
  n3 as (select n.id, least(n.label, min(x.label)) as label from n2 n join e on e.a = n.id join n2 x on x.id = e.b group by n.id, n.label),
  n4 as (select n.id, least(n.label, min(x.label)) as label from n3 n join e on e.a = n.id join n3 x on x.id = e.b group by n.id, n.label),
  n5 as (select n.id, least(n.label, min(x.label)) as label from n4 n join e on e.a = n.id join n4 x on x.id = e.b group by n.id, n.label),
  n6 as (select n.id, least(n.label, min(x.label)) as label from n5 n join e on e.a = n.id join n5 x on x.id = e.b group by n.id, n.label)"""


@add("track_components", ["v_track_frames"], f"{_COMPONENTS} select id, label from n6")
def track_components(spark, d):
    """Tracks connected by must-links."""
    return components(_edges(spark, d))


@add("identity_merge_map", ["v_boxes", "v_track_frames"], f"""{_COMPONENTS}, s as (select track_id as id, min(frame) as first from v_boxes group by 1),
  j as (select c.id, c.label, s.first from (select id, label from n6) c join s on s.id = c.id), b as (select label, arg_min(id, (first, id)) as target from j group by 1) select j.id, target from j join b on b.label = j.label""")
def identity_merge_map(spark, d):
    spans = view(spark, d, "v_boxes").groupBy(F.col("track_id").alias("id")).agg(F.min("frame").alias("first"))
    return cluster.merge_map(components(_edges(spark, d)), spans)


@add("track_boxes")
def track_boxes(spark, d):
    """The frame-by-frame tracker over all videos."""
    b = view(spark, d, "v_boxes").select("video_id", F.col("frame").cast("long").alias("frame"), "det_id", *pairs.XYXY, "conf")
    return tracker.track(b)


@add("giou_pairs", ["v_gt", "v_pred"], f"""select g.det_id as gt_det_id, p.det_id as dt_det_id, round({_iou('g.', 'p.')} - ((greatest(g.x2, p.x2) - least(g.x1, p.x1)) * (greatest(g.y2, p.y2) - least(g.y1, p.y1)) - ((g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) -
    greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0))) / ((greatest(g.x2, p.x2) - least(g.x1, p.x1)) * (greatest(g.y2, p.y2) - least(g.y1, p.y1))), 9) as giou, round({_dist('g.', 'p.')}, 9) as dist
  from v_gt g join v_pred p on g.video_id = p.video_id and g.frame = p.frame""")
def giou_pairs(spark, d):
    t = pairs.pair_table(view(spark, d, "v_gt"), view(spark, d, "v_pred"), ["video_id", "frame"], ("det_id", "det_id"))
    return t.select("gt_det_id", "dt_det_id", F.round(bx.giou(bx.box("gt_"), bx.box("dt_")), 9).alias("giou"), F.round(bx.centre_distance(bx.box("gt_"), bx.box("dt_")), 9).alias("dist"))


@add("linked_tracks")
def linked_tracks(spark, d):
    """Tracks by overlap inside shots."""
    b = view(spark, d, "v_boxes").withColumn("shot", F.floor(F.col("frame") / 100))
    return linking.link_tracks(b, ["video_id", "shot"], 10, 0.5, 2)


@add("rotated_overlaps")
def rotated_overlaps(spark, d):
    """Overlap of boxes turned by an angle of their own."""
    t = pairs.pair_table(view(spark, d, "v_gt"), view(spark, d, "v_pred"), ["video_id", "frame", "category_id"], ("det_id", "det_id"), (["conf"], ["conf"]))
    cols = [F.array(*bx.xyxy_to_cxcywh(bx.box(p)), F.col(f"{p}conf") * 90).alias(f"{p}r") for p in ("gt_", "dt_")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["gt_det_id", "dt_det_id"]].assign(iou=[rotated.iou(p, q) for p, q in zip(b["gt_r"], b["dt_r"], strict=True)])

    return t.select("gt_det_id", "dt_det_id", *cols).mapInPandas(work, "gt_det_id string, dt_det_id string, iou double")


@add("refined_segments")
def refined_segments(spark, d):
    """Ten-second segments of a document, each with its own words, snapped to those."""
    w = view(spark, d, "v_words").withColumn("win", F.floor(F.col("start_s") / 10))
    seg = w.groupBy("doc_id", "win").agg(F.min("start_s").alias("start_s"), (F.max("end_s") + 0.2).alias("end_s"), F.collect_list(F.struct("start_s", "end_s")).alias("words"))
    return linking.refine_segments(seg.withColumn("label", (F.col("win") % 2).cast("string")), "doc_id")


@add("best_annotators", ["v_gt"], """with s as (select video_id, frame, track_id % 3 as who, case when count(*) > 3 then null else round(avg(conf), 9) end as f from v_gt group by 1, 2, 3)
  select video_id, frame, who, f from (select *, row_number() over (partition by video_id, frame order by case when f is null then 0 else 1 end, f desc nulls last, who) as r from s) where r = 1""")
def best_annotators(spark, d):
    s = view(spark, d, "v_gt").groupBy("video_id", "frame", (F.col("track_id") % 3).alias("who")).agg(F.when(F.count("*") <= 3, F.round(F.avg("conf"), 9)).alias("f"))
    return linking.best_annotator(s, ["video_id", "frame"], "who", "f")


@add("match_costs", ["v_gt", "v_pred"], f"""with p as (select g.det_id as gt_det_id, p.det_id as dt_det_id, 1 / (1 + exp(-(p.conf * 4 - 2))) as p, (abs(g.x1 - p.x1) + abs(g.y1 - p.y1) + abs(g.x2 - p.x2) + abs(g.y2 - p.y2)) / 600 as l1, {_iou('g.', 'p.')} as iou
    from v_gt g join v_pred p on g.video_id = p.video_id and g.frame = p.frame and g.category_id = p.category_id)
  select gt_det_id, dt_det_id, round(2 * (0.25 * power(1 - p, 2) * -ln(p + 1e-8) - 0.75 * power(p, 2) * -ln(1 - p + 1e-8)) + 5 * l1 - 2 * iou, 9) as cost from p""")
def match_costs(spark, d):
    t = pairs.pair_table(view(spark, d, "v_gt"), view(spark, d, "v_pred"), ["video_id", "frame", "category_id"], ("det_id", "det_id"), ([], ["conf"]))
    l1 = sum((F.abs(F.col(f"gt_{c}") - F.col(f"dt_{c}")) for c in pairs.XYXY), F.lit(0.0)) / 600
    return t.select("gt_det_id", "dt_det_id", F.round(linking.match_cost(F.col("dt_conf") * 4 - 2, l1, F.col("iou"), 2.0, 5.0, 2.0), 9).alias("cost"))


@add("key_frames", ["v_track_frames"], """with t as (select video_id, track_id, count(*) as n from v_track_frames group by 1, 2),
  a as (select video_id, track_id, list_sort(list_distinct(list_concat([0, 2, 4], list_transform(range(5), lambda k: cast(floor(k * (n - 1) / 4.0) as bigint))))) as f from t)
  select video_id, track_id, cast(unnest(f) as int) as pos from a""")
def key_frames(spark, d):
    t = view(spark, d, "v_track_frames").groupBy("video_id", "track_id").agg(F.count("*").cast("int").alias("n"))
    return t.select("video_id", "track_id", F.explode(linking.key_frames(F.col("n"), F.array(F.lit(0), F.lit(2), F.lit(4)))).alias("pos"))
