"""Queries over boxes, tracks and annotation tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions import boxes as bx
from sightline.functions import text as tx
from sightline.operators import assign, intervals, pairs, prune, suppress
from sightline.plans.views import oracle, table, view

Q: dict = {}
O: dict = {}


def add(name: str, views: list[str] | None = None, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            O[name] = oracle(views or [], sql)
        return f

    return keep


def _iou(a: str, b: str) -> str:
    i = f"greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0)"
    u = f"(({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - {i})"
    return f"case when {u} <> 0 then {i} / {u} else 0.0 end"


def _dist(a: str, b: str) -> str:
    return (
        f"sqrt(power(({a}x1 + {a}x2) / 2 - ({b}x1 + {b}x2) / 2, 2) + power(({a}y1 + {a}y2) / 2 - ({b}y1 + {b}y2) / 2, 2)) / "
        f"greatest(1.0, {a}x2 - {a}x1, {a}y2 - {a}y1, {b}x2 - {b}x1, {b}y2 - {b}y1)"
    )


# --- sources -------------------------------------------------------------------------------------------------------


@add("folder_scan", [], """with f as (select page_id, regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1) as base, page_id % 6 as rank, url as path from pages)
  select base, path, rank from (select *, row_number() over (partition by base order by rank, path, page_id) as r from f) where r = 1""")
def folder_scan(spark, d):
    """One file a base name, by preference of its extension (here page_id mod 6) and then by path."""
    f = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"([^/?#]+)(?:[?#].*)?$", 1).alias("base"), (F.col("page_id") % 6).alias("rank"), F.col("url").alias("path"))
    w = Window.partitionBy("base").orderBy("rank", "path", "page_id")
    return f.withColumn("r", F.row_number().over(w)).filter("r = 1").select("base", "path", "rank")


@add("probe_properties", [], """select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(case when l_discount > 0 then l_discount * 300 end, case when l_tax > 0 then l_tax * 500 end, 25.0) as fps,
  cast(round_even(l_quantity * coalesce(case when l_discount > 0 then l_discount * 300 end, case when l_tax > 0 then l_tax * 500 end, 25.0), 0) as bigint) as n_frames from lineitem""")
def probe_properties(spark, d):
    """The first positive candidate for the frame rate, and the frames that follow from it."""
    pos = lambda c: F.when(c > 0, c)
    fps = F.coalesce(pos(F.col("l_discount") * 300), pos(F.col("l_tax") * 500), F.lit(25.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fps.alias("fps"), F.rint(F.col("l_quantity") * fps).cast("long").alias("n_frames"))


@add("probe_times", ["v_events"], """with p as (select user_id, event_id, try_cast(case when event_id % 5 = 0 then 'N/A' when event_id % 7 = 0 then '' else cast(sec as varchar) end as double) as pts from v_events)
  select user_id, count(*) as n, count(pts) as n_valid, count(pts) >= greatest(2, 0.1 * count(*)) as usable from p group by user_id""")
def probe_times(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "N/A").when(F.col("event_id") % 7 == 0, "").otherwise(F.col("sec").cast("string"))
    p = view(spark, d, "v_events").select("user_id", raw.try_cast("double").alias("pts"))
    return p.groupBy("user_id").agg(F.count("*").alias("n"), F.count("pts").alias("n_valid")).withColumn("usable", F.col("n_valid") >= F.greatest(F.lit(2.0), 0.1 * F.col("n")))


@add("json_properties", [], "select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def json_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@add("last_record", [], "select conv_id, arg_max(role, turn) as role, arg_max(md5(text), turn) as text_md5, max(turn) as turn from conversations group by conv_id")
def last_record(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max_by(F.md5("text"), "turn").alias("text_md5"), F.max("turn").alias("turn"))


@add("prediction_dump", ["v_pred"], """select det_id, round_even(round(x1, 9) * 100000, 0) / 100000 as x, round_even(round(y1, 9) * 100000, 0) / 100000 as y, round_even(round(x2 - x1, 9) * 100000, 0) / 100000 as w, round_even(round(y2 - y1, 9) * 100000, 0) / 100000 as h,
  round_even(round(conf, 9) * 100000, 0) / 100000 as score from v_pred""")
def prediction_dump(spark, d):
    r5 = lambda c: F.rint(F.round(c, 9) * 100000) / 100000
    x, y, w, h = bx.xyxy_to_xywh(bx.box())
    return view(spark, d, "v_pred").select("det_id", r5(x).alias("x"), r5(y).alias("y"), r5(w).alias("w"), r5(h).alias("h"), r5(F.col("conf")).alias("score"))


# --- projections and predicates -------------------------------------------------------------------------------------


@add("chunk_to_global", ["v_boxes"], """with c as (select det_id, category_id * 300 + frame % 320 as g, x1 / 1200.0 as nx, y1 / 1200.0 as ny, (x2 - x1) / 1200.0 as nw, (y2 - y1) / 1200.0 as nh from v_boxes),
  p as (select det_id, g as frame, least(greatest(cast(round_even(nx * 640, 0) as int), 0), 639) as x1, least(greatest(cast(round_even(ny * 360, 0) as int), 0), 359) as y1,
    least(greatest(cast(round_even((nx + nw) * 640, 0) as int), 0), 640) as x2, least(greatest(cast(round_even((ny + nh) * 360, 0) as int), 0), 360) as y2 from c where g < 2000)
  select * from p where x2 > x1 and y2 > y1""")
def chunk_to_global(spark, d):
    """Local frames of overlapping chunks as global ones, boxes in whole pixels, degenerate ones gone."""
    n = view(spark, d, "v_boxes").select("det_id", (F.col("category_id") * 300 + F.col("frame") % 320).alias("frame"), *bx.named(bx.scale(bx.xyxy_to_xywh(bx.box()), 1 / F.lit(1.0), 1.0), ("x", "y", "w", "h")))
    n = n.withColumns({c: F.col(c) / 1200.0 for c in "xywh"}).filter("frame < 2000")
    px = n.select("det_id", "frame", *bx.named(bx.from_normalized(bx.box("", ("x", "y", "w", "h")), 640, 360)))
    return px.filter("x2 > x1 and y2 > y1")


@add("box_converters", ["v_boxes"], """select det_id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as w, y2 - y1 as h, (x2 - x1) * (y2 - y1) as area,
  greatest(least(x2, 400.0), 0.0) as clipped_x2, x2 - x1 > 60 and y2 - y1 > 60 as large, x1 >= 0 and y1 >= 0 and x2 < 500 and y2 < 400 as within from v_boxes""")
def box_converters(spark, d):
    b = bx.box()
    cx, cy, w, h = bx.xyxy_to_cxcywh(b)
    return view(spark, d, "v_boxes").select(
        "det_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), bx.area(bx.cxcywh_to_xyxy((cx, cy, w, h))).alias("area"), bx.clip(b, 400.0, 300.0)[2].alias("clipped_x2"),
        bx.non_empty(b, 60).alias("large"), bx.inside(b, 500, 400).alias("within"),
    )


@add("rotated_hulls", ["v_boxes"], """with r as (select det_id, (x1 + x2) / 2 as cx, x2 - x1 as w, y2 - y1 as h, frame * 7.5 - 3000 as a from v_boxes),
  n as (select *, ((a + 180) % 360 + 360) % 360 - 180 as angle from r)
  select det_id, angle, cx - (abs(cos(radians(angle))) * w + abs(sin(radians(angle))) * h) / 2 as x1, w * h as area from n""")
def rotated_hulls(spark, d):
    cx, cy, w, h = bx.xyxy_to_cxcywh(bx.box())
    n = view(spark, d, "v_boxes").select("det_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), bx.normalize_angle(F.col("frame") * 7.5 - 3000).alias("angle"))
    return n.select("det_id", "angle", bx.rotated_to_xyxy(*(F.col(c) for c in ("cx", "cy", "w", "h", "angle")))[0].alias("x1"), (F.col("w") * F.col("h")).alias("area"))


@add("score_thresholds", ["v_pred"], "select video_id, count(*) filter (conf > 0.5) as above, count(*) filter (conf >= 0.5) as reached, count(*) as n from v_pred group by video_id")
def score_thresholds(spark, d):
    return view(spark, d, "v_pred").groupBy("video_id").agg(F.count_if(F.col("conf") > 0.5).alias("above"), F.count_if(F.col("conf") >= 0.5).alias("reached"), F.count("*").alias("n"))


@add("postprocess_scores", ["v_pred"], """with s as (select det_id, video_id, category_id, 1 / (1 + exp(-(conf * 4 - 2))) * 1 / (1 + exp(-(category_id - 3.0))) as score from v_pred)
  select det_id, category_id, score, case when video_id % 3 = 0 then 99 else category_id end as label from s where score > 0.3""")
def postprocess_scores(spark, d):
    """Class probability times presence, a threshold, and labels forced by the queried category."""
    sig = lambda c: 1 / (1 + F.exp(-c))
    s = view(spark, d, "v_pred").withColumn("score", sig(F.col("conf") * 4 - 2) * sig(F.col("category_id") - 3.0)).filter("score > 0.3")
    return s.select("det_id", "category_id", "score", F.coalesce(F.when(F.col("video_id") % 3 == 0, 99), F.col("category_id")).alias("label"))


@add("boundary_suppression", ["v_boxes"], """select det_id from v_boxes where (x1 + x2) / 2 / 600 > 0.025 and (x1 + x2) / 2 / 600 < 0.975 and (y1 + y2) / 2 / 500 > 0.025 and (y1 + y2) / 2 / 500 < 0.975""")
def boundary_suppression(spark, d):
    cx, cy, _, _ = bx.xyxy_to_cxcywh(bx.box())
    near = lambda c: (c > 0.025) & (c < 0.975)
    return view(spark, d, "v_boxes").filter(near(cx / 600) & near(cy / 500)).select("det_id")


@add("valid_tracks", ["v_track_frames"], "select video_id, track_id, count(*) as n from v_track_frames group by video_id, track_id having count(*) > 10 and greatest(avg(x2 - x1), avg(y2 - y1)) > 60")
def valid_tracks(spark, d):
    g = view(spark, d, "v_track_frames").groupBy("video_id", "track_id").agg(F.count("*").alias("n"), F.avg(F.col("x2") - F.col("x1")).alias("w"), F.avg(F.col("y2") - F.col("y1")).alias("h"))
    return g.filter("n > 10 and greatest(w, h) > 60").select("video_id", "track_id", "n")


@add("identity_names", ["v_boxes"], "select distinct track_id, regexp_replace(case when track_id % 2 = 0 then concat('VID_', cast(track_id as varchar)) else concat('Person_', cast(track_id as varchar)) end, '^VID_', 'Person_') as identity from v_boxes")
def identity_names(spark, d):
    raw = F.concat(F.when(F.col("track_id") % 2 == 0, "VID_").otherwise("Person_"), F.col("track_id").cast("string"))
    return view(spark, d, "v_boxes").select("track_id", tx.person_name(raw).alias("identity")).distinct()


@add("one_based_ids", ["v_boxes"], "select det_id, video_id + (select max(case when video_id = 0 then 1 else 0 end) from v_boxes) as video_id, category_id + (select max(case when category_id = 0 then 1 else 0 end) from v_boxes) as category_id from v_boxes")
def one_based_ids(spark, d):
    return prune.to_one_based(view(spark, d, "v_boxes").select("det_id", "video_id", "category_id"), ["video_id", "category_id"])


@add("dataset_filters", ["v_boxes"], """select det_id from v_boxes where side <> 'R' and (x2 - x1) * (y2 - y1) >= 1e-6 and conf >= 0.05 and x2 > x1 and y2 > y1 and video_id in
  (select video_id from v_boxes group by video_id having count(distinct category_id) between 1 and 50)""")
def dataset_filters(spark, d):
    """Crowds, empty targets and degenerate boxes go, and images with too many categories."""
    b = view(spark, d, "v_boxes")
    few = b.groupBy("video_id").agg(F.countDistinct("category_id").alias("n")).filter("n between 1 and 50").select("video_id")
    return b.filter((F.col("side") != "R") & (bx.area(bx.box()) >= 1e-6) & (F.col("conf") >= 0.05) & bx.non_empty(bx.box())).join(few, "video_id", "left_semi").select("det_id")


@add("text_queries", [], "select l_orderkey, l_linenumber, l_partkey, case when lower(trim(l_returnflag)) in ('a', 'r') then 'visual' else concat('find ', l_returnflag, ' now') end as query from lineitem")
def text_queries(spark, d):
    c = F.col("l_returnflag")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.lower(F.trim(c)).isin("a", "r"), "visual").otherwise(F.concat(F.lit("find "), c, F.lit(" now"))).alias("query"))


# --- joins ----------------------------------------------------------------------------------------------------------


@add("track_scenes", ["v_track_frames", "v_shots"], """with t as (select video_id, track_id, frame // 40 as part, min(frame) as t0, max(frame) as t1 from v_track_frames group by video_id, track_id, frame // 40)
  select t.video_id, track_id, part, shot_id from t join v_shots s on t.video_id = s.video_id and t0 >= start_f and t1 <= end_f - 1""")
def track_scenes(spark, d):
    t = view(spark, d, "v_track_frames").groupBy("video_id", "track_id", F.floor(F.col("frame") / 40).alias("part")).agg(F.min("frame").alias("t0"), F.max("frame").alias("t1"))
    met = intervals.point_join(t, view(spark, d, "v_shots"), ["video_id"], "t0", ("start_f", "end_f"), 100.0)
    return met.filter("t1 <= end_f - 1").select("video_id", "track_id", "part", "shot_id")


@add("scene_slices", ["v_boxes", "v_shots"], """select s.video_id, shot_id, count(*) as n, min(frame) as first_f from v_shots s join v_boxes b on b.video_id = s.video_id and frame >= start_f and frame < end_f where end_f - start_f >= 10 group by s.video_id, shot_id""")
def scene_slices(spark, d):
    shots = view(spark, d, "v_shots").filter("end_f - start_f >= 10")
    met = intervals.point_join(view(spark, d, "v_boxes").select("video_id", "frame"), shots, ["video_id"], "frame", ("start_f", "end_f"), 100.0)
    return met.groupBy("video_id", "shot_id").agg(F.count("*").alias("n"), F.min("frame").alias("first_f"))


@add("co_presence", ["v_track_frames"], f"""with m as (select a.video_id, a.track_id as a_track_id, b.track_id as b_track_id, {_iou('a.', 'b.')} as iou, {_dist('a.', 'b.')} as dist
    from v_track_frames a join v_track_frames b on a.video_id = b.video_id and a.frame = b.frame and a.track_id < b.track_id)
  select video_id, a_track_id, b_track_id, count(*) as n_frames, avg(iou) as mean_iou, median(iou) as median_iou, avg(dist) as mean_dist, median(dist) as median_dist from m group by video_id, a_track_id, b_track_id having count(*) >= 3""")
def co_presence(spark, d):
    return pairs.co_presence(view(spark, d, "v_track_frames"), ["video_id"], "track_id", "frame", 3)


@add("link_constraints", ["v_track_frames"], f"""with m as (select a.video_id, a.track_id as a_track_id, b.track_id as b_track_id, {_iou('a.', 'b.')} as iou, {_dist('a.', 'b.')} as dist
    from v_track_frames a join v_track_frames b on a.video_id = b.video_id and a.frame = b.frame and a.track_id < b.track_id),
  g as (select video_id, a_track_id, b_track_id, avg(iou) as i, avg(dist) as s from m group by video_id, a_track_id, b_track_id having count(*) >= 2)
  select video_id, a_track_id, b_track_id, case when i >= 0.70 or s <= 0.12 then 'must' else 'cannot' end as link from g where i >= 0.70 or s <= 0.12 or (i <= 0.10 and s >= 0.40)""")
def link_constraints(spark, d):
    c = pairs.co_presence(view(spark, d, "v_track_frames"), ["video_id"], "track_id", "frame", 2)
    return c.withColumn("link", pairs.link_kind(F.col("mean_iou"), F.col("mean_dist"))).filter("link is not null").select("video_id", "a_track_id", "b_track_id", "link")


@add("identity_co_presence", ["v_boxes"], f"""with b as (select video_id, category_id as ident, frame, arg_max({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, ((x2 - x1) * (y2 - y1), det_id)) as b from v_boxes group by video_id, category_id, frame),
  f as (select video_id, ident, frame, b.x1 as x1, b.y1 as y1, b.x2 as x2, b.y2 as y2 from b),
  m as (select a.video_id, a.ident as a_ident, b.ident as b_ident, {_iou('a.', 'b.')} as iou from f a join f b on a.video_id = b.video_id and a.frame = b.frame and a.ident < b.ident)
  select video_id, a_ident, b_ident, count(*) as n_frames, list_sort(list(iou))[count(*) // 2 + 1] as upper_median from m group by video_id, a_ident, b_ident having count(*) >= 3""")
def identity_co_presence(spark, d):
    """The largest box of each identity and frame; the upper median of IoU over common frames."""
    b = view(spark, d, "v_boxes").groupBy("video_id", F.col("category_id").alias("ident"), "frame").agg(F.max_by(F.struct(*pairs.XYXY), F.struct(bx.area(bx.box()).alias("a"), "det_id")).alias("b")).select("video_id", "ident", "frame", "b.*")
    x, y = (pairs.prefixed(b, p, ["video_id", "frame"], ["ident", *pairs.XYXY]) for p in ("a_", "b_"))
    m = x.join(y, ["video_id", "frame"]).filter("a_ident < b_ident").withColumn("iou", bx.iou(bx.box("a_"), bx.box("b_")))
    g = m.groupBy("video_id", "a_ident", "b_ident").agg(F.count("*").alias("n_frames"), F.collect_list("iou").alias("_all")).filter("n_frames >= 3")
    return g.select("video_id", "a_ident", "b_ident", "n_frames", pairs.upper_median(F.col("_all")).alias("upper_median"))


@add("identity_spans", ["v_boxes"], """with s as (select video_id, track_id, min(frame) as s, max(frame) as e from v_boxes group by video_id, track_id)
  select a.video_id, a.track_id as a_track, b.track_id as b_track, least(a.e, b.e) - greatest(a.s, b.s) as shared from s a join s b on a.video_id = b.video_id and a.track_id < b.track_id and least(a.e, b.e) - greatest(a.s, b.s) >= 3""")
def identity_spans(spark, d):
    """Pairs of tracks whose spans overlap by three frames or more: an interval join inside each video."""
    s = view(spark, d, "v_boxes").groupBy("video_id", "track_id").agg(F.min("frame").alias("s"), F.max("frame").alias("e"))
    a, b = (pairs.prefixed(s, p, ["video_id"], ["track_id", "s", "e"]) for p in ("a_", "b_"))
    m = intervals.interval_join(a, b, ["video_id"], ("a_s", "a_e"), ("b_s", "b_e"), 1000.0).filter("a_track_id < b_track_id")
    return m.withColumn("shared", F.least("a_e", "b_e") - F.greatest("a_s", "b_s")).filter("shared >= 3").select("video_id", F.col("a_track_id").alias("a_track"), F.col("b_track_id").alias("b_track"), "shared")


@add("iou_pairs", ["v_gt", "v_pred"], f"select g.video_id, g.frame, g.det_id as gt_det_id, p.det_id as dt_det_id, {_iou('g.', 'p.')} as iou from v_gt g join v_pred p on g.video_id = p.video_id and g.frame = p.frame and g.category_id = p.category_id")
def iou_pairs(spark, d):
    return pairs.pair_table(view(spark, d, "v_gt"), view(spark, d, "v_pred"), ["video_id", "frame", "category_id"], ("det_id", "det_id")).select("video_id", "frame", "gt_det_id", "dt_det_id", "iou")


@add("best_overlap", ["v_gt", "v_pred"], f"""with p as (select g.det_id as gt_det_id, p.det_id as dt_det_id, {_iou('g.', 'p.')} as iou, greatest(0.0, 1 - sqrt(power((g.x1 + g.x2) / 1200 - (p.x1 + p.x2) / 1200, 2) + power((g.y1 + g.y2) / 1000 - (p.y1 + p.y2) / 1000, 2)) / 2) as near
   from v_gt g join v_pred p on g.video_id = p.video_id and g.frame = p.frame)
  select gt_det_id, dt_det_id, iou, near from (select *, row_number() over (partition by gt_det_id order by iou desc, dt_det_id) as r from p) where r = 1""")
def best_overlap(spark, d):
    t = pairs.pair_table(view(spark, d, "v_gt"), view(spark, d, "v_pred"), ["video_id", "frame"], ("det_id", "det_id"))
    n = lambda p: bx.normalize(bx.box(p), F.lit(600.0), F.lit(500.0))
    t = t.withColumn("near", bx.euclidean_similarity(n("gt_"), n("dt_")))
    return assign.best_match(t, [], "gt_det_id", "iou", ["dt_det_id"]).select("gt_det_id", "dt_det_id", "iou", "near")


@add("fill_missing_video", [], "select l_orderkey, l_linenumber, l_partkey, coalesce(case when l_linenumber % 3 <> 0 then l_suppkey end, o_custkey) as video_id from lineitem left join orders on l_orderkey = o_orderkey")
def fill_missing_video(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    have = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", have.alias("v")).join(o, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("v", "o_custkey").alias("video_id"))


@add("availability_cascade", [], """with k as (select o_orderkey from orders where o_orderkey % 3 = 0) select l_orderkey, count(*) as n from lineitem where l_orderkey in (select o_orderkey from k) and l_suppkey in (select s_suppkey from supplier) group by l_orderkey""")
def availability_cascade(spark, d):
    have = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    (kept,) = prune.keep_available([(table(spark, d, "lineitem"), ["l_orderkey"])], have)
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return kept.join(sup, "l_suppkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@add("positive_categories", ["v_gt", "v_pred"], "select det_id from v_pred p where exists (select 1 from v_gt g where g.video_id = p.video_id and g.frame = p.frame and g.category_id = p.category_id)")
def positive_categories(spark, d):
    keys = ["video_id", "frame", "category_id"]
    return view(spark, d, "v_pred").join(view(spark, d, "v_gt").select(*keys).distinct(), keys, "left_semi").select("det_id")


@add("unused_objects", [], "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def unused_objects(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@add("negative_pairs", ["v_gt", "v_pred"], """with g as (select video_id, category_id, count(*) as n_gt from v_gt where conf > 0.8 group by 1, 2), p as (select video_id, category_id, count(*) as n_dt from v_pred where conf > 0.9 group by 1, 2)
  select coalesce(g.video_id, p.video_id) as video_id, coalesce(g.category_id, p.category_id) as category_id, coalesce(n_gt, 0) as n_gt, coalesce(n_dt, 0) as n_dt from g full join p on g.video_id = p.video_id and g.category_id = p.category_id""")
def negative_pairs(spark, d):
    k = ["video_id", "category_id"]
    g = view(spark, d, "v_gt").filter("conf > 0.8").groupBy(*k).agg(F.count("*").alias("n_gt"))
    p = view(spark, d, "v_pred").filter("conf > 0.9").groupBy(*k).agg(F.count("*").alias("n_dt"))
    return g.join(p, k, "full").fillna(0, ["n_gt", "n_dt"])


@add("tagged_videos", ["v_boxes"], "select video_id from v_boxes where track_id % 7 = 0 group by video_id having bool_and(conf > 0)")
def tagged_videos(spark, d):
    return view(spark, d, "v_boxes").filter("track_id % 7 = 0").groupBy("video_id").agg(F.bool_and(F.col("conf") > 0).alias("ok")).filter("ok").select("video_id")


# --- aggregation, ranking, sets -------------------------------------------------------------------------------------


@add("top_detections", ["v_pred"], "select det_id, video_id, frame, rank from (select *, row_number() over (partition by video_id, frame order by conf desc, det_id) as rank from v_pred) where rank <= 5")
def top_detections(spark, d):
    return pairs.top_k(view(spark, d, "v_pred"), ["video_id", "frame"], "conf", 5, ["det_id"]).select("det_id", "video_id", "frame", "rank")


@add("first_dump_wins", ["v_pred"], "select det_id, dump from (select det_id, track_id % 4 as dump, min(track_id % 4) over (partition by video_id, frame, category_id) as f from v_pred) where dump = f")
def first_dump_wins(spark, d):
    p = view(spark, d, "v_pred").withColumn("dump", F.col("track_id") % 4)
    return pairs.first_wins(p, ["video_id", "frame", "category_id"], "dump").select("det_id", "dump")


@add("dense_pair_ids", ["v_boxes"], "select distinct video_id, category_id, dense_rank() over (order by video_id, category_id) as new_id from v_boxes")
def dense_pair_ids(spark, d):
    return prune.dense_ids(view(spark, d, "v_boxes").select("video_id", "category_id").distinct(), ["video_id", "category_id"], "new_id")


@add("timesteps", ["v_boxes"], "select video_id, frame, dense_rank() over (partition by video_id order by frame) - 1 as step from (select distinct video_id, frame from v_boxes)")
def timesteps(spark, d):
    return prune.compact(view(spark, d, "v_boxes").select("video_id", "frame").distinct(), ["video_id"], "frame", "step")


@add("tracklet_summary", ["v_boxes"], """with c as (select video_id, track_id, category_id, count(*) as n from v_boxes group by 1, 2, 3), l as (select video_id, track_id, arg_min(category_id, (-n, category_id)) as label from c group by 1, 2)
  select b.video_id, b.track_id, avg(conf) as score, count(*) as n, avg((x2 - x1) * (y2 - y1)) as mean_area, min(label) as label from v_boxes b join l on b.video_id = l.video_id and b.track_id = l.track_id group by b.video_id, b.track_id""")
def tracklet_summary(spark, d):
    b = view(spark, d, "v_boxes")
    k = ["video_id", "track_id"]
    label = b.groupBy(*k, "category_id").agg(F.count("*").alias("n")).groupBy(*k).agg(F.min_by("category_id", F.struct(-F.col("n"), "category_id")).alias("label"))
    return b.groupBy(*k).agg(F.avg("conf").alias("score"), F.count("*").alias("n"), F.avg(bx.area(bx.box())).alias("mean_area")).join(label, k)


@add("area_buckets", ["v_boxes"], """with r as (select 'all' as bucket, 0.0 as lo, 1e10 as hi union all select 'small', 0, 16384 union all select 'medium', 16384, 65536 union all select 'large', 65536, 1e10)
  select category_id, bucket, count(*) as n, avg(conf) as score from v_boxes join r on (x2 - x1) * (y2 - y1) >= lo and (x2 - x1) * (y2 - y1) < hi group by category_id, bucket""")
def area_buckets(spark, d):
    a = bx.area(bx.box())
    ranges = F.array(*[F.struct(F.lit(n).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in (("all", 0.0, 1e10), ("small", 0.0, 16384.0), ("medium", 16384.0, 65536.0), ("large", 65536.0, 1e10))])
    b = view(spark, d, "v_boxes").select("category_id", "conf", a.alias("area"), F.explode(ranges).alias("r")).filter("area >= r.lo and area < r.hi")
    return b.groupBy("category_id", F.col("r.bucket").alias("bucket")).agg(F.count("*").alias("n"), F.avg("conf").alias("score"))


@add("benchmark_averages", ["v_boxes"], """with v as (select video_id, category_id, avg(conf) as m from v_boxes group by 1, 2), s as (select video_id, avg(m) as mean from v group by 1)
  select 'all' as level, cast(null as bigint) as video_id, avg(mean) as mean from s union all select 'video', video_id, mean from s""")
def benchmark_averages(spark, d):
    """A mean of means on two levels, which no plain rollup gives."""
    s = view(spark, d, "v_boxes").groupBy("video_id", "category_id").agg(F.avg("conf").alias("m")).groupBy("video_id").agg(F.avg("m").alias("mean"))
    top = s.agg(F.avg("mean").alias("mean")).select(F.lit("all").alias("level"), F.lit(None).cast("long").alias("video_id"), "mean")
    return top.union(s.select(F.lit("video"), "video_id", "mean"))


@add("meters", ["v_scores"], "select track_id, pos, round(sum(score) over w, 6) as total, count(*) over w as n, round(sum(score) over w, 6) / count(*) over w as mean from v_scores window w as (partition by track_id order by pos)")
def meters(spark, d):
    w = Window.partitionBy("track_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return view(spark, d, "v_scores").select("track_id", "pos", F.round(F.sum("score").over(w), 6).alias("total"), F.count("*").over(w).alias("n"), (F.round(F.sum("score").over(w), 6) / F.count("*").over(w)).alias("mean"))


@add("count_metric", ["v_gt", "v_pred"], """with g as (select video_id, count(*) as gt_dets, count(distinct track_id) as gt_ids from v_gt group by 1), p as (select video_id, count(*) as dets, count(distinct track_id) as ids from v_pred group by 1), f as (select video_id, count(distinct frame) as frames from v_boxes group by 1)
  select f.video_id, dets, gt_dets, ids, gt_ids, frames from f join g on f.video_id = g.video_id join p on f.video_id = p.video_id""")
def count_metric(spark, d):
    n = lambda v, a, b: view(spark, d, v).groupBy("video_id").agg(F.count("*").alias(a), F.countDistinct("track_id").alias(b))
    f = view(spark, d, "v_boxes").groupBy("video_id").agg(F.countDistinct("frame").alias("frames"))
    return f.join(n("v_gt", "gt_dets", "gt_ids"), "video_id").join(n("v_pred", "dets", "ids"), "video_id").select("video_id", "dets", "gt_dets", "ids", "gt_ids", "frames")


@add("one_to_many_matches", ["v_gt", "v_pred"], f"""with p as (select g.det_id as gt_det_id, p.det_id as dt_det_id, 0.5 * p.conf + 0.5 * ({_iou('g.', 'p.')}) as mixed from v_gt g join v_pred p on g.video_id = p.video_id and g.frame = p.frame),
  q as (select gt_det_id, list_sort(list(mixed)) as m, count(*) as n from p group by 1),
  b as (select gt_det_id, quantile_at as bound from (select gt_det_id, m[cast(floor(greatest(0.0, 1 - 2.0 / n) * (n - 1)) as int) + 1] + (m[cast(ceil(greatest(0.0, 1 - 2.0 / n) * (n - 1)) as int) + 1] - m[cast(floor(greatest(0.0, 1 - 2.0 / n) * (n - 1)) as int) + 1]) * (greatest(0.0, 1 - 2.0 / n) * (n - 1) - floor(greatest(0.0, 1 - 2.0 / n) * (n - 1))) as quantile_at from q))
  select p.gt_det_id, dt_det_id, mixed from p join b on p.gt_det_id = b.gt_det_id where mixed > bound and mixed > 0.3""")
def one_to_many_matches(spark, d):
    t = pairs.pair_table(view(spark, d, "v_gt"), view(spark, d, "v_pred"), ["video_id", "frame"], ("det_id", "det_id"), ([], ["conf"]))
    return assign.one_to_many(t, [], "gt_det_id", "dt_det_id", "dt_conf", "iou", 0.5, 2, 0.3).select("gt_det_id", "dt_det_id", "mixed")


@add("set_operations", ["v_gt", "v_pred"], """select 'both' as part, count(*) as n from (select video_id, frame from v_gt intersect select video_id, frame from v_pred) union all
  select 'gt only', count(*) from (select video_id, frame from v_gt except select video_id, frame from v_pred) union all select 'any', count(*) from (select video_id, frame from v_gt union select video_id, frame from v_pred)""")
def set_operations(spark, d):
    g, p = (view(spark, d, v).select("video_id", "frame") for v in ("v_gt", "v_pred"))
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n("both", g.intersect(p)).union(n("gt only", g.subtract(p))).union(n("any", g.union(p).distinct()))


@add("hash_sample", ["v_pred"], """with r as (select *, conf > 0.95 as positive, row_number() over (partition by video_id, category_id order by (conf > 0.95) desc, md5(concat(det_id, '/7')), det_id) as r from v_pred)
  select video_id, category_id, det_id, positive from r where positive or r <= 10""")
def hash_sample(spark, d):
    """Up to ten detections a video and category, all confident ones among them, the same on every run."""
    p = view(spark, d, "v_pred").withColumn("positive", F.col("conf") > 0.95)
    return prune.sample_queries(p, ["video_id", "category_id"], "positive", 10, 7, ["det_id"]).select("video_id", "category_id", "det_id", "positive")


@add("subsample", ["v_track_frames"], """with n as (select *, row_number() over w as r, count(*) over (partition by video_id, track_id) as n from v_track_frames window w as (partition by video_id, track_id order by frame))
  select video_id, track_id, frame from n where n <= 50 or (r - 1) % (n // 50) = 0""")
def subsample(spark, d):
    w = Window.partitionBy("video_id", "track_id")
    n = view(spark, d, "v_track_frames").withColumns({"r": F.row_number().over(w.orderBy("frame")), "n": F.count("*").over(w)})
    return n.filter((F.col("n") <= 50) | ((F.col("r") - 1) % F.greatest(F.floor(F.col("n") / 50), F.lit(1)) == 0)).select("video_id", "track_id", "frame")


# --- dataset shaping and agent log ----------------------------------------------------------------------------------


@add("visible_annotations", ["v_boxes"], """with a as (select video_id, track_id, list(case when conf > 0.3 then {'frame': frame, 'area': (x2 - x1) * (y2 - y1)} end order by frame, det_id) as items from v_boxes group by 1, 2)
  select video_id, track_id, len(items) as n, len(list_filter(items, lambda x: x is not null)) as n_visible, list_avg(list_transform(list_filter(items, lambda x: x is not null), lambda x: x.area)) as mean_area from a""")
def visible_annotations(spark, d):
    """Per-frame lists with nulls for invisible frames, and what is visible of them."""
    item = F.when(F.col("conf") > 0.3, F.struct("frame", bx.area(bx.box()).alias("area")))
    a = view(spark, d, "v_boxes").groupBy("video_id", "track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "det_id", item.alias("item")))), lambda x: x["item"]).alias("items"))
    seen = F.filter("items", lambda x: x.isNotNull())
    mean = F.aggregate(seen, F.lit(0.0), lambda s, x: s + x["area"]) / F.nullif(F.size(seen), F.lit(0))
    return a.select("video_id", "track_id", F.size("items").alias("n"), F.size(seen).alias("n_visible"), mean.alias("mean_area"))


@add("frame_rows", ["v_boxes"], """select video_id, frame, count(*) as n, md5(string_agg(det_id, ',' order by det_id)) as dets_md5 from v_boxes group by video_id, frame""")
def frame_rows(spark, d):
    return view(spark, d, "v_boxes").groupBy("video_id", "frame").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("det_id")), ",")).alias("dets_md5"))


@add("merged_categories", ["v_boxes"], "select coalesce(parent, category_id) as category_id, count(*) as n from v_boxes left join (select unnest([5, 6, 7]) as child, 1 as parent) on child = category_id group by 1")
def merged_categories(spark, d):
    m = spark.range(1).select(F.explode(F.array(F.lit(5), F.lit(6), F.lit(7))).alias("category_id"), F.lit(1).alias("parent"))
    return view(spark, d, "v_boxes").join(F.broadcast(m), "category_id", "left").groupBy(F.coalesce("parent", "category_id").alias("category_id")).agg(F.count("*").alias("n"))


@add("agent_pruned_history", [], """with m as (select conv_id, max(turn) filter (role = 'assistant') as top from conversations group by 1)
  select c.conv_id, turn, role from conversations c join m on c.conv_id = m.conv_id where turn < 2 or turn >= top""")
def agent_pruned_history(spark, d):
    """The first two messages and everything from the latest assistant message on."""
    top = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return table(spark, d, "conversations").withColumn("top", top).filter("turn < 2 or turn >= top").select("conv_id", "turn", "role")


@add("agent_repeated_prompts", [], """select conv_id, turn, row_number() over (partition by conv_id, lower(trim(text)) order by turn) = 1 as accepted from conversations where role = 'user'""")
def agent_repeated_prompts(spark, d):
    w = Window.partitionBy("conv_id", F.lower(F.trim("text"))).orderBy("turn")
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", (F.row_number().over(w) == 1).alias("accepted"))


@add("agent_tool_calls", [], """with t as (select conv_id, turn, concat('<tool>{"name": "segment", "turn": ', cast(turn as varchar), '}}}</tool>', case when turn % 2 = 0 then '<verdict> Accept </verdict>' else '' end) as text from conversations)
  select conv_id, turn, replace(trim(regexp_extract(text, '(?s)<tool>(.*?)</tool>', 1)), '}}}', '}}') as call, nullif(regexp_extract(text, '(?s)<verdict>\\s*(Accept|Reject)\\s*</verdict>', 1), '') as verdict from t""")
def agent_tool_calls(spark, d):
    text = F.concat(F.lit('<tool>{"name": "segment", "turn": '), F.col("turn").cast("string"), F.lit("}}}</tool>"), F.when(F.col("turn") % 2 == 0, "<verdict> Accept </verdict>").otherwise(""))
    t = table(spark, d, "conversations").select("conv_id", "turn", text.alias("t"))
    return t.select("conv_id", "turn", tx.tool_call(F.col("t")).alias("call"), tx.verdict(F.col("t")).alias("verdict"))


@add("wrapped_lines", [], """with recursive w as (select item_id, word, row_number() over (partition by item_id order by spot) as i, n from
    (select item_id, unnest(words) as word, generate_subscripts(words, 1) as spot, n from (select item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as words, case when regexp_matches(text, '[一-鿿]') then 16 else 24 end as n from benchmark))),
  r as (select item_id, i, n, 0 as line, word as text from w where i = 1 union all
    select w.item_id, w.i, w.n, case when length(r.text) + 1 + length(w.word) <= w.n then r.line else r.line + 1 end, case when length(r.text) + 1 + length(w.word) <= w.n then concat(r.text, ' ', w.word) else w.word end
    from r join w on w.item_id = r.item_id and w.i = r.i + 1)
  select item_id, line, arg_max(text, i) as text from r group by 1, 2""")
def wrapped_lines(spark, d):
    """Benchmark texts as subtitle lines."""
    b = table(spark, d, "benchmark").select("item_id", F.posexplode(tx.wrap_subtitle(F.col("text"))).alias("line", "text"))
    return b.select("item_id", "line", "text")


@add("palette", ["v_boxes"], "select track_id, (dense_rank() over (order by track_id) - 1) % 10 as colour from (select distinct track_id from v_boxes)")
def palette(spark, d):
    """A colour of ten for each identity in order."""
    ids = prune.dense_ids(view(spark, d, "v_boxes").select("track_id").distinct(), ["track_id"], "i", 0)
    return ids.select("track_id", (F.col("i") % 10).alias("colour"))


def _greedy_sql(view_sql: str, conflict: str) -> str:
    """Greedy suppression as a recursion over ranks that carries the list of boxes kept so far."""
    return f"""with recursive ranked as (select video_id, frame, {{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} as b, row_number() over (partition by video_id, frame order by conf desc, det_id) as rn from {view_sql}),
  r as (select video_id, frame, rn, [b] as kept from ranked where rn = 1 union all
    select n.video_id, n.frame, n.rn, case when len(list_filter(r.kept, lambda k: {conflict})) = 0 then list_append(r.kept, n.b) else r.kept end from r join ranked n on n.video_id = r.video_id and n.frame = r.frame and n.rn = r.rn + 1)
  select video_id, frame, unnest(list_transform(kept, lambda k: k.det_id)) as det_id from (select *, row_number() over (partition by video_id, frame order by rn desc) as q from r) where q = 1"""


def _iom(a: str, b: str) -> str:
    i = f"greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0)"
    return f"{i} / least(({a}x2 - {a}x1) * ({a}y2 - {a}y1), ({b}x2 - {b}x1) * ({b}y2 - {b}y1))"


# --- suppression and assignment -------------------------------------------------------------------------------------


@add("frame_nms", ["v_boxes"], _greedy_sql("v_boxes", f"{_iou('k.', 'n.b.')} >= 0.70 or {_dist('k.', 'n.b.')} <= 0.25"))
def frame_nms(spark, d):
    b = view(spark, d, "v_boxes")
    return suppress.suppress(b, ["video_id", "frame"], "conf", ["det_id"], suppress.iou_or_centre(0.70, 0.25)).select("video_id", "frame", "det_id")


@add("strict_nms", ["v_boxes"], _greedy_sql("v_boxes where conf > 0.2", f"{_iou('k.', 'n.b.')} > 0.3"))
def strict_nms(spark, d):
    return suppress.suppress(view(spark, d, "v_boxes").filter("conf > 0.2"), ["video_id", "frame"], "conf", ["det_id"], suppress.iou_above(0.3)).select("video_id", "frame", "det_id")


@add("overlap_removal", ["v_boxes"], _greedy_sql("v_boxes", f"{_iom('k.', 'n.b.')} > 0.3"))
def overlap_removal(spark, d):
    return suppress.suppress(view(spark, d, "v_boxes"), ["video_id", "frame"], "conf", ["det_id"], suppress.iom_above(0.3)).select("video_id", "frame", "det_id")


def _matching_sql(pairs_name: str) -> str:
    """CTEs ending in mt (k, gt, dt): of all matchings of a group's pairs (k, gt, dt, w), the one of the largest sum of w."""
    return f"""gi as (select k, cast(gt as varchar) as gt, cast(dt as varchar) as dt, cast(w as double) as w, dense_rank() over (partition by k order by cast(gt as varchar)) as i from {pairs_name}),
  op as (select k, i, gt, dt, w from gi union all select distinct k, i, gt, null, cast(0 as double) from gi),
  ms as (select distinct k, cast(0 as bigint) as i, cast([] as varchar[]) as used, cast([] as struct(gt varchar, dt varchar)[]) as picks, cast(0 as double) as total from gi union all
    select s.k, o.i, case when o.dt is null then s.used else list_append(s.used, o.dt) end, case when o.dt is null then s.picks else list_append(s.picks, {{'gt': o.gt, 'dt': o.dt}}) end, s.total + o.w
    from ms s join op o on o.k = s.k and o.i = s.i + 1 where o.dt is null or not list_contains(s.used, o.dt)),
  mx as (select k, max(i) as n from gi group by k),
  mb as (select ms.k, arg_max(picks, total) as picks from ms join mx on ms.k = mx.k and ms.i = mx.n group by ms.k),
  mt as (select k, p.gt as gt, p.dt as dt from (select k, unnest(picks) as p from mb))"""


_TRACK_PAIRS = f"""t as (select *, cast(floor(frame / 100) as bigint) as shot from v_track_frames),
  p as (select video_id, shot, a_id, b_id, count(*) as n, sum(i) / nullif(sum(u), 0) as shared, median(iou) as m_iou, median(dist) as m_dist from
    (select a.video_id, a.shot, a.track_id as a_id, b.track_id as b_id, {_iou('a.', 'b.')} as iou, {_dist('a.', 'b.')} as dist, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as i,
       (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as u
     from t a join t b on a.video_id = b.video_id and a.frame = b.frame and a.track_id < b.track_id) group by 1, 2, 3, 4)"""


@add("track_nms", ["v_track_frames"], f"""with recursive {_TRACK_PAIRS},
  c as (select video_id, shot, a_id as x, b_id as y from p where shared >= 0.3 union all select video_id, shot, b_id, a_id from p where shared >= 0.3),
  g as (select video_id, shot, x, list(y) as against from c group by 1, 2, 3),
  s as (select t.video_id, t.shot, track_id, coalesce(any_value(against), []) as against, row_number() over (partition by t.video_id, t.shot order by round(avg(conf), 9) desc, track_id) as rn
    from t left join g on g.video_id = t.video_id and g.shot = t.shot and g.x = t.track_id group by t.video_id, t.shot, track_id),
  r as (select video_id, shot, rn, [track_id] as kept from s where rn = 1 union all
    select n.video_id, n.shot, n.rn, case when list_has_any(r.kept, n.against) then r.kept else list_append(r.kept, n.track_id) end from r join s n on n.video_id = r.video_id and n.shot = r.shot and n.rn = r.rn + 1)
  select video_id, shot, unnest(kept) as track_id from (select *, row_number() over (partition by video_id, shot order by rn desc) as q from r) where q = 1""")
def track_nms(spark, d):
    return suppress.track_nms(view(spark, d, "v_track_frames").withColumn("shot", F.floor(F.col("frame") / 100)), ["video_id", "shot"], "track_id", "frame", "conf", 0.3)


@add("track_dedupe", ["v_track_frames"], f"""with recursive {_TRACK_PAIRS},
  z as (select video_id, shot, track_id, count(*) as size from t group by 1, 2, 3),
  c as (select p.*, case when za.size < zb.size then a_id else b_id end as loser, row_number() over (partition by p.video_id, p.shot order by a_id, b_id) as rn from p
    join z za on za.video_id = p.video_id and za.shot = p.shot and za.track_id = a_id join z zb on zb.video_id = p.video_id and zb.shot = p.shot and zb.track_id = b_id where n >= 1 and (m_iou >= 0.35 or m_dist <= 0.20)),
  r as (select video_id, shot, rn, [loser] as gone from c where rn = 1 union all
    select n.video_id, n.shot, n.rn, case when list_has_any(r.gone, [n.a_id, n.b_id]) then r.gone else list_append(r.gone, n.loser) end from r join c n on n.video_id = r.video_id and n.shot = r.shot and n.rn = r.rn + 1),
  e as (select video_id, shot, unnest(gone) as track_id from (select *, row_number() over (partition by video_id, shot order by rn desc) as q from r) where q = 1)
  select video_id, shot, track_id from z anti join e using (video_id, shot, track_id)""")
def track_dedupe(spark, d):
    return suppress.track_dedupe(view(spark, d, "v_track_frames").withColumn("shot", F.floor(F.col("frame") / 100)), ["video_id", "shot"], "track_id", "frame", 0.35, 0.20, 1)


@add("assignment", ["v_gt", "v_pred"], f"""with recursive pr as (select * from (select {{'v': g.video_id, 'f': g.frame}} as k, g.det_id as gt, p.det_id as dt, {_iou('g.', 'p.')} as iou, iou * (1 - 1e-9 * dense_rank() over (partition by g.video_id, g.frame order by g.det_id)) as w from v_gt g join v_pred p on g.video_id = p.video_id and g.frame = p.frame) where iou > 0),
  {_matching_sql('pr')}
  select mt.k.v as video_id, mt.k.f as frame, mt.gt as gt_det_id, mt.dt as dt_det_id, 1 - iou as cost from mt join pr on pr.k = mt.k and pr.gt = mt.gt and pr.dt = mt.dt where 1 - iou <= 0.9""")
def assignment(spark, d):
    """Matches of least cost; of equally near truths the first by id is taken, as of equally near predictions that only one truth meets.

    The SQL leaves the choice between such predictions to the order in which its threads end.
    """
    t = pairs.pair_table(view(spark, d, "v_gt"), view(spark, d, "v_pred"), ["video_id", "frame"], ("det_id", "det_id"))
    rank = F.dense_rank().over(Window.partitionBy("video_id", "frame").orderBy("gt_det_id"))
    # the weight itself and not 1 less it, which rounds its last bits away
    t = t.withColumn("cost", -F.col("iou") * (1 - 1e-9 * rank)).filter("iou > 0")
    # a pair without overlap costs 0, as one that isn't listed does here
    matched = assign.assign(t, ["video_id", "frame"], "gt_det_id", "dt_det_id", "cost", missing=0.0, keep=("iou",))
    return matched.withColumn("cost", 1 - F.col("iou")).filter("cost <= 0.9").drop("iou")
