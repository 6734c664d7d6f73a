"""Queries of masks in frames and of the small steps between stages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sightline.functions import boxes as bx
from sightline.functions import rle
from sightline.operators import linking, masks, metrics, pairs, shaping, speakers
from sightline.plans.detections import _greedy_sql, _iou
from sightline.plans.evaluation import _HOTA, _HOTA_FIELDS, _sides
from sightline.plans.views import oracle, table, view
from sightline.streaming import sessions

Q: dict = {}
O: dict = {}
#: Rows and columns of the grid that boxes are drawn on as masks.
HEIGHT, WIDTH = 100, 200


def add(name: str, views: list[str] | None = None, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            O[name] = oracle(views or [], sql)
        return f

    return keep


def _masks(spark, d, name: str):
    """Boxes as run-length masks on the coarse grid."""

    def work(batches):
        for b in batches:
            cells = np.floor(np.stack([np.asarray(b[c], dtype=float) for c in pairs.XYXY], 1) / 10).astype(int)
            runs = [rle.from_box(*map(int, r), HEIGHT, WIDTH) for r in cells]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("video_id", "frame", "det_id", "conf")), pa.array(runs, pa.list_(pa.int32()))], ["video_id", "frame", "det_id", "conf", "counts"])

    rows = view(spark, d, name).select("video_id", "frame", "det_id", F.col("conf").cast("double").alias("conf"), *pairs.XYXY)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(work, f"video_id {types['video_id']}, frame {types['frame']}, det_id string, conf double, counts array<int>")


_GRID = "select video_id, frame, det_id, conf, floor(x1 / 10) as x1, floor(y1 / 10) as y1, floor(x2 / 10) as x2, floor(y2 / 10) as y2 from"
_CELLS = f"""b as ({_GRID} v_pred), c as (select video_id, frame, det_id, conf, unnest(range(cast(x1 as bigint), cast(x2 as bigint))) as x, y1, y2 from b),
  e as (select video_id, frame, det_id, conf, x, unnest(range(cast(y1 as bigint), cast(y2 as bigint))) as y from c),
  o as (select video_id, frame, arg_min(det_id, (-conf, det_id)) as owner from e group by video_id, frame, x, y), n as (select video_id, frame, owner, count(*) as owned from o group by 1, 2, 3),
  w as (select b.video_id, b.frame, b.det_id, cast((x2 - x1) * (y2 - y1) as bigint) as area, coalesce(owned, 0) as owned from b left join n on n.video_id = b.video_id and n.frame = b.frame and n.owner = b.det_id)"""


@add("mask_nms", ["v_pred"], _greedy_sql(f"({_GRID} v_pred) where conf > 0.2", """greatest(least(k.x2, n.b.x2) - greatest(k.x1, n.b.x1), 0) * greatest(least(k.y2, n.b.y2) - greatest(k.y1, n.b.y1), 0) / greatest(1, (k.x2 - k.x1) * (k.y2 - k.y1) + (n.b.x2 - n.b.x1) * (n.b.y2 - n.b.y1)
    - greatest(least(k.x2, n.b.x2) - greatest(k.x1, n.b.x1), 0) * greatest(least(k.y2, n.b.y2) - greatest(k.y1, n.b.y1), 0)) > 0.1"""))
def mask_nms(spark, d):
    return masks.mask_nms(_masks(spark, d, "v_pred"), ["video_id", "frame"], "det_id", "conf", "counts", 0.2, 0.1)


@add("pixel_owners", ["v_pred"], f"with {_CELLS} select video_id, frame, det_id, area, owned from w")
def pixel_owners(spark, d):
    return masks.pixel_owners(_masks(spark, d, "v_pred"), ["video_id", "frame"], "det_id", "conf", "counts")


@add("shrunk_masks", ["v_pred"], f"with {_CELLS} select video_id, frame, det_id from w where owned * 1.0 / greatest(area, 1) < 0.7")
def shrunk_masks(spark, d):
    return pixel_owners(spark, d).filter(masks.has_shrunk(F.col("area"), F.col("owned"), 0.7)).select("video_id", "frame", "det_id")


@add("occlusion_suppression", ["v_track_frames"], f"""with l as (select *, case when track_id % 4 = 0 then -1 else (track_id * 7 + frame) % 50 end as last from v_track_frames),
  p as (select a.video_id, a.frame, a.track_id as a, b.track_id as b, a.last as al, b.last as bl from l a join l b on a.video_id = b.video_id and a.frame = b.frame and a.track_id < b.track_id where {_iou('a.', 'b.')} >= 0.1)
  select distinct video_id, frame, case when al > bl then a else b end as ident from p where (al > bl and bl > -1) or (bl > al and al > -1)""")
def occlusion_suppression(spark, d):
    """Of two tracks that overlap, the one occluded last; when a track was occluded is made up from its id."""
    t = view(spark, d, "v_track_frames").withColumn("last", F.when(F.col("track_id") % 4 == 0, -1).otherwise((F.col("track_id") * 7 + F.col("frame")) % 50))
    a, b = (pairs.prefixed(t, p, ["video_id", "frame"], ["track_id", "last", *pairs.XYXY]) for p in ("a_", "b_"))
    met = a.join(b, ["video_id", "frame"]).filter("a_track_id < b_track_id").select("video_id", "frame", F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), "a_last", "b_last", bx.iou(bx.box("a_"), bx.box("b_")).alias("iou"))
    return masks.recently_occluded(met, ["video_id", "frame"], 0.1)


@add("frame_pts", ["v_scores", "v_track_frames"], "select t.video_id, t.track_id, t.frame, p.pts from v_track_frames t join (select frame, cast(min(sec) as double) as pts from v_scores group by frame) p on p.frame = t.frame")
def frame_pts(spark, d):
    times = view(spark, d, "v_scores").groupBy("frame").agg(F.min("sec").cast("double").alias("pts"))
    return shaping.frame_times(view(spark, d, "v_track_frames").select("video_id", "track_id", "frame"), times)


@add("last_track_activity", ["v_scores", "v_segments"], """with l as (select video_id, track_id % 20 as identity, max(track_id) as track_id from v_scores group by 1, 2), e as (select s.video_id, l.identity, sec, score from v_scores s join l on l.track_id = s.track_id)
  select seg_id, identity, sum(greatest(score, 0.0)) as asd from v_segments g join e on e.video_id = g.video_id and sec >= start_s and sec < end_s group by 1, 2""")
def last_track_activity(spark, d):
    """Activity of identities in segments where each identity's last track has replaced the others."""
    e = view(spark, d, "v_scores").withColumn("identity", F.col("track_id") % 20)
    e = shaping.last_track_only(e, ["video_id", "identity"], "track_id").select("video_id", "identity", F.col("sec").cast("double").alias("t"), "score")
    return speakers.weighted_activity(e, view(spark, d, "v_segments"), 1200.0, ["video_id"])


@add("plain_pool", [], """with l as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings), m as (select label, i, avg(cast(x as double)) as m from l group by 1, 2)
  select label, cast(i as int) as i, round(m / sqrt(sum(m * m) over (partition by label)), 9) as value from m""")
def plain_pool(spark, d):
    return shaping.plain_pool(table(spark, d, "embeddings"), ["label"], "embedding").withColumn("value", F.round("value", 9))


@add("avatars", ["v_boxes"], "select video_id, category_id, arg_max(det_id, (conf * (x2 - x1) * (y2 - y1), det_id)) as det_id from v_boxes group by 1, 2")
def avatars(spark, d):
    """The best-looking detection of each identity."""
    quality = F.struct(F.col("conf") * bx.area(bx.box()), "det_id")
    return view(spark, d, "v_boxes").groupBy("video_id", "category_id").agg(F.max_by("det_id", quality).alias("det_id"))


@add("merged_evaluation", ["v_scores"], """with a as (select event_id, track_id, pos, row_number() over (order by track_id, pos) - 1 as position from v_scores), b as (select score, row_number() over (order by track_id, pos) - 1 as position from v_scores where track_id % 2 = 0)
  select a.position, event_id, track_id, pos, score from a join b on a.position = b.position""")
def merged_evaluation(spark, d):
    """Predictions laid beside annotations row by row."""
    s = view(spark, d, "v_scores")
    scores = s.filter("track_id % 2 = 0").select(F.col("track_id").alias("t"), F.col("pos").alias("p"), "score")
    return shaping.by_position(s.select("event_id", "track_id", "pos"), ["track_id", "pos"], scores, ["t", "p"]).drop("t", "p")


@add("new_objects", ["v_gt", "v_pred"], """with h as (select video_id, frame, count(*) as n_held from v_gt group by 1, 2), r as (select *, row_number() over (partition by video_id, frame order by conf desc, det_id) as rank from v_pred)
  select r.video_id, r.frame, det_id, rank from r left join h on h.video_id = r.video_id and h.frame = r.frame where rank + coalesce(n_held, 0) <= 3""")
def new_objects(spark, d):
    """New detections of a frame until it has three objects."""
    held = view(spark, d, "v_gt").groupBy("video_id", "frame").agg(F.count("*").alias("n_held"))
    return shaping.within_budget(view(spark, d, "v_pred").select("video_id", "frame", "det_id", "conf"), held, ["video_id", "frame"], "conf", ["det_id"], 3).drop("conf")


@add("processing_orders", ["v_shots"], """with s as (select video_id, shot_id, cast(start_f as int) as s, cast(greatest(end_f, 0) as int) as n, cast(5 + shot_id as int) as most from v_shots where start_f >= 0 and shot_id >= 0),
  f as (select video_id, shot_id, 'forward' as way, unnest(range(s, least(s + most, n - 1) + 1)) as frame, generate_subscripts(range(s, least(s + most, n - 1) + 1), 1) - 1 as step from s),
  b as (select video_id, shot_id, 'backward' as way, unnest(range(s - 1, greatest(s - most, 0) - 1, -1)) as frame, generate_subscripts(range(s - 1, greatest(s - most, 0) - 1, -1), 1) - 1 as step from s)
  select video_id, shot_id, way, cast(frame as int) as frame, cast(step as int) as step from (select * from f union all select * from b)""")
def processing_orders(spark, d):
    """The frames around each shot's start in both directions."""
    s = view(spark, d, "v_shots").filter("start_f >= 0 and shot_id >= 0").select("video_id", "shot_id", F.col("start_f").cast("int").alias("s"), F.greatest("end_f", F.lit(0)).cast("int").alias("n"), (F.col("shot_id") + 5).cast("int").alias("most"))
    one = lambda way, back: s.select("video_id", "shot_id", F.lit(way).alias("way"), F.posexplode(shaping.processing_order(F.col("s"), F.col("most"), F.col("n"), back)).alias("step", "frame"))
    return one("forward", False).unionByName(one("backward", True))


@add("reconditioned_tracks", ["v_gt", "v_pred"], f"""with p as (select g.video_id, g.frame, g.det_id, arg_max({{'i': {_iou('g.', 'p.')}, 'c': p.conf}}, ({_iou('g.', 'p.')}, p.det_id)) as b from v_gt g join v_pred p on g.video_id = p.video_id and g.frame = p.frame where p.conf >= 0.3 group by 1, 2, 3)
  select video_id, frame, det_id from p where frame % 16 = 0 or (b.i < 0.5 and b.c >= 0.6)""")
def reconditioned_tracks(spark, d):
    """Objects whose best sure detection says that they are to be set anew."""
    met = pairs.pair_table(view(spark, d, "v_gt"), view(spark, d, "v_pred").filter("conf >= 0.3"), ["video_id", "frame"], ("det_id", "det_id"), ([], ["conf"]))
    best = met.groupBy("video_id", "frame", F.col("gt_det_id").alias("det_id")).agg(F.max_by(F.struct("iou", "dt_conf"), F.struct("iou", "dt_det_id")).alias("b"))
    return best.filter(shaping.needs_reconditioning(F.col("b.iou"), F.col("b.dt_conf"), F.col("frame"), 16, 0.5, 0.6)).select("video_id", "frame", "det_id")


@add("session_statistics", [], """with e as (select user_id, ts, event_id, event_type, lag(ts) over (partition by user_id order by ts, event_id) as p from events),
  r as (select *, sum(case when ts < p + interval 6 hour then 0 else 1 end) over (partition by user_id order by ts, event_id) as s from e)
  select user_id, min(ts) as start_ts, max(ts) as last_ts, count(*) as n_frames, count(distinct event_type) as n_objects from r group by user_id, s""")
def session_statistics(spark, d):
    """Frames and objects of each session."""
    w = F.session_window("ts", "6 hours").alias("w")
    g = table(spark, d, "events").groupBy("user_id", w).agg(F.max("ts").alias("last_ts"), F.count("*").alias("n_frames"), F.size(F.collect_set("event_type")).cast("long").alias("n_objects"))
    return g.select("user_id", F.col("w.start").alias("start_ts"), "last_ts", "n_frames", "n_objects")


@add("top_k_accuracy", ["v_gt", "v_pred"], """with c as (select video_id, frame, category_id, max(conf) as conf from v_pred group by 1, 2, 3), r as (select video_id, frame, list(category_id order by conf desc, category_id) as ranked from c group by 1, 2),
  t as (select video_id, frame, arg_max(category_id, (conf, det_id)) as truth from v_gt group by 1, 2), h as (select list_position(ranked, truth) as p from r join t on t.video_id = r.video_id and t.frame = r.frame)
  select avg(case when p <= 1 then 1.0 else 0.0 end) as top_1, avg(case when p <= 3 then 1.0 else 0.0 end) as top_3, avg(case when p <= 5 then 1.0 else 0.0 end) as top_5 from h""")
def top_k_accuracy(spark, d):
    """How often a frame's surest class is among the first classes predicted."""
    c = view(spark, d, "v_pred").groupBy("video_id", "frame", "category_id").agg(F.max("conf").alias("conf"))
    r = c.groupBy("video_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), "category_id"))), lambda x: x["category_id"]).alias("ranked"))
    t = view(spark, d, "v_gt").groupBy("video_id", "frame").agg(F.max_by("category_id", F.struct("conf", "det_id")).alias("truth"))
    hits = r.join(t, ["video_id", "frame"]).select(*shaping.top_k_hits(F.col("ranked"), F.col("truth"), [1, 3, 5]))
    return hits.agg(*[F.avg(c).alias(c) for c in hits.columns])


@add("relative_boxes", ["v_boxes"], """with b as (select det_id, case when category_id % 2 = 0 then x1 / 1000 else x1 end as x, case when category_id % 2 = 0 then y1 / 1000 else y1 end as y, case when category_id % 2 = 0 then (x2 - x1) / 1000 else x2 - x1 end as w, case when category_id % 2 = 0 then (y2 - y1) / 1000 else y2 - y1 end as h from v_boxes)
  select det_id, case when greatest(x, y, w, h) > 1 then x / 2000 else x end as x, case when greatest(x, y, w, h) > 1 then h / 1000 else h end as h from b""")
def relative_boxes(spark, d):
    """Boxes as shares of the frame, of which some were that before."""
    b = view(spark, d, "v_boxes").select("det_id", F.transform(F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), lambda v: F.when(F.col("category_id") % 2 == 0, v / 1000).otherwise(v)).alias("b"))
    out = b.select("det_id", shaping.relative_box(F.col("b"), F.lit(2000.0), F.lit(1000.0)).alias("b"))
    return out.select("det_id", F.col("b")[0].alias("x"), F.col("b")[3].alias("h"))


@add("frame_lookup", ["v_track_frames"], """with a as (select video_id, track_id, list(frame order by frame) as frames from v_track_frames group by 1, 2) select video_id, track_id, frames[4] as fourth from a where len(frames) >= 4""")
def frame_lookup(spark, d):
    """The fourth annotated frame of each track."""
    a = view(spark, d, "v_track_frames").groupBy("video_id", "track_id").agg(F.sort_array(F.collect_list("frame")).alias("frames"))
    return a.select("video_id", "track_id", shaping.at_frame(F.col("frames"), F.lit(3)).alias("fourth")).filter("fourth is not null")


@add("score_maps", ["v_scores"], """select ms, string_agg(concat(cast(identity as varchar), '=', cast(cast(round(score * 1000) as bigint) as varchar)), ' ' order by identity) as scores from
  (select sec as ms, track_id % 20 as identity, max(score) as score from v_scores group by 1, 2) group by ms""")
def score_maps(spark, d):
    """For each moment a map from identity to its highest score, shown in order."""
    m = view(spark, d, "v_scores").groupBy(F.col("sec").alias("ms"), (F.col("track_id") % 20).alias("identity")).agg(F.max("score").alias("score"))
    g = m.groupBy("ms").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("identity", "score")))).alias("m"))
    shown = lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.round(e["value"] * 1000).cast("long").cast("string"))
    return g.select("ms", F.array_join(F.transform(F.map_entries("m"), shown), " ").alias("scores"))


@add("keypoint_rows", ["v_boxes"], "select det_id, concat_ws(' ', cast(cast(x1 as bigint) as varchar), cast(cast(y1 as bigint) as varchar), '2', cast(cast(x1 as bigint) as varchar), cast(cast(y1 as bigint) as varchar), '1') as keypoints from v_boxes")
def keypoint_rows(spark, d):
    point = lambda v: F.struct(F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y"), F.lit(v).alias("v"))
    flat = shaping.flat_keypoints(F.array(point(2), point(1)))
    return view(spark, d, "v_boxes").select("det_id", F.array_join(F.transform(flat, lambda x: x.cast("long").cast("string")), " ").alias("keypoints"))


@add("moved_boxes", ["v_boxes"], """with f as (select det_id, 800 - x2 as x1, y1, 800 - x1 as x2, y2 from v_boxes), p as (select det_id, x1 + 30 as x1, y1 + 20 as y1, x2 + 30 as x2, y2 + 20 as y2 from f),
  c as (select det_id, least(greatest(x1 - 100, 0), 500) as x1, least(greatest(y1 - 50, 0), 300) as y1, least(greatest(x2 - 100, 0), 500) as x2, least(greatest(y2 - 50, 0), 300) as y2 from p)
  select * from c where x2 - x1 > 0 and y2 - y1 > 0""")
def moved_boxes(spark, d):
    """Boxes mirrored, padded and cut; emptied ones go."""
    b = view(spark, d, "v_boxes")
    moved = shaping.crop(shaping.pad(shaping.flip(bx.box(), 800.0), 30.0, 20.0), 100.0, 50.0, 500.0, 300.0)
    return b.select("det_id", *bx.named(moved)).filter(bx.non_empty(bx.box()))


@add("noisy_boxes", ["v_boxes"], """with u as (select det_id, x1, y1, x2, y2, ((track_id * 7919 + frame * 104729 + category_id * 31) % 1000 + 1000) % 1000 / cast(1000 as double) as u from v_boxes)
  select det_id, least(greatest(x1 + (2 * u - 1) * 0.1 * (x2 - x1), 0), 2000) as x1, least(greatest(y2 + (2 * u - 1) * 0.1 * (y2 - y1), 0), 1000) as y2 from u""")
def noisy_boxes(spark, d):
    """Corners moved by a tenth of a box's sides, by a draw from its ids."""
    u = F.pmod(F.col("track_id") * 7919 + F.col("frame") * 104729 + F.col("category_id") * 31, F.lit(1000)) / 1000.0
    moved = shaping.jitter(bx.box(), (u, u, u, u), 0.1, 2000.0, 1000.0)
    return view(spark, d, "v_boxes").select("det_id", moved[0].alias("x1"), moved[3].alias("y2"))


@add("training_targets", ["v_gt", "v_pred"], "select p.video_id, p.frame, p.det_id as query_id, g.det_id as target_id from v_pred p join v_gt g on g.video_id = p.video_id and g.frame = p.frame and g.track_id = p.track_id")
def training_targets(spark, d):
    """Tracker queries with the truth of their own object."""
    k = ["video_id", "frame", "track_id"]
    p, g = view(spark, d, "v_pred").select(*k, F.col("det_id").alias("query_id")), view(spark, d, "v_gt").select(*k, F.col("det_id").alias("target_id"))
    return p.join(g, k).drop("track_id")


@add("hota_super_class", ["v_gt", "v_pred"], f"{_HOTA}, al as (select video_id % 3 as super, level, sum(tp) as tp, sum(fn) as fn, sum(fp) as fp, sum(loc) as loc, sum(ass) as ass from per group by 1, 2) select super, level, {_HOTA_FIELDS} from al")
def hota_super_class(spark, d):
    """Classes of one super-class as one, each weighed by its detections."""
    per = metrics.hota(*_sides(spark, d), ["video_id"]).withColumn("super", F.col("video_id") % 3)
    return metrics.combine(per, ["super"]).select("super", "level", "tp", "fn", "fp", "det_a", "ass_a", "loc_a", "hota")


@add("merged_windows", ["v_segments"], """with recursive a as (select seg_id // 100 as lane, start_s, end_s, speaker from v_segments union all select seg_id // 100, start_s + 0.05, end_s - 0.05, speaker from v_segments where seg_id % 3 <> 0),
  c as (select *, row_number() over (partition by lane order by start_s, end_s, speaker) as i from a),
  r as (select lane, i, start_s as s, end_s as e, speaker as w, true as kept from c where i = 1 union all
    select c.lane, c.i, case when same then r.s else c.start_s end, case when same then r.e else c.end_s end, case when same then r.w else c.speaker end, not same
    from r join c on c.lane = r.lane and c.i = r.i + 1 cross join lateral (select abs(c.start_s - r.s) <= 0.1 and abs(c.end_s - r.e) <= 0.1 and c.speaker = r.w as same))
  select lane, s as start_s, e as end_s, w as speaker from r where kept""")
def merged_windows(spark, d):
    """What two passes over the same speech found, without what the second found again."""
    s = view(spark, d, "v_segments").withColumn("lane", F.floor(F.col("seg_id") / 100)).select("lane", "seg_id", "start_s", "end_s", "speaker")
    again = s.filter("seg_id % 3 <> 0").withColumns({"start_s": F.col("start_s") + 0.05, "end_s": F.col("end_s") - 0.05})
    return linking.merged_windows(s.union(again), ["lane"], "start_s", "end_s", "speaker")


@add("registered_identities", [], """with recursive n as (select vec_id // 100 as part, vec_id, vec_id * 7 % 100 as s, vec_id * 7 % 100 + vec_id % 9 as e, embedding, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as norm from embeddings),
  c as (select *, list_transform(embedding, lambda x: cast(x as double) / norm) as v, row_number() over (partition by part order by s, vec_id) as i from n),
  r as (select part, cast(0 as bigint) as i, cast([] as struct(s bigint, e bigint, v double[])[]) as known, cast(null as bigint) as vec_id, cast(null as bigint) as identity from (select distinct part from c) union all
    select r.part, c.i, case when spot is null then list_append(known, {'s': c.s, 'e': c.e, 'v': c.v}) else list_concat(list_append(known[1:spot - 1], {'s': c.s, 'e': c.e, 'v': known[spot].v}), known[spot + 1:]) end, c.vec_id, coalesce(spot - 1, len(known))
    from r join c on c.part = r.part and c.i = r.i + 1 cross join lateral (select nullif(list_position(list_transform(known, lambda k: (c.e <= k.s or c.s >= k.e) and list_dot_product(k.v, c.v) >= 0.15), true), 0) as spot))
  select part, vec_id, cast(identity as int) as identity from r where i > 0""")
def registered_identities(spark, d):
    """Tracks taken in order of start by the first identity that is alike and free; their times are made up from their ids."""
    e = table(spark, d, "embeddings").withColumns({"part": F.floor(F.col("vec_id") / 100), "s": F.col("vec_id") * 7 % 100, "e": F.col("vec_id") * 7 % 100 + F.col("vec_id") % 9})
    return linking.registered(e, ["part"], "vec_id", "s", "e", "embedding", 0.15)


@add("minibatches", ["v_segments"], """with recursive c as (select video_id, seg_id, cast(floor(end_s - start_s) as bigint) as n, row_number() over (partition by video_id order by cast(floor(end_s - start_s) as bigint) desc, seg_id desc) as i from v_segments),
  r as (select video_id, cast(1 as bigint) as i, 0 as batch from (select distinct video_id from c) union all
    select r.video_id, r.i + greatest(4000 // greatest(c.n, 1), 1), r.batch + 1 from r join c on c.video_id = r.video_id and c.i = r.i)
  select c.video_id, c.seg_id, max(r.batch) as batch from c join r on r.video_id = c.video_id and r.i <= c.i group by 1, 2""")
def minibatches(spark, d):
    """Segments from long to short in batches that their longest leaves room for."""
    s = view(spark, d, "v_segments").withColumn("n", F.floor(F.col("end_s") - F.col("start_s")))
    return linking.batched(s, ["video_id"], "n", "seg_id", 4000)


@add("unfinished_chunks", ["v_shots"], "select video_id, shot_id from v_shots where not (shot_id % 3 = 0 or (shot_id % 2 = 0 and shot_id % 5 = 0))")
def unfinished_chunks(spark, d):
    """Shots without a finished output; failed outputs don't count."""
    s = view(spark, d, "v_shots").select("video_id", "shot_id")
    done = s.filter("shot_id % 3 = 0 or shot_id % 2 = 0").withColumn("error", F.when((F.col("shot_id") % 3 != 0) & (F.col("shot_id") % 5 != 0), "failed"))
    return linking.resume(s, done, ["video_id", "shot_id"])


_REQUESTS = """q as (select user_id, event_id, case event_id % 11 when 0 then 'start' when 5 then 'reset' when 9 then 'close' when 3 then 'remove' when 7 then 'remove' else 'add' end as type, event_id % 6 as obj_id from events)"""


@add("session_states", [], f"""with {_REQUESTS}, s as (select user_id, max(event_id) filter (type in ('start', 'reset')) as fresh, max(event_id) filter (type = 'close') as closed from q group by 1),
  l as (select q.user_id, obj_id, arg_max(type, event_id) as last from q join s on s.user_id = q.user_id where event_id > fresh and type in ('add', 'remove') group by 1, 2),
  o as (select user_id, string_agg(cast(obj_id as varchar), ' ' order by obj_id) as objects from l where last = 'add' group by 1)
  select s.user_id, fresh is not null and (closed is null or closed < fresh) as is_open, case when fresh is not null and (closed is null or closed < fresh) then coalesce(objects, '') else '' end as objects from s left join o on o.user_id = s.user_id""")
def session_states(spark, d):
    """What a user's requests, made up from the events, leave open."""
    kind = F.expr("case event_id % 11 when 0 then 'start' when 5 then 'reset' when 9 then 'close' when 3 then 'remove' when 7 then 'remove' else 'add' end")
    q = table(spark, d, "events").select("user_id", "event_id", kind.alias("type"), (F.col("event_id") % 6).alias("obj_id"))
    s = sessions.session_states(q, "user_id", "event_id")
    return s.select("user_id", "is_open", F.array_join(F.col("objects").cast("array<string>"), " ").alias("objects"))


@add("next_propagations", [], """with a as (select user_id, event_id, list_extract(['add', 'remove', 'refine', 'propagation_full', 'propagation_partial', 'propagation_fetch'], cast(event_id % 6 as bigint) + 1) as type, event_id % 10 as frame, event_id % 7 as obj from events),
  s as (select user_id, arg_max({'t': type, 'f': frame, 'o': obj}, event_id) as l, max(event_id) as le, max(event_id) filter (type like 'propagation%') as run from a group by 1),
  b as (select a.user_id, arg_max(type, event_id) as t from a join s on s.user_id = a.user_id where event_id < le group by 1),
  n as (select user_id, string_agg(cast(obj as varchar), ' ' order by obj) as objects from (select distinct a.user_id, obj from a join s on s.user_id = a.user_id where (run is null or event_id > run) and type in ('add', 'refine')) group by 1),
  x as (select s.user_id, l.t as t, l.o as o, coalesce(b.t in ('propagation_partial', 'propagation_full'), false) or l.f in (0, 9) as done, n.objects from s left join b on b.user_id = s.user_id left join n on n.user_id = s.user_id)
  select user_id, case when t = 'propagation_fetch' then t when t like 'propagation%' then case when done then 'propagation_fetch' else t end when objects is not null then 'propagation_partial' else 'propagation_fetch' end as kind,
    case when t = 'propagation_fetch' then null when t like 'propagation%' then case when done then null else cast(o as varchar) end else objects end as objects from x""")
def next_propagations(spark, d):
    """What the next propagation of each user's actions, made up from the events, does."""
    kind = F.element_at(F.array(*[F.lit(a) for a in sessions.ACTIONS]), (F.col("event_id") % 6 + 1).cast("int"))
    a = table(spark, d, "events").select("user_id", "event_id", kind.alias("type"), (F.col("event_id") % 10).alias("frame"), F.array((F.col("event_id") % 7).cast("long")).alias("objects"), F.lit(10).alias("n_frames"))
    s = sessions.next_propagation(a, "user_id", "event_id", "n_frames")
    return s.select("user_id", "kind", F.array_join(F.col("objects").cast("array<string>"), " ").alias("objects"))
