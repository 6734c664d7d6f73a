"""Queries over time: activity, segments, words, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from sightline.functions import text as tx
from sightline.operators import intervals, sequences, speakers
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


_ACTIVE = """r as (select track_id, pos, sum(fresh) over (partition by track_id order by pos) as run from
    (select track_id, pos, case when pos = lag(pos) over (partition by track_id order by pos) + 1 then 0 else 1 end as fresh from v_scores where score > 0)),
  f as (select track_id, min(frame) as first_f, min(video_id) as video_id from v_scores group by track_id),
  act as (select min(f.video_id) as video_id, r.track_id, (min(pos) + min(first_f)) * 3600.0 as a_s, (max(pos) + min(first_f) + 1) * 3600.0 as a_e from r join f on r.track_id = f.track_id group by r.track_id, run)"""


def _active(spark, d):
    s = view(spark, d, "v_scores")
    first = s.groupBy("track_id").agg(F.min("frame").alias("first_f"))
    return intervals.active_intervals(s.join(first, "track_id"), ["video_id", "track_id"], "pos", "score", F.col("first_f"), 1 / 3600.0)


@add("active_intervals", ["v_scores"], f"with {_ACTIVE} select video_id, track_id, a_s as start_s, a_e as end_s from act")
def active_intervals(spark, d):
    return _active(spark, d)


@add("flagship", ["v_scores", "v_segments"], f"""with {_ACTIVE},
  o as (select seg_id, track_id, sum(least(a_e, end_s) - greatest(a_s, start_s)) as ov from act join v_segments v on v.video_id = act.video_id and a_s < end_s and a_e > start_s group by seg_id, track_id),
  b as (select seg_id, arg_max(track_id, (round(ov, 6), -track_id)) as track_id, max(round(ov, 6)) as overlap_s from o group by seg_id)
  select s.video_id, s.seg_id, s.speaker, s.start_s, s.end_s, b.track_id, b.overlap_s,
    case when overlap_s >= 0.3 * (end_s - start_s) then concat('Person_', cast(b.track_id as string)) else speaker end as label
  from v_segments s left join b on s.seg_id = b.seg_id""")
def flagship(spark, d):
    return speakers.label_segments(view(spark, d, "v_segments"), _active(spark, d), 7200.0, 0.3, ["video_id"])


@add("segment_activity_sum", ["v_scores", "v_segments"], """select seg_id, track_id as identity, sum(greatest(score, 0.0)) as asd
  from v_segments g join v_scores c on c.video_id = g.video_id and sec >= start_s and sec < end_s group by seg_id, track_id""")
def segment_activity_sum(spark, d):
    e = view(spark, d, "v_scores").select("video_id", F.col("track_id").alias("identity"), F.col("sec").cast("double").alias("t"), "score")
    return speakers.weighted_activity(e, view(spark, d, "v_segments"), 1200.0, ["video_id"])


@add("segment_frames_closed", ["v_scores", "v_segments"], """select seg_id, track_id, count(*) as n_frames from v_segments g join v_scores c on c.video_id = g.video_id and sec >= start_s and sec <= end_s where start_s < end_s group by seg_id, track_id""")
def segment_frames_closed(spark, d):
    e = view(spark, d, "v_scores").select("video_id", "track_id", F.col("sec").cast("double").alias("t"))
    met = intervals.point_join(e, view(spark, d, "v_segments").filter("start_s < end_s"), ["video_id"], "t", ("start_s", "end_s"), 1200.0, closed=True)
    return met.groupBy("seg_id", "track_id").agg(F.count("*").alias("n_frames"))


@add("segment_positive_count", ["v_scores", "v_segments"], """select seg_id, count(sec) as n_positive from v_segments g left join (select video_id, sec from v_scores where score > 0) c on c.video_id = g.video_id and sec >= start_s and sec < end_s group by seg_id""")
def segment_positive_count(spark, d):
    seg = view(spark, d, "v_segments")
    e = view(spark, d, "v_scores").filter("score > 0").select("video_id", F.col("sec").cast("double").alias("t"))
    met = intervals.point_join(e, seg, ["video_id"], "t", ("start_s", "end_s"), 1200.0).groupBy("seg_id").agg(F.count("*").alias("n"))
    return seg.select("seg_id").join(met, "seg_id", "left").select("seg_id", F.coalesce("n", F.lit(0)).alias("n_positive"))


@add("millisecond_lookup", ["v_scores", "v_segments"], """select seg_id, track_id, score from (select seg_id, cast(round_even(start_s * 1000, 0) as bigint) as ms from v_segments) s
  join (select track_id, score, cast(round_even(sec * 1000.0, 0) as bigint) as ms from v_scores) e on s.ms = e.ms""")
def millisecond_lookup(spark, d):
    key = lambda c: F.rint(F.col(c).cast("double") * 1000).cast("long").alias("ms")
    s = view(spark, d, "v_segments").select("seg_id", key("start_s"))
    return s.join(view(spark, d, "v_scores").select("track_id", "score", key("sec")), "ms").select("seg_id", "track_id", "score")


@add("segment_words", ["v_words"], """with c as (select doc_id, pos, word, start_s, end_s, floor(start_s / 10.0) as w from v_words),
  s as (select distinct doc_id, cast(floor(start_s / 10.0) as bigint) as win from v_words),
  j as (select s.doc_id, s.win, v.pos, v.word from s join v_words v on s.doc_id = v.doc_id and v.end_s > s.win * 10.0 and v.start_s < s.win * 10.0 + 10.0)
  select doc_id, win, count(*) as n_words, md5(string_agg(word, ' ' order by pos)) as text_md5 from j group by doc_id, win""")
def segment_words(spark, d):
    """Tokens overlapping each ten-second window of a document, joined in time order."""
    w = view(spark, d, "v_words")
    first, last = F.floor(F.col("start_s") / 10.0), F.ceil(F.col("end_s") / 10.0) - 1
    seen = w.select("doc_id", F.floor(F.col("start_s") / 10.0).alias("win")).distinct()
    spread = w.withColumn("win", F.explode(F.sequence(first, F.greatest(first, last))))
    met = spread.filter((F.col("end_s") > F.col("win") * 10.0) & (F.col("start_s") < F.col("win") * 10.0 + 10.0)).join(seen, ["doc_id", "win"], "left_semi")
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    return met.groupBy("doc_id", "win").agg(F.count("*").alias("n_words"), F.md5(F.array_join(tokens, " ")).alias("text_md5"))


@add("word_speakers", ["v_words"], """with t as (select doc_id, pos // 25 as turn, min(start_s) as t_s, max(end_s) - 0.35 as t_e, concat('SPK_', cast((doc_id + pos // 25) % 3 as string)) as speaker
    from v_words group by doc_id, pos // 25),
  j as (select w.doc_id, w.pos, w.word, t.speaker, t.turn, least(end_s, t_e) - greatest(start_s, t_s) as ov from v_words w join t on w.doc_id = t.doc_id and start_s < t_e and end_s > t_s)
  select doc_id, pos, word, arg_max(speaker, (round(ov, 6), -turn)) as speaker from j group by doc_id, pos, word""")
def word_speakers(spark, d):
    """Each word with the diarized turn that it overlaps longest; words outside every turn have none."""
    w = view(spark, d, "v_words")
    turn = F.floor(F.col("pos") / 25)
    turns = w.groupBy("doc_id", turn.alias("turn")).agg(F.min("start_s").alias("t_s"), (F.max("end_s") - 0.35).alias("t_e")).withColumn("speaker", F.concat(F.lit("SPK_"), ((F.col("doc_id") + F.col("turn")) % 3).cast("string")))
    met = intervals.interval_join(w, turns, ["doc_id"], ("start_s", "end_s"), ("t_s", "t_e"), 10.0)
    ov = F.round(intervals.overlap(("start_s", "end_s"), ("t_s", "t_e")), 6)
    return met.groupBy("doc_id", "pos", "word").agg(F.max_by("speaker", F.struct(ov, -F.col("turn"))).alias("speaker"))


@add("merge_segments", ["v_segments"], """with a as (select *, lag(speaker) over (partition by seg_id // 100 order by start_s, end_s, seg_id) as p from (select seg_id, seg_id // 100 as lane, speaker, start_s, end_s from v_segments)),
  b as (select *, sum(case when speaker = p then 0 else 1 end) over (partition by lane order by start_s, end_s, seg_id) as lr from a),
  c as (select *, max(end_s) over (partition by lane, lr order by start_s, end_s, seg_id rows between unbounded preceding and 1 preceding) as reach from b),
  e as (select *, sum(case when start_s - reach <= 0.2 then 0 else 1 end) over (partition by lane, lr order by start_s, end_s, seg_id) as mr from c)
  select lane, min(speaker) as speaker, min(start_s) as start_s, max(end_s) as end_s, count(*) as n_merged from e group by lane, lr, mr""")
def merge_segments(spark, d):
    s = view(spark, d, "v_segments").withColumn("lane", F.floor(F.col("seg_id") / 100))
    return intervals.merge_adjacent(s, ["lane"], "speaker", ("start_s", "end_s"), 0.2, ["seg_id"])


@add("collapse_lines", ["v_segments"], """select lane, seg_id, start_s, e as end_s from (select seg_id // 100 as lane, seg_id, start_s,
  least(end_s, coalesce(lead(start_s) over (partition by seg_id // 100 order by start_s, end_s, seg_id), end_s)) as e from v_segments) where e - start_s > 1e-3""")
def collapse_lines(spark, d):
    s = view(spark, d, "v_segments").select(F.floor(F.col("seg_id") / 100).alias("lane"), "seg_id", "start_s", "end_s")
    return intervals.collapse(s, ["lane"], ("start_s", "end_s"), ["seg_id"])


@add("message_index", ["v_segments"], """select seg_id, speaker, row_number() over (partition by video_id, speaker order by start_s, end_s, seg_id) - 1 as msg_idx from v_segments""")
def message_index(spark, d):
    w = Window.partitionBy("video_id", "speaker").orderBy("start_s", "end_s", "seg_id")
    return view(spark, d, "v_segments").select("seg_id", "speaker", (F.row_number().over(w) - 1).alias("msg_idx"))


@add("cut_at_boundaries", ["v_scores", "v_segments"], f"""with {_ACTIVE},
  p as (select seg_id, start_s as t from v_segments union select seg_id, end_s from v_segments union
        select seg_id, x from v_segments g join (select video_id, a_s as x from act union select video_id, a_e from act) c on c.video_id = g.video_id and x > start_s and x < end_s),
  q as (select seg_id, t as start_s, lead(t) over (partition by seg_id order by t) as end_s from p)
  select seg_id, start_s, end_s from q where end_s is not null""")
def cut_at_boundaries(spark, d):
    seg = view(spark, d, "v_segments").select("video_id", "seg_id", "start_s", "end_s")
    points = _active(spark, d).select("video_id", F.explode(F.array("start_s", "end_s")).alias("t")).distinct()
    inside = intervals.point_join(points, seg, ["video_id"], "t", ("start_s", "end_s"), 1200.0).groupBy("seg_id").agg(F.collect_set("t").alias("cuts"))
    return intervals.cut_at(seg.join(inside, "seg_id", "left"), ["seg_id"], ("start_s", "end_s"), "cuts").select("seg_id", "start_s", "end_s")


@add("winner_runs", ["v_scores"], """with m as (select frame, arg_max(track_id, (score, -track_id)) as win from v_scores group by frame),
  g as (select frame, frame // 24 as day, win from m),
  r as (select *, sum(case when win = pw then 0 else 1 end) over (partition by day order by frame) as run from (select *, lag(win) over (partition by day order by frame) as pw from g))
  select day, min(win) as win, min(frame) as first, max(frame) as last, count(*) as n from r group by day, run""")
def winner_runs(spark, d):
    s = view(spark, d, "v_scores").groupBy("frame").agg(F.max_by("track_id", F.struct("score", -F.col("track_id"))).alias("win"))
    return sequences.run_length(s.withColumn("day", F.floor(F.col("frame") / 24)), ["day"], "frame", "win")


@add("gap_split", ["v_track_frames"], """with a as (select *, case when frame - lag(frame) over (partition by video_id, track_id order by frame) <= 10 then 0 else 1 end as f from v_track_frames),
  b as (select *, sum(f) over (partition by video_id, track_id order by frame) as segment from a), c as (select *, count(*) over (partition by video_id, track_id, segment) as n from b)
  select video_id, track_id, frame, segment from c where n >= 2""")
def gap_split(spark, d):
    return sequences.gap_split(view(spark, d, "v_track_frames").select("video_id", "track_id", "frame"), ["video_id", "track_id"], "frame", 10)


@add("interpolate_tracks", ["v_track_frames"], """with a as (select video_id, track_id, frame, x1, y1, lead(frame) over w as nf, lead(x1) over w as nx, lead(y1) over w as ny from v_track_frames window w as (partition by video_id, track_id order by frame)),
  g as (select *, unnest(generate_series(frame, greatest(frame, coalesce(nf - 1, frame)))) as f from a)
  select video_id, track_id, f as frame, case when f = frame then x1 else x1 + (nx - x1) * ((f - frame) / cast(nf - frame as double)) end as x1,
         case when f = frame then y1 else y1 + (ny - y1) * ((f - frame) / cast(nf - frame as double)) end as y1 from g""")
def interpolate_tracks(spark, d):
    t = view(spark, d, "v_track_frames")
    return sequences.interpolate(t, ["video_id", "track_id"], "frame", ["x1", "y1"])


@add("median_filter", ["v_scores"], """with z as (select track_id, pos, list(score) over (partition by track_id order by pos rows between 6 preceding and 6 following) as near from v_scores)
  select track_id, pos, list_sort(list_concat(near, list_transform(range(13 - len(near)), lambda x: cast(0 as double))))[7] as smooth from z""")
def median_filter(spark, d):
    return sequences.median_filter(view(spark, d, "v_scores").select("track_id", "pos", "score"), ["track_id"], "pos", "score", 13, "smooth").select("track_id", "pos", "smooth")


@add("fill_times", ["v_scores"], """with t as (select track_id, pos, case when event_id % 4 <> 0 then cast(sec as double) end as t from v_scores),
  a as (select *, last_value(t ignore nulls) over (partition by track_id order by pos rows between unbounded preceding and 1 preceding) as prior from t),
  m as (select track_id, coalesce(median(t - prior), 0.0) as dt from a where t - prior > 0 group by track_id),
  b as (select a.*, coalesce(dt, 0.0) as dt, last_value(t ignore nulls) over up as tb, last_value(case when t is not null then pos end ignore nulls) over up as pb,
      first_value(t ignore nulls) over dn as tf, first_value(case when t is not null then pos end ignore nulls) over dn as pf from a left join m on a.track_id = m.track_id
      window up as (partition by a.track_id order by pos rows between unbounded preceding and current row), dn as (partition by a.track_id order by pos rows between current row and unbounded following))
  select track_id, pos, max(coalesce(tb + (pos - pb) * dt, greatest(0.0, tf - (pf - pos) * dt))) over (partition by track_id order by pos rows between unbounded preceding and current row) as filled from b""")
def fill_times(spark, d):
    t = view(spark, d, "v_scores").select("track_id", "pos", F.when(F.col("event_id") % 4 != 0, F.col("sec").cast("double")).alias("t"))
    return sequences.fill_times(t, ["track_id"], "pos", "t").select("track_id", "pos", "filled")


_WEIGHTS = {1: 3, 2: 3, 3: 2, 4: 1, 5: 1, 6: 1}


@add("duration_ensemble", ["v_scores"], """with d as (select track_id, pos, dur, score * (1 + dur / 10.0) as score from v_scores, (select unnest([1, 2, 3, 4, 5, 6]) as dur) where pos % dur <> 1 or dur = 1),
  e as (select track_id, min(n) as n from (select track_id, dur, max(pos) + 1 as n from d group by track_id, dur) group by track_id)
  select d.track_id, d.pos, round_even(round(sum(case when dur <= 2 then 3 when dur = 3 then 2 else 1 end * score) / sum(case when dur <= 2 then 3 when dur = 3 then 2 else 1 end), 9) * 10, 0) / 10 as score
  from d join e on d.track_id = e.track_id where d.pos < e.n group by d.track_id, d.pos""")
def duration_ensemble(spark, d):
    s = view(spark, d, "v_scores").select("track_id", "pos", "score", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("dur")).filter("pos % dur <> 1 or dur = 1")
    return sequences.ensemble(s.withColumn("score", F.col("score") * (1 + F.col("dur") / 10.0)), ["track_id"], "pos", "dur", "score", _WEIGHTS)


@add("resample_tracks", ["v_scores"], """with n as (select track_id, max(pos) as last from v_scores group by track_id), g as (select track_id, last, k, k * last / 15.0 as x, least(floor(k * last / 15.0), greatest(last - 1, 0)) as p from n, (select unnest(range(16)) as k)),
  a as (select track_id, pos, score, lead(score) over (partition by track_id order by pos) as nx from v_scores)
  select g.track_id, cast(k as int) as k, score + coalesce((nx - score) * (x - p), 0) as score from g join a on a.track_id = g.track_id and a.pos = g.p""")
def resample_tracks(spark, d):
    return sequences.resample(view(spark, d, "v_scores").select("track_id", "pos", "score"), ["track_id"], "pos", ["score"], 16)


@add("match_streak", ["v_scores"], """with b as (select track_id, pos, score > 0 as hit, sum(case when score > 0 then 0 else 1 end) over (partition by track_id order by pos) as m from v_scores)
  select track_id, pos, sum(case when hit then 1 else 0 end) over (partition by track_id, m order by pos) as streak from b""")
def match_streak(spark, d):
    return sequences.streak(view(spark, d, "v_scores").withColumn("hit", F.col("score") > 0), ["track_id"], "pos", "hit").select("track_id", "pos", "streak")


@add("asd_gate", ["v_scores"], """with a as (select track_id, pos, score > 0.2 as hit, sum(case when score > 0.2 then 0 else 1 end) over (partition by track_id order by pos) as m from v_scores),
  r as (select track_id, m, count(*) filter (hit) as n from a group by track_id, m)
  select track_id, max(n) as longest, (select avg(case when hit then 1.0 else 0.0 end) from a x where x.track_id = r.track_id) as ratio from r group by track_id having max(n) >= 4
    and (select avg(case when hit then 1.0 else 0.0 end) from a x where x.track_id = r.track_id) >= 0.10""")
def asd_gate(spark, d):
    s = view(spark, d, "v_scores").withColumn("hit", F.col("score") > 0.2)
    st = sequences.streak(s, ["track_id"], "pos", "hit")
    return st.groupBy("track_id").agg(F.max("streak").alias("longest"), F.avg(F.col("hit").cast("double")).alias("ratio")).filter("longest >= 4 and ratio >= 0.10")


@add("tumbling_windows", ["v_scores"], "select track_id, cast(floor(pos / 25.0) as bigint) as win, count(*) as n, avg(score) as mean from v_scores group by track_id, cast(floor(pos / 25.0) as bigint)")
def tumbling_windows(spark, d):
    return view(spark, d, "v_scores").groupBy("track_id", F.floor(F.col("pos") / 25).alias("win")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


@add("overlapping_windows", ["v_scores"], """with n as (select track_id, max(pos) + 1 as n from v_scores group by track_id),
  w as (select track_id, unnest(range(cast(greatest(ceil((n - 30) / 20.0), 0) as int) + 1)) * 20.0 as start_p from n)
  select w.track_id, start_p, count(*) as n, max(score) as top from w join v_scores s on s.track_id = w.track_id and pos >= start_p and pos < start_p + 30 group by w.track_id, start_p""")
def overlapping_windows(spark, d):
    s = view(spark, d, "v_scores")
    w = s.groupBy("track_id").agg((F.max("pos") + 1).alias("n")).select("track_id", F.explode(intervals.windows(F.col("n"), 30, 10)).alias("start_p")).withColumn("end_p", F.col("start_p") + 30)
    return intervals.point_join(s, w, ["track_id"], "pos", ("start_p", "end_p"), 30.0).groupBy("track_id", "start_p").agg(F.count("*").alias("n"), F.max("score").alias("top"))


@add("majority_identity", ["v_segments", "v_scores"], """with c as (select speaker, case when seg_id % 3 = 0 then null else seg_id % 11 end as identity, count(*) as n, min(seg_id) as f from v_segments group by 1, 2)
  select speaker, identity, n from (select *, row_number() over (partition by speaker order by n desc, f) as r from c) where r = 1""")
def majority_identity(spark, d):
    s = view(spark, d, "v_segments").withColumn("identity", F.when(F.col("seg_id") % 3 != 0, F.col("seg_id") % 11))
    return speakers.majority(s, ["speaker"], "identity", "seg_id")


@add("speaker_prior", ["v_scores", "v_segments"], """with e as (select seg_id, track_id % 20 as identity, speaker, greatest(score, 0.0) as s from v_segments g join v_scores c on c.video_id = g.video_id and sec >= start_s and sec < end_s),
  p as (select speaker, identity, sum(s) as asd, count(*) * 1.0 as vis from e group by speaker, identity),
  q as (select speaker, identity, 0.7 * asd / max(asd) over (partition by speaker) + 0.3 * vis / max(vis) over (partition by speaker) as prior from p)
  select speaker, identity, prior from (select *, row_number() over (partition by speaker order by prior desc, identity) as r from q) where r = 1 and prior > 0""")
def speaker_prior(spark, d):
    seg = view(spark, d, "v_segments")
    e = view(spark, d, "v_scores").select("video_id", (F.col("track_id") % 20).alias("identity"), F.col("sec").cast("double").alias("t"), "score")
    met = intervals.point_join(e, seg, ["video_id"], "t", ("start_s", "end_s"), 1200.0)
    asd = met.groupBy("speaker", "identity").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("asd"))
    vis = met.groupBy("speaker", "identity").agg(F.count("*").cast("double").alias("vis"))
    return speakers.speaker_prior(asd, vis, "speaker", "identity")


@add("global_top_identity", ["v_scores"], "select track_id, n from (select track_id, count(*) filter (score > 0) as n, row_number() over (order by count(*) filter (score > 0) desc, track_id) as r from v_scores group by track_id) where r = 1")
def global_top_identity(spark, d):
    return view(spark, d, "v_scores").groupBy("track_id").agg(F.count_if(F.col("score") > 0).alias("n")).orderBy(F.desc("n"), "track_id").limit(1)


@add("srt_lines", ["v_segments"], """select seg_id, printf('%02d:%02d:%02d,%03d', cast(floor(start_s / 3600) as int), cast(floor((floor(start_s) % 3600) / 60) as int), cast(floor(start_s) % 60 as int), cast(floor((start_s - floor(start_s)) * 1000) as int)) as start_t,
  printf('%d:%02d:%02d.%02d', cast(floor(end_s / 3600) as int), cast(floor((floor(end_s) % 3600) / 60) as int), cast(floor(end_s) % 60 as int), cast(round_even((end_s - floor(end_s)) * 100, 0) as int)) as end_t from v_segments""")
def srt_lines(spark, d):
    return view(spark, d, "v_segments").select("seg_id", tx.srt_time(F.col("start_s")).alias("start_t"), tx.ass_time(F.col("end_s")).alias("end_t"))


@add("best_prompt_frame", ["v_boxes"], "select video_id, arg_max(frame, (n, s, -frame)) as frame, max(n) as n from (select video_id, frame, count(*) as n, round(sum(conf), 6) as s from v_boxes where frame % 5 = 0 group by video_id, frame) group by video_id")
def best_prompt_frame(spark, d):
    f = view(spark, d, "v_boxes").filter("frame % 5 = 0").groupBy("video_id", "frame").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 6).alias("s"))
    return f.groupBy("video_id").agg(F.max_by("frame", F.struct("n", "s", -F.col("frame"))).alias("frame"), F.max("n").alias("n"))


@add("nearest_frames", ["v_track_frames", "v_shots"], """with p as (select s.video_id, s.shot_id, t.frame, t.frame - s.start_f as df, row_number() over (partition by s.video_id, s.shot_id order by abs(t.frame - s.start_f - 50), t.frame) as r
    from v_shots s join (select distinct video_id, frame from v_track_frames) t on t.video_id = s.video_id and t.frame >= s.start_f and t.frame < s.end_f)
  select video_id, shot_id, frame, r as rank from p where r <= 4""")
def nearest_frames(spark, d):
    """The four frames of each shot nearest to its fiftieth."""
    f = view(spark, d, "v_track_frames").select("video_id", "frame").distinct()
    met = intervals.point_join(f, view(spark, d, "v_shots"), ["video_id"], "frame", ("start_f", "end_f"), 100.0)
    w = Window.partitionBy("video_id", "shot_id").orderBy(F.abs(F.col("frame") - F.col("start_f") - 50), "frame")
    return met.withColumn("rank", F.row_number().over(w)).filter("rank <= 4").select("video_id", "shot_id", "frame", "rank")


_RUNS = """m as (select frame, arg_max(track_id, (score, -track_id)) as win from v_scores group by frame), g as (select frame, frame // 24 as day, win from m),
  q as (select *, sum(case when win = pw then 0 else 1 end) over (partition by day order by frame) as run from (select *, lag(win) over (partition by day order by frame) as pw from g)),
  w as (select day, cast(min(frame) as double) as s, cast(max(frame) + 1 as double) as e, min(win) as win, run from q group by day, run)"""
#: Runs x (day, i, s, e, label) with equal neighbours as one.
_JOINED = """y as (select *, sum(case when label = pl then 0 else 1 end) over (partition by day order by i) as part from (select *, lag(label) over (partition by day order by i) as pl from x))
  select day, min(s) as s, max(e) as e, min(label) as label from y group by day, part"""


@add("absorb_short_runs", ["v_scores"], f"""with recursive {_RUNS},
  c as (select day, s, e, cast(win as varchar) as label, row_number() over (partition by day order by s) as i, count(*) over (partition by day) as n from w),
  r as (select day, cast(1 as bigint) as k, cast([] as struct(s double, e double, label varchar)[]) as done from (select distinct day from c) union all
    select r.day, case when c.e - c.s < 2 and c.n > 1 and not (len(done) > 0 and (x.i is null or done[-1].e - done[-1].s >= x.e - x.s)) then k + 2 else k + 1 end,
      case when c.e - c.s >= 2 or c.n = 1 then list_append(done, {{'s': c.s, 'e': c.e, 'label': c.label}})
           when len(done) > 0 and (x.i is null or done[-1].e - done[-1].s >= x.e - x.s) then list_append(done[:-2], {{'s': done[-1].s, 'e': c.e, 'label': done[-1].label}})
           else list_append(done, {{'s': c.s, 'e': x.e, 'label': x.label}}) end
    from r join c on c.day = r.day and c.i = r.k left join c x on x.day = r.day and x.i = r.k + 1),
  l as (select day, unnest(done) as d, generate_subscripts(done, 1) as i from (select day, arg_max(done, k) as done from r group by day)),
  x as (select day, i, d.s as s, d.e as e, d.label as label from l), {_JOINED}""")
def absorb_short_runs(spark, d):
    """Winner runs of each day without runs shorter than two frames."""
    runs = winner_runs(spark, d).select("day", F.col("first").cast("double").alias("s"), (F.col("last") + 1).cast("double").alias("e"), F.col("win").cast("string").alias("label"))
    return speakers.chain_runs(runs, ["day"], "s", "e", "label", lambda r: speakers.absorb_short(r, 2.0))


@add("absorb_prior_runs", ["v_scores"], f"""with {_RUNS}, p as (select day, mode(win order by win) as prior, count(*) as n from w group by day),
  x as (select w.day, row_number() over (partition by w.day order by s) as i, s, e, cast(case when e - s <= 1 and n > 1 then prior else win end as varchar) as label from w join p on p.day = w.day), {_JOINED}""")
def absorb_prior_runs(spark, d):
    """Runs of one frame become those of the identity that wins most runs of the day."""
    runs = winner_runs(spark, d).select("day", F.col("first").cast("double").alias("s"), (F.col("last") + 1).cast("double").alias("e"), F.col("win").cast("string").alias("label"), "win")
    counted = runs.groupBy("day", "win").agg(F.count("*").alias("n"))
    prior = counted.groupBy("day").agg(F.max_by("win", F.struct("n", -F.col("win"))).cast("string").alias("prior"))
    return speakers.absorb_weak_runs(runs.drop("win").join(prior, "day"), ["day"], "s", "e", "label", "prior", 1.0)


@add("smooth_flips", ["v_scores"], f"""with recursive {_RUNS}, c as (select day, s, e, cast(win % 2 as varchar) as label, row_number() over (partition by day order by s) as i from w),
  x as (select day, i, s, e, label from c where i = 1 union all
    select c.day, c.i, c.s, c.e, case when x.label = z.label and c.label <> z.label and c.e - c.s <= 1 then x.label else c.label end as label
    from x join c on c.day = x.day and c.i = x.i + 1 left join c z on z.day = x.day and z.i = x.i + 2), {_JOINED}""")
def smooth_flips(spark, d):
    runs = winner_runs(spark, d).select("day", F.col("first").cast("double").alias("s"), (F.col("last") + 1).cast("double").alias("e"), (F.col("win") % 2).cast("string").alias("label"))
    return speakers.chain_runs(runs, ["day"], "s", "e", "label", lambda r: speakers.smooth_flips(r, 1.0))


@add("stage_log", ["v_events"], "select event_type as stage, min(sec) as ts_start, max(sec) as ts_end, max(sec) - min(sec) as elapsed_sec, count(*) as n from v_events group by event_type")
def stage_log(spark, d):
    return view(spark, d, "v_events").groupBy(F.col("event_type").alias("stage")).agg(F.min("sec").alias("ts_start"), F.max("sec").alias("ts_end"), (F.max("sec") - F.min("sec")).alias("elapsed_sec"), F.count("*").alias("n"))


@add("session_windows", [], """with e as (select user_id, ts, event_id, lag(ts) over (partition by user_id order by ts, event_id) as p from events),
  r as (select *, sum(case when ts < p + interval 6 hour then 0 else 1 end) over (partition by user_id order by ts, event_id) as s from e)
  select user_id, min(ts) as start_ts, count(*) as n from r group by user_id, s""")
def session_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), "n")
