"""The driver's tables seen as detections, tracks, segments and words: as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SECOND = "(day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts)"

#: Views whose text both engines read; each may use those before it. Fifty users, or ten suppliers, are one video, so that videos
#: grow in number with the tables and not in size.
SQL = {
    "v_events": f"select cast(floor(user_id / 50.0) as bigint) as video_id, user_id, event_id, event_type, value, props, {_SECOND} as sec from events",
    "v_scores": """select video_id, user_id as track_id, event_id, sec, row_number() over (partition by user_id order by sec, event_id) - 1 as pos,
        cast(floor(sec / 3600.0) as int) as frame, value - 35.0 as score from v_events""",
    "v_segments": """select video_id, event_id as seg_id, concat('SPK_', cast(user_id % 5 as string)) as speaker, cast(sec as double) as start_s,
        sec + 600.0 + value * 10.0 as end_s from v_events where event_type in ('signup', 'purchase')""",
    "v_boxes": """select cast(floor(l_suppkey / 10.0) as bigint) as video_id, (year(l_shipdate) - 1995) * 366 + dayofyear(l_shipdate) as frame,
        concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string)) as det_id,
        l_suppkey as track_id, l_linenumber as category_id, l_returnflag as side, l_quantity * 10.0 as x1, l_tax * 5000.0 as y1,
        l_quantity * 10.0 + 40.0 + l_discount * 600.0 as x2, l_tax * 5000.0 + 40.0 + l_discount * 600.0 as y2, l_extendedprice / 105000.0 as conf
        from lineitem""",
    "v_gt": "select * from v_boxes where side = 'N'",
    "v_pred": "select * from v_boxes where side <> 'N' and conf > 0.1",
    "v_shots": """select video_id, cast(floor(frame / 100.0) as int) as shot_id, min(frame) as start_f, max(frame) + 1 as end_f
        from v_boxes group by video_id, cast(floor(frame / 100.0) as int)""",
    "v_track_frames": """select video_id, track_id, frame, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, max(conf) as conf
        from v_boxes group by video_id, track_id, frame""",
}
_NEEDS = {
    "v_events": [], "v_scores": ["v_events"], "v_segments": ["v_events"], "v_boxes": [], "v_gt": ["v_boxes"], "v_pred": ["v_boxes"], "v_shots": ["v_boxes"], "v_track_frames": ["v_boxes"],
}
_WORDS = {
    "spark": """select doc_id, pos, word, pos * cast(0.4 as double) as start_s, pos * cast(0.4 as double) + cast(0.3 as double) as end_s
        from (select doc_id, posexplode(split(text, ' ')) as (pos, word) from documents) where trim(word) <> ''""",
    "duckdb": """select doc_id, pos, word, pos * cast(0.4 as double) as start_s, pos * cast(0.4 as double) + cast(0.3 as double) as end_s
        from (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from documents) where trim(word) <> ''""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, planned straight over the parquet scan."""
    if name == "v_words":
        return spark.sql(_WORDS["spark"].replace("documents", "{documents}"), documents=table(spark, sf_dir, "documents"))
    if name not in SQL:
        return table(spark, sf_dir, name)
    needs = _NEEDS[name] or [{"v_events": "events", "v_boxes": "lineitem"}[name]]
    text = SQL[name]
    for n in needs:
        text = text.replace(f"from {n}", f"from {{{n}}}")
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in needs})


def oracle(names: list[str], query: str) -> str:
    """query with the views it names put before it."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    body = ", ".join(f"{n} as ({_WORDS['duckdb'] if n == 'v_words' else SQL[n]})" for n in order)
    rest = query.strip()
    if not body:
        return rest
    if rest[:14].lower() == "with recursive":
        return f"with recursive {body}, {rest[14:]}"
    return f"with {body}, {rest[5:]}" if rest[:5].lower() == "with " else f"with {body} {rest}"
