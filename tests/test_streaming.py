"""The tracker over a stream gives what it gives over a batch; windows over late events."""

import json

from pyspark.sql import functions as F

from sightline.streaming import tracker

SCHEMA = "video_id long, frame long, det_id string, x1 double, y1 double, x2 double, y2 double, conf double"


def detections():
    rows = []
    for v in range(2):
        for f in range(30):
            rows.append((v, f, f"a{f}", 10.0 + f, 10.0, 30.0 + f, 30.0, 0.9))
            if f % 3:
                rows.append((v, f, f"b{f}", 100.0, 100.0 + f, 120.0, 120.0 + f, 0.8))
            if f == 5:
                rows.append((v, f, "ghost", 300.0, 300.0, 310.0, 310.0, 0.95))
    return rows


def test_state_round_trip():
    t = tracker.Tracker()
    for f in range(4):
        t.step(f, [("d", 0.0, 0.0, 9.0, 9.0, 0.9)])
    assert tracker.Tracker.load(t.dump()) == t and json.loads(t.dump())["next_id"] == 2


def test_removed_tracks_are_hidden_in_buffered_frames(spark):
    out = tracker.track(spark.createDataFrame(detections(), SCHEMA)).collect()
    assert "ghost" not in {r["det_id"] for r in out}
    assert {r["track_id"] for r in out if r["det_id"].startswith("a") and r["video_id"] == 0} == {1}


def test_stream_equals_batch(spark, tmp_path):
    rows = detections()
    want = sorted(map(tuple, tracker.track(spark.createDataFrame(rows, SCHEMA)).collect()))
    for k in range(3):
        spark.createDataFrame([r for r in rows if k * 10 <= r[1] < k * 10 + 10], SCHEMA).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    spark.createDataFrame([(v, -1, "end", 0.0, 0.0, 0.0, 0.0, 0.0) for v in range(2)], SCHEMA).coalesce(1).write.json(str(tmp_path / "in/3"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    query = tracker.track_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_windowed_counts_over_a_stream(spark, tables, tmp_path):
    events = spark.read.parquet(f"{tables}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    win = lambda df: df.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    query = win(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, win(events).collect()))


def test_one_to_one_and_hidden_rows(spark):
    """Two objects close together: each detection its own track by the best sum, where the greedy choice leaves one without."""
    box = lambda x: (x, 0.0, x + 10.0, 10.0)
    t = tracker.Tracker(tracker.Settings(one_to_one=True))
    t.step(0, [("a0", *box(0.0), 0.9), ("b0", *box(12.0), 0.9)])
    t.step(1, [("a1", *box(6.0), 0.95), ("b1", *box(13.0), 0.9)])
    assert [{(r[1], r[0]) for r in e["rows"]} for e in t.buffer] == [{("a0", 1), ("b0", 2)}, {("a1", 1), ("b1", 2)}]
    greedy = tracker.Tracker()
    greedy.step(0, [("a0", *box(0.0), 0.9), ("b0", *box(12.0), 0.9)])
    greedy.step(1, [("a1", *box(6.5), 0.95), ("b1", *box(13.0), 0.9)])
    assert len(greedy.buffer[1]["rows"]) == 1
    rows = detections()
    all_rows = tracker.track(spark.createDataFrame(rows, SCHEMA)).collect()
    shown = tracker.track(spark.createDataFrame(rows, SCHEMA), tracker.Settings(hide_unconfirmed=True)).collect()
    assert sorted(map(tuple, shown)) == sorted(tuple(r) for r in all_rows if r["confirmed"])
