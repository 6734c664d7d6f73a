"""Readers and writers over small files."""

import json

import pytest
from pyspark.sql import functions as F

from sightline.operators.prune import MissingReference
from sightline.sources import annotations, sinks


def test_video_set(spark, tmp_path):
    data = {
        "videos": [{"id": "1", "video_name": "a", "file_names": ["0.jpg", "1.jpg"], "height": 4, "width": 5, "length": 2}],
        "annotations": [{"id": 7, "video_id": "1", "category_id": 2, "bboxes": [[0, 0, 2, 3], None], "areas": [None, None], "iscrowd": 0, "noun_phrase": "x"}],
        "categories": [{"id": 2, "name": "x"}],
        "video_np_pairs": [{"id": 1, "video_id": "1", "category_id": 2, "noun_phrase": "x", "num_masklets": 1}],
    }
    (tmp_path / "v.json").write_text(json.dumps(data))
    parts = annotations.read_video_set(spark, str(tmp_path / "v.json"))
    a = parts["annotations"].first()
    assert a["video_id"] == 1 and a["filled_bboxes"][1] == [0, 0, 0, 0] and a["mean_area"] == 0
    f = annotations.frames_of(parts["annotations"]).collect()
    assert [(r["frame"], r["area"]) for r in f] == [(0, 6.0)]


def test_results_need_their_images(spark):
    images = spark.createDataFrame([(1,)], "id long")
    schema = "image_id long, category_id long, bbox array<double>, score double"
    assert annotations.load_results(spark.createDataFrame([(1, 2, [0.0, 0.0, 2.0, 4.0], 0.5)], schema), images).first()["area"] == 8
    with pytest.raises(MissingReference):
        annotations.load_results(spark.createDataFrame([(9, 2, [0.0, 0.0, 2.0, 4.0], 0.5)], schema), images)


def test_text_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1,5,0,0,2,2,0.9\n2,-1,0,0,2,2,0.9\n")
    assert annotations.read_track_text(spark, str(tmp_path / "t.txt")).count() == 1
    (tmp_path / "trials.tsv").write_text("a\t3\t25.0\t[0, 1, 1]\n")
    assert annotations.read_trials(spark, str(tmp_path / "trials.tsv")).first()["labels"] == [0, 1, 1]
    (tmp_path / "p.csv").write_text("0.0,\nN/A\n\n0.08\n")
    assert [r["pts"] for r in annotations.read_times(spark, str(tmp_path / "p.csv")).orderBy("frame").collect()] == [0.0, None, None, 0.08]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert annotations.last_rows(spark, str(tmp_path / "l.jsonl")).first()["value"] == '{"a": 2}'


def test_folder(spark, tmp_path):
    for n in ("a.avi", "a.mp4", "b.mkv", "c.txt"):
        (tmp_path / n).write_text("x")
    assert {r["path"].rsplit("/", 1)[1] for r in annotations.scan_folder(spark, str(tmp_path)).collect()} == {"a.mp4", "b.mkv"}


def test_single_files(spark, tmp_path):
    for n in ("a.avi", "a.mp4", "x/conf.yaml", "y/code/conf.yaml", "y/other.yaml"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    assert annotations.resolve_video(spark, str(tmp_path), "a").endswith("a.mp4")
    with pytest.raises(FileNotFoundError):
        annotations.resolve_video(spark, str(tmp_path), "z")
    assert [r["path"].rsplit("/", 2)[1] for r in annotations.crawl_configs(spark, str(tmp_path), "conf.yaml").collect()] == ["x"]


def test_a_stage_is_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert annotations.read_or_make(spark, str(tmp_path / "stage"), make).count() == 3
    assert len(calls) == 1


def test_video_results_and_details(spark, tmp_path):
    rows = [(1, 2, 7, 3, 0, 0.5, [4, 2], 2, 3), (1, 2, 7, 3, 2, 1.0, [0, 6], 2, 3)]
    masks = spark.createDataFrame(rows, "video_id long, category_id long, track_id long, length int, frame int, score double, counts array<int>, height int, width int")
    sinks.write_video_results(masks, str(tmp_path / "r"))
    r = json.loads(spark.read.text(str(tmp_path / "r")).first()["value"])
    assert r["score"] == 0.75 and r["segmentations"] == [{"size": [2, 3], "counts": [4, 2]}, None, {"size": [2, 3], "counts": [0, 6]}]
    fields = spark.createDataFrame([("s", "c", "hota", 1, 0.2), ("s", "c", "hota", 0, 0.4)], "seq string, cls string, field string, level int, value double")
    sinks.write_details(fields, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first()["values"] == [0.4, 0.2]


def test_subtitles(spark, tmp_path):
    seg = spark.createDataFrame([(1, 0.0, 2.0, "P", "one two three four five six")], "seg_id int, start_s double, end_s double, style string, text string")
    rows = sinks.sliced(seg).orderBy("start_s").collect()
    assert [(r["start_s"], r["end_s"]) for r in rows] == [(0.0, 1.0), (1.0, 2.0)]
    sinks.write_subtitles(sinks.sliced(seg), str(tmp_path / "s"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert lines[0] == "[Script Info]" and lines[-1].startswith("Dialogue: 0,0:00:01.00,0:00:02.00,P,,0,0,0,,")
    assert [x for x in lines if x.startswith("Style: ")] == [x for x in sinks.header({"P": "&H00FFFFFF"}) if x.startswith("Style: ")] and "[V4+ Styles]" in lines
    # every event has the fields that its format names
    assert all(len(x.split(": ", 1)[1].split(",")) == len(sinks.EVENT_FIELDS.split(",")) for x in lines if x.startswith("Dialogue"))
    words = spark.createDataFrame([(1, "P", [(0.0, 1.0, "x" * 20), (1.0, 2.0, "y" * 20)])], "seg_id int, style string, words array<struct<start:double,end:double,word:string>>")
    assert [(r["line"], r["start_s"]) for r in sinks.word_lines(words).orderBy("line").collect()] == [(0, 0.0), (1, 1.0)]


def test_dumps(spark, tmp_path):
    sinks.write_predictions(spark.createDataFrame([(1, 2, [0.1234567], 0.7)], "image_id long, category_id long, bbox array<double>, score double"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first()["bbox"] == [0.12346]
    with sinks.stage(spark, "x", str(tmp_path / "log")):
        pass
    assert spark.read.json(str(tmp_path / "log")).filter(F.col("stage") == "x").count() == 1
