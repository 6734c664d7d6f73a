"""Extension points: metrics, datasets, filters and embedders of one's own."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import plugins


class Counts(plugins.Metric):
    name = "counts"

    def sequences(self, data):
        return data.truth.groupBy(*data.keys).agg(F.count("*").alias("n"))

    def combined(self, per_sequence, keys):
        return per_sequence.groupBy(*keys).agg(F.sum("n").alias("n"))

    def class_average(self, per_class, ignore_empty=True):
        return per_class.agg(F.avg("n").alias("n"))


class Few(plugins.Dataset):
    def load(self, spark):
        truth = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 5)], "seq int, t int, gt_id int")
        return truth, truth.withColumnRenamed("gt_id", "tk_id")

    def preprocess(self, truth, found):
        return truth.filter("seq < 9"), found

    def similarity(self, truth, found):
        sim = truth.join(found, ["seq", "t"]).withColumn("sim", F.lit(1.0))
        return plugins.Sequences(truth, found, sim, ["seq"])


def test_metrics_and_datasets(spark, monkeypatch):
    monkeypatch.setattr(plugins, "METRICS", dict(plugins.METRICS))
    plugins.register_metric(Counts())
    with pytest.raises(ValueError):
        plugins.register_metric(Counts())
    out = plugins.evaluate(["counts", "hota"], Few().sequences(spark), [])
    assert out["counts"].first()["n"] == 3 and all(r["hota"] == 1 for r in out["hota"].collect())
    with pytest.raises(KeyError):
        plugins.evaluate(["none"], Few().sequences(spark), [])


def test_filters(spark):
    q = spark.createDataFrame([(1, 1, "cat", True), (1, 2, "dog", False), (1, 3, "car", False), (2, 4, "cat", False), (1, 5, "bus", True)], "img int, id int, text string, pos boolean")
    left = plugins.apply_filters(q, ["id"], [plugins.with_text_in("text", ["dog"]), plugins.beyond(1, ["img"], ["id"], "pos")])
    assert sorted(r["id"] for r in left.collect()) == [1, 4, 5]
    assert sorted(r["id"] for r in plugins.apply_filters(q, ["id"], [plugins.beyond(2, ["img"], ["id"])]).collect()) == [1, 2, 4]


def test_embedders_are_made_once():
    made = []
    plugins.register_embedder("one", lambda: made.append(1) or (lambda crops: [[1.0] for _ in crops]))
    assert plugins.embedder("one")(["x", "y"]) == [[1.0], [1.0]] and plugins.embedder("one") and made == [1]
    with pytest.raises(KeyError):
        plugins.embedder("two")
