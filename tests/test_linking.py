"""Hand cases of the sequential operators and of rotated boxes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import rotated
from sightline.operators import linking


def test_link():
    box = (0.0, 0.0, 10.0, 10.0)
    frames = [[(f, f"a{f}", *box), (f, f"b{f}", 50.0, 0.0, 60.0, 10.0)] for f in range(4)] + [[(20, "late", *box)]]
    assert [[d[1] for d in t] for t in linking.link(frames, 10, 0.5)] == [["a0", "a1", "a2", "a3"], ["b0", "b1", "b2", "b3"], ["late"]]


def test_link_skips_the_one_after():
    box = (0.0, 0.0, 10.0, 10.0)
    frames = [[(0, "a", *box)], [(1, "b", *box), (1, "c", *box), (1, "d", *box)]]
    assert [[d[1] for d in t] for t in linking.link(frames, 10, 0.5)] == [["a", "b", "d"], ["c"]]


def test_merge_windows():
    assert linking.merge_windows([(0.05, 1.0, "a"), (0.0, 1.0, "a"), (0.0, 1.0, "b"), (5.0, 6.0, "a")]) == [(0.0, 1.0, "a"), (0.0, 1.0, "b"), (0.05, 1.0, "a"), (5.0, 6.0, "a")]
    assert linking.merge_windows([(0.05, 1.0, "a"), (0.0, 1.0, "a")]) == [(0.0, 1.0, "a")]


def test_refine():
    """Worked by hand: snapping, splits, joins, cuts in overlaps, closed gaps and what is too short."""
    near = lambda rows: [(pytest.approx(s), pytest.approx(e), who) for s, e, who in rows]
    words = [(1.0, 1.4), (1.5, 2.0), (4.0, 5.0)]
    # the silence from 2 to 4 splits, and as the parts touch they are joined again
    assert linking.refine([(0.0, 6.0, "a", words)]) == near([(0.95, 5.05, "a")])
    # no words: as it is, whatever its length; nothing else is that short
    assert linking.refine([(0.0, 0.2, "a", []), (5.0, 5.3, "a", [(5.0, 5.3)]), (7.0, 7.0, "a", [])]) == near([(0.0, 0.2, "a")])
    # an overlap of two speakers is cut in its middle, a small gap closes in its middle, a larger one stays
    assert linking.refine([(0.0, 4.0, "a", None), (3.0, 8.0, "b", None), (8.1, 9.5, "a", None), (10.0, 11.0, "b", None)]) == near([(0.0, 3.5, "a"), (3.5, 8.05, "b"), (8.05, 9.5, "a"), (10.0, 11.0, "b")])
    # one speaker: a gap of a tenth and an overlap join
    assert linking.refine([(0.0, 1.0, "a", None), (1.05, 2.0, "a", None), (1.5, 3.0, "a", None), (3.2, 4.0, "a", None)]) == near([(0.0, 3.0, "a"), (3.2, 4.0, "a")])
    # the cut leaves the later one a quarter second before its end at least; too short, it goes, and the earlier one keeps its cut
    assert linking.refine([(0.0, 4.0, "a", None), (3.5, 4.1, "b", None)]) == near([(0.0, 3.75, "a"), (3.5, 4.1, "b")])
    assert linking.refine([(0.0, 4.0, "a", None), (3.7, 4.1, "b", None)]) == near([(0.0, 3.85, "a")])
    # what was too short before it meets another speaker makes room
    assert linking.refine([(0.0, 0.3, "a", None), (0.2, 2.0, "b", None)]) == near([(0.25, 2.0, "b")])
    assert linking.refine([]) == []


def test_register():
    x, y = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert linking.register([(0, 0, 5, x), (1, 3, 6, x), (2, 6, 9, x), (3, 9, 10, y)]) == [0, 1, 0, 2]


def test_groups():
    sim = np.array([[1, 0.9, 0.1], [0.9, 1, 0.1], [0.1, 0.1, 1]])
    assert linking.single_linkage(sim, [(0, 1), (2, 3), (0, 9)], 0.5, 0.95) == [0, 0, 2]
    assert linking.single_linkage(sim, [(0, 2), (1, 3), (0, 9)], 0.5, 0.95) == [0, 1, 2]
    c = np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 0.0]])
    assert linking.temporal_merge(c, [(0, 1), (2, 3), (100, 101)], 0.5, 5, 0.9, 50) == [0, 0, 2]


def test_batches_and_frames(spark):
    assert [len(b) for b in linking.minibatches([(1, "a"), (5, "b"), (2, "c"), (9, "d")], 6)] == [1, 1, 2]
    df = spark.createDataFrame([(11, [1, 2, 3]), (11, [1]), (100, list(range(40)))], "n int, a array<int>")
    got = [r[0] for r in df.select(linking.key_frames(F.col("n"), F.col("a"))).collect()]
    assert got[0] == [0, 1, 2, 3, 5, 7, 10] and got[1] == [0, 2, 5, 7, 10] and len(got[2]) <= 15


def test_resume_and_annotators(spark):
    chunks = spark.range(4).withColumnRenamed("id", "chunk")
    done = spark.createDataFrame([(0, None), (1, "failed")], "chunk long, error string")
    assert sorted(r["chunk"] for r in linking.resume(chunks, done, ["chunk"]).collect()) == [1, 2, 3]
    s = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.7), (2, "a", None), (2, "b", 0.9)], "img int, who string, f double")
    assert {r["img"]: r["who"] for r in linking.best_annotator(s, ["img"], "who", "f").collect()} == {1: "b", 2: "a"}


def test_rotated_boxes():
    a = np.array([0, 0, 2, 2, 0.0])
    assert rotated.iou(a, np.array([0, 0, 2, 2, 90.0])) == pytest.approx(1)
    assert rotated.iou(a, np.array([1, 0, 2, 2, 0.0])) == pytest.approx(1 / 3)
    octagon = 8 * (math.sqrt(2) - 1)
    assert rotated.iou(a, np.array([0, 0, 2, 2, 45.0])) == pytest.approx(octagon / (8 - octagon))
    assert rotated.iou(a, np.array([9, 9, 2, 2, 45.0])) == 0


def test_groups_of_tables(spark):
    rows = [(1, 0, 0.0, 1.0, [1.0, 0.0]), (1, 1, 2.0, 3.0, [2.0, 0.1]), (1, 2, 0.0, 9.0, [0.0, 1.0]), (2, 5, 0.0, 2.0, [1.0, 0.0]), (2, 6, 1.0, 3.0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "v int, t int, s double, e double, x array<double>")
    linked = {(r["v"], r["t"]): r["group"] for r in linking.linked_groups(df, ["v"], "t", "s", "e", "x", 0.5, 1.1).collect()}
    assert linked == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (2, 5): 0, (2, 6): 1}
    joined = {(r["v"], r["t"]): r["group"] for r in linking.joined_groups(df, ["v"], "t", "s", "e", "x", 0.5, 5.0, 0.9, 50.0).collect()}
    assert joined == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (2, 5): 0, (2, 6): 1}
