"""Hand-computed cases and brute-force versions of the operators that have no SQL form."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.functions import boxes as bx
from sightline.functions import rle
from sightline.functions import text as tx
from sightline.operators import assign, cluster, intervals, metrics, pairs, prune, sequences, speakers, suppress
from sightline.operators.components import components
from sightline.plans import catalog
from tests.oracle import connect, rows_of, rows_of_sql


def boxes(spark, rows):
    return spark.createDataFrame(rows, "video_id int, frame int, det_id string, x1 double, y1 double, x2 double, y2 double, conf double")


def test_box_functions(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    a, b = bx.box("a"), bx.box("b")
    r = df.select(bx.iou(a, b).alias("iou"), bx.centre_distance(a, b).alias("d"), bx.giou(a, b).alias("g"), bx.iom(a, b).alias("m"), bx.point_distance(F.lit(13.0), F.lit(14.0), a).alias("p")).collect()
    assert r[0]["iou"] == pytest.approx(1 / 3) and r[0]["d"] == 0.5 and r[0]["g"] == pytest.approx(1 / 3) and r[0]["m"] == 0.5 and r[0]["p"] == 5
    assert r[1]["iou"] == 0 and r[1]["m"] == 0


def test_times_and_lines(spark):
    df = spark.createDataFrame([(1.999, "a b"), (3661.5, "one two three four five six seven"), (0.0, "")], "s double, t string")
    r = df.select(tx.ass_time(F.col("s")), tx.srt_time(F.col("s")), tx.wrap_subtitle(F.col("t")), tx.tool_call(F.lit('x <tool>{"a": {"b": 1}}}</tool>'))).collect()
    assert r[0][0] == "0:00:01.100" and r[1][1] == "01:01:01,500"
    assert r[1][2] == ["one two three four five", "six seven"] and r[2][2] == []
    assert r[0][3] == '{"a": {"b": 1}}'


def test_frame_nms(spark):
    rows = [(0, 1, "A", 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, "B", 1.0, 0.0, 11.0, 10.0, 0.8), (0, 1, "C", 50.0, 0.0, 60.0, 10.0, 0.7), (0, 2, "B", 1.0, 0.0, 11.0, 10.0, 0.8)]
    out = suppress.suppress(boxes(spark, rows), ["video_id", "frame"], "conf", ["det_id"], suppress.iou_or_centre(0.7, 0.25)).collect()
    assert {(r["frame"], r["det_id"]) for r in out} == {(1, "A"), (1, "C"), (2, "B")}
    assert suppress.suppress(boxes(spark, []), ["video_id", "frame"], "conf", ["det_id"], suppress.iou_above(0.5)).count() == 0


def test_nms_is_the_same_however_dealt(spark):
    rng = random.Random(3)
    rows = [(0, rng.randrange(40), f"d{i}", (x := rng.uniform(0, 50)), (y := rng.uniform(0, 50)), x + 20, y + 20, rng.random()) for i in range(400)]
    want = None
    for n in (1, 7):
        out = {r["det_id"] for r in suppress.suppress(boxes(spark, rows).repartition(n), ["frame"], "conf", ["det_id"], suppress.iou_above(0.3)).collect()}
        want = want or out
        assert out == want
    kept = [r for r in rows if r[2] in want]
    for a, b in itertools.combinations(kept, 2):
        if a[1] == b[1]:
            assert suppress.pair_iou(np.array(a[3:7]), np.array([b[3:7]]))[0] <= 0.3


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_hungarian_is_best(n, m, seed):
    c = np.random.default_rng(seed).integers(-9, 10, (n, m)).astype(float)
    i, j = assign.hungarian(c)
    assert len(i) == min(n, m) == len(set(j.tolist())) == len(set(i.tolist()))
    small, large = (c, m) if n <= m else (c.T, n)
    best = min(sum(small[k, p[k]] for k in range(len(small))) for p in itertools.permutations(range(large), len(small)))
    assert c[i, j].sum() == best


def test_assign_leaves_unlisted_pairs(spark):
    df = spark.createDataFrame([(1, "a", "x", -0.9), (1, "b", "x", -0.8), (1, "b", "y", -0.1)], "t int, g string, p string, cost double")
    assert {(r["g"], r["p"]) for r in assign.assign(df, ["t"], "g", "p", "cost").collect()} == {("a", "x"), ("b", "y")}
    assert {(r["g"], r["p"]) for r in assign.assign(df, ["t"], "g", "p", "cost", missing=0.0).collect()} == {("a", "x"), ("b", "y")}


def test_intervals(spark):
    scores = spark.createDataFrame([(1, i, s) for i, s in enumerate([1.0, 1.0, -1.0, 2.0])], "track_id int, pos int, score double")
    got = {(r["start_s"], r["end_s"]) for r in intervals.active_intervals(scores, ["track_id"], "pos", "score", F.lit(10), 10.0).collect()}
    assert got == {(1.0, 1.2), (1.3, 1.4)}
    lines = spark.createDataFrame([(0, 0.0, 5.0, "a"), (0, 3.0, 6.0, "b")], "k int, s double, e double, who string")
    assert {(r["s"], r["e"], r["who"]) for r in intervals.collapse(lines, ["k"], ("s", "e"), ["who"]).collect()} == {(0.0, 3.0, "a"), (3.0, 6.0, "b")}


def test_interval_join_is_exact(spark):
    rng = random.Random(1)
    a = [(i, rng.randrange(2), (s := rng.randrange(100)), s + rng.randrange(0, 30)) for i in range(60)]
    b = [(i, rng.randrange(2), (s := rng.randrange(100)), s + rng.randrange(0, 30)) for i in range(60)]
    left = spark.createDataFrame(a, "i int, k int, s int, e int")
    right = spark.createDataFrame(b, "j int, k int, bs int, be int")
    for closed in (False, True):
        got = sorted((r["i"], r["j"]) for r in intervals.interval_join(left, right, ["k"], ("s", "e"), ("bs", "be"), 7.0, closed).collect())
        meets = lambda p, q: p[2] <= q[3] and q[2] <= p[3] if closed else p[2] < q[3] and q[2] < p[3]  # noqa: B023, E731
        assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and meets(p, q))


def test_fill_times(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 1.0), (1, 2, None), (1, 3, 3.0), (2, 0, None)], "k int, i int, t double")
    got = {(r["k"], r["i"]): r["filled"] for r in sequences.fill_times(df, ["k"], "i", "t").collect()}
    assert [got[1, i] for i in range(4)] == [0.0, 1.0, 3.0, 3.0] and got[2, 0] is None


def test_runs_of_speakers():
    a, b, c = "ABC"
    assert speakers.absorb_short([(0, 10, a), (10, 12, b), (12, 20, c)], 6) == [(0, 12, a), (12, 20, c)]
    assert speakers.absorb_short([(0, 2, a), (2, 20, b)], 6) == [(0, 20, b)]
    # the run that takes a short one isn't judged again, though it is short as well
    assert speakers.absorb_short([(0, 1, a), (1, 2, b), (2, 7, c)], 3) == [(0, 2, b), (2, 7, c)]
    assert speakers.absorb_short([(0, 9, a), (9, 10, b), (10, 25, c), (25, 26, a)], 3) == [(0, 9, a), (9, 26, c)]
    assert speakers.absorb_short([(0, 1, a)], 3) == [(0, 1, a)] and speakers.absorb_short([], 3) == []
    assert speakers.absorb_weak([(0, 5, a), (5, 5.5, b), (5.5, 6, c), (6, 9, c)], a) == [(0, 6, a), (6, 9, c)]
    assert speakers.absorb_weak([(0, 0.5, b)], a) == [(0, 0.5, b)] and speakers.absorb_weak([(0, 5, a), (5, 5.5, b)], None) == [(0, 5, a), (5, 5.5, b)]
    assert speakers.smooth_flips([(0, 5, a), (5, 5.4, b), (5.4, 9, a)], 0.5) == [(0, 9, a)]


def test_majority_and_prior(spark):
    df = spark.createDataFrame([("S", None, 0), ("S", "P1", 1), ("S", None, 2)], "speaker string, who string, i int")
    assert speakers.majority(df, ["speaker"], "who", "i").first()["who"] is None
    asd = spark.createDataFrame([("S", "P1", 10.0), ("S", "P2", 5.0)], "sp string, id string, asd double")
    vis = spark.createDataFrame([("S", "P1", 2.0), ("S", "P2", 4.0)], "sp string, id string, vis double")
    r = speakers.speaker_prior(asd, vis, "sp", "id").collect()
    assert [(x["id"], round(x["prior"], 9)) for x in r] == [("P1", 0.85)]


masks = st.integers(1, 7).flatmap(lambda h: st.integers(1, 7).flatmap(lambda w: st.lists(st.booleans(), min_size=h * w, max_size=h * w).map(lambda v: np.array(v).reshape(h, w))))


@settings(max_examples=80, deadline=None)
@given(masks, st.integers(0, 10**6))
def test_run_lengths(mask, seed):
    h, w = mask.shape
    other = np.random.default_rng(seed).random((h, w)) < 0.5
    a, b = rle.encode(mask), rle.encode(other)
    assert (rle.decode(a, h, w) == mask).all() and rle.expand(rle.compress(a)) == a
    assert rle.area(a) == mask.sum() and rle.intersection(a, b) == (mask & other).sum()
    assert rle.union([a, b], h * w) == rle.encode(mask | other)
    ys, xs = np.nonzero(mask)
    assert rle.bounds(a, h) == ((xs.min(), ys.min(), xs.max() + 1, ys.max() + 1) if len(xs) else (0, 0, 0, 0))
    labels, sizes = rle.components(mask)
    assert sizes.sum() == mask.sum() and ((labels > 0) == mask).all()


def test_masks_by_hand():
    assert rle.masklet_iou([None, None], [None, None]) == 1.0
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    m[4, 4] = False
    assert rle.clean(m, 2)[4, 4] and rle.boundary_f(m, m) == 1.0
    assert rle.from_box(2, 1, 5, 4, 9, 9) == rle.encode(np.pad(np.ones((3, 3), bool), ((1, 5), (2, 4))))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_agglomerate():
    x = np.array([[1, 0], [0.99, 0.14], [0, 1], [0.1, 0.99]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert cluster.agglomerate(x, 0.8).tolist() == [0, 0, 1, 1]
    assert cluster.agglomerate(x, 0.8, {(0, 1)}).tolist() == [0, 1, 2, 2]


def test_hota_by_hand(spark):
    g = spark.createDataFrame([(0, 0, 1)], "v int, t int, gt_id int")
    p = spark.createDataFrame([(0, 0, 5)], "v int, t int, tk_id int")
    s = spark.createDataFrame([(0, 0, 1, 5, 0.6)], "v int, t int, gt_id int, tk_id int, sim double")
    r = metrics.hota(g, p, s, ["v"]).orderBy("level").collect()
    assert [round(x["hota"]) for x in r] == [1] * 12 + [0] * 7
    for x in r:
        assert x["hota"] ** 2 == pytest.approx(x["det_a"] * x["ass_a"])


def test_hota_against_numpy(spark):
    rng = np.random.default_rng(2)
    g, p, s = [], [], []
    for t in range(12):
        gi, ti = rng.permutation(5)[: rng.integers(0, 5)], rng.permutation(6)[: rng.integers(0, 6)]
        g += [(0, t, int(i)) for i in gi]
        p += [(0, t, int(i)) for i in ti]
        s += [(0, t, int(a), int(b), float(rng.random())) for a in gi for b in ti if rng.random() < 0.7]
    sim = {(t, a, b): x for _, t, a, b, x in s}
    pot, gc, tc = np.zeros((5, 6)), np.zeros(5), np.zeros(6)
    frames = []
    for t in range(12):
        gi, ti = [i for _, u, i in g if u == t], [i for _, u, i in p if u == t]
        m = np.array([[sim.get((t, a, b), 0.0) for b in ti] for a in gi]).reshape(len(gi), len(ti))
        den = m.sum(0, keepdims=True) + m.sum(1, keepdims=True) - m
        for x, a in enumerate(gi):
            gc[a] += 1
            for y, b in enumerate(ti):
                pot[a, b] += m[x, y] / den[x, y] if den[x, y] > 0 else 0
        for b in ti:
            tc[b] += 1
        frames.append((gi, ti, m))
    jac = pot / (gc[:, None] + tc[None, :] - pot)
    rows = {x["level"]: x for x in metrics.hota(spark.createDataFrame(g, "v int, t int, gt_id int"), spark.createDataFrame(p, "v int, t int, tk_id int"), spark.createDataFrame(s, "v int, t int, gt_id int, tk_id int, sim double"), ["v"]).collect()}
    for level, alpha in enumerate(metrics.HOTA_STEPS):
        n, tp, loc = np.zeros((5, 6)), 0, 0.0
        for gi, ti, m in frames:
            if not m.size:
                continue
            i, j = assign.hungarian(-jac[np.ix_(gi, ti)] * m)
            for x, y in zip(i, j, strict=True):
                if m[x, y] >= alpha - 1e-12 and m[x, y] > 0:
                    n[gi[x], ti[y]] += 1
                    tp += 1
                    loc += m[x, y]
        ass = (n * n / np.maximum(1, gc[:, None] + tc[None, :] - n)).sum() / max(1, tp)
        assert rows[level]["tp"] == tp and rows[level]["ass_a"] == pytest.approx(ass)
        assert rows[level]["fn"] == len(g) - tp and rows[level]["fp"] == len(p) - tp


def test_concept_f1_by_hand(spark):
    two = spark.range(1).select(F.lit(2.0).alias("tp"), F.lit(2.0).alias("fp"), F.lit(2.0).alias("fn"))
    r = two.select(metrics.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("a"), metrics.np_f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("b")).first()
    assert r["a"] == pytest.approx(0.49994, abs=1e-5) and r["b"] == 0.5
    m = spark.createDataFrame([(i, 0, 0.5, *c) for i, c in enumerate([(1, 1, 1, 0, 0), (1, 1, 1, 0, 0), (1, 1, 1, 0, 0), (0, 1, 0, 1, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)])], "i int, level int, alpha double, n_gt int, n_dt int, tp int, fp int, fn int")
    assert metrics.concept_f1(m).first()["il_mcc"] == pytest.approx(0.70711, abs=1e-4)
    # images that neither side names come from the table of images
    truth = spark.createDataFrame([(0, "g")], "img int, id string")
    found = metrics.image_matches(truth, truth.filter("img > 0"), spark.createDataFrame([], "img int, gt_id string, dt_id string, iou double"), ["img"], [0.5], images=spark.range(3).select(F.col("id").cast("int").alias("img")))
    assert sorted(map(tuple, found.select("img", "n_gt", "n_dt", "tp", "fp", "fn").collect())) == [(0, 1, 0, 0, 0, 1), (1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0)]


def test_similar_pairs_by_brute_force(spark, monkeypatch):
    """Cells, shares and pruning lose no pair, whatever their sizes."""
    rng = np.random.default_rng(3)
    x = np.concatenate([c + 0.2 * rng.normal(size=(40, 8)) for c in rng.normal(size=(6, 8))] + [np.zeros((2, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(999, None)], "i long, v array<float>")
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-9)
    want = {(i, j) for i, j in itertools.combinations(range(240), 2) if unit[i] @ unit[j] >= 0.7}
    for block in (2048, 17):
        monkeypatch.setattr(cluster, "BLOCK", block)
        got = [(r["a"], r["b"]) for r in cluster.similar_pairs(df, "i", "v", 0.7).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_average_precision_by_hand(spark):
    found = spark.createDataFrame([(0, "a", 0.9), (0, "b", 0.8), (0, "c", 0.7)], "img int, dt_id string, score double")
    sim = spark.createDataFrame([(0, "a", "g1", 0.96), (0, "c", "g2", 0.62)], "img int, dt_id string, gt_id string, iou double")
    m = metrics.ap_matches(found, sim, ["img"])
    ap = {r["level"]: r["ap"] for r in metrics.average_precision(m, spark.createDataFrame([(0, 2)], "img int, n_gt long"), ["img"]).collect()}
    assert ap[0] == pytest.approx((51 * 1 + 50 * 2 / 3) / 101)
    assert ap[9] == pytest.approx(51 / 101)


def test_dense_ids_and_checks(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y"), (3, "z"), (2, "w")], "k int, v string")
    assert {(r["v"], r["n"]) for r in prune.dense_ids(df, ["k"], "n").collect()} == {("y", 1), ("w", 2), ("x", 3), ("z", 3)}
    with pytest.raises(prune.MissingReference):
        prune.require_unique(df, ["k"])
    with pytest.raises(prune.MissingReference):
        prune.require_subset(df, df.filter("k > 1"), ["k"])
    assert prune.to_one_based(spark.createDataFrame([(0, 5), (2, 6)], "a int, b int"), ["a", "b"]).orderBy("a").collect()[0][:] == (1, 5)


def test_upper_median(spark):
    assert spark.range(1).select(pairs.upper_median(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)))).first()[0] == 3.0


def test_shared_folder(spark, monkeypatch):
    from sightline import runtime

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError, match="share"):
            runtime.shared_dir(spark)
    assert runtime.unused(["a", "_X", "_x_"], "_x") == "_x__" and runtime.unused([], "_x") == "_x"


def test_groups_at_once_equal_one_by_one(monkeypatch):
    """Greedy suppression of many groups at once, small and large ones, for every measure."""
    rng = np.random.default_rng(9)
    size = rng.integers(1, 9, 60)
    cut = np.concatenate([[0], np.cumsum(size)])
    corner = rng.uniform(0, 20, (cut[-1], 2))
    boxes = np.concatenate([corner, corner + rng.uniform(0, 15, (cut[-1], 2))], 1)
    for small in (48, 4):
        monkeypatch.setattr(suppress, "SMALL", small)
        for conflict in (suppress.iou_at_least(0.2), suppress.iou_above(0.1), suppress.iom_above(0.3), suppress.iou_or_centre(0.5, 0.2)):
            want = np.concatenate([suppress.greedy(boxes[s:e], np.arange(e - s), conflict) for s, e in itertools.pairwise(cut)])
            assert (suppress.greedy_groups(boxes, cut, conflict) == want).all() and not want.all()
    assert suppress.greedy_groups(boxes[:0], np.array([0]), suppress.iou_above(0.1)).tolist() == []


def test_groups_without_conflict_take_all_pairs(spark):
    rows = [(1, "a", "x", -0.5), (1, "b", "y", 0.2), (2, "a", "x", -0.5), (2, "a", "y", -0.9), (2, "b", "y", -0.7), (3, "a", "x", 0.3)]
    df = spark.createDataFrame(rows, "k int, l string, r string, cost double")
    got = lambda **o: sorted((r["k"], r["l"], r["r"]) for r in assign.assign(df, ["k"], "l", "r", "cost", **o).collect())
    assert got(missing=0.0) == [(1, "a", "x"), (2, "a", "x"), (2, "b", "y")]
    assert got() == [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "y"), (3, "a", "x")]
    assert got(most=0.25) == [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "y")]


def test_equal_costs_go_by_id_whatever_the_batch_holds(spark):
    """Ids of other groups of a batch don't decide which of two equal pairs is taken."""
    tied = [(k, "a", r, -0.5) for k in range(8, 16) for r in ("x", "y")]
    for before in ([], [(k, "a", "y", -0.5) for k in range(8)]):
        df = spark.createDataFrame(before + tied, "k int, l string, r string, cost double").coalesce(1)
        assert {r["r"] for r in assign.assign(df, ["k"], "l", "r", "cost", missing=0.0).collect() if r["k"] >= 8} == {"x"}


def assignment_and_sql(spark, folder, rows):
    """The rows of `assignment`, found equal to its SQL's, over boxes (orderkey, quantity, flag) of one frame."""
    at = datetime.datetime(1995, 3, 1)
    spark.createDataFrame(
        [(k, 5, 3, 1, q, 50000.0, 0.0, 0.0, flag, at) for k, q, flag in rows],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp",
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    df = catalog.queries()["assignment"](spark, str(folder))
    got = rows_of(df)
    assert got == rows_of_sql(connect(str(folder)), catalog.oracle_sql()["assignment"], df.columns)
    return got


@pytest.mark.parametrize("swap", [False, True])
def test_assignment_tells_overlaps_apart_that_differ_in_the_last_bits(spark, tmp_path, swap):
    """The nearer prediction is taken, as in the SQL, also where 1 - iou is the same number for both."""
    near, far = ("2", "1") if swap else ("1", "2")
    got = assignment_and_sql(spark, tmp_path, [(0, 0.0, "N"), (int(near), 2.5001, "R"), (int(far), 2.5001000000000007, "R")])
    assert [r[1] for r in got] == [f"{near}-1-5-3"]


def test_assignment_of_repeated_ids(spark, tmp_path):
    """As in the SQL, two ids are as near as their nearest rows, and all their rows come out if they are matched."""
    got = assignment_and_sql(spark, tmp_path, [(0, 0.0, "N"), (0, 0.0, "N"), (1, 0.5, "R"), (1, 2.0, "R"), (2, 1.0, "R"), (2, 1.0, "R")])
    assert [r[1] for r in got] == ["1-1-5-3"] * 4 and len({r[0] for r in got}) == 2


def test_costs_that_are_no_numbers_match_nothing(spark):
    rows = [(1, "a", "x", math.nan), (1, "a", "y", -0.5), (1, "b", "x", -0.2), (1, "b", "y", -0.9), (2, "a", "x", math.nan), (2, "a", "y", math.nan), (3, "a", "x", math.nan)]
    df = spark.createDataFrame(rows, "k int, l string, r string, cost double")
    for missing in (0.0, None):
        assert [(r["k"], r["l"], r["r"]) for r in assign.assign(df, ["k"], "l", "r", "cost", missing=missing).orderBy("k", "l").collect()] == ([(1, "b", "y")] if missing == 0 else [(1, "a", "y"), (1, "b", "x")])
