"""The queries without an SQL twin, against plain versions over the same rows."""

import collections
import itertools

import numpy as np
import pytest

from sightline.functions import rotated
from sightline.operators import linking
from sightline.plans import catalog
from sightline.plans.views import view

COVERED = {"identity_clusters", "linked_tracks", "refined_segments", "rotated_overlaps", "track_boxes"}


def test_identity_clusters(spark, tables):
    """The closest two centroids merge, found anew from all members each time."""
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect())
    got = {r["vec_id"]: (r["part"], r["identity"]) for r in catalog.queries()["identity_clusters"](spark, tables).collect()}
    assert set(got) == {i for i, _ in rows}
    for part, members in itertools.groupby(rows, key=lambda r: r[0] // 100):
        members = list(members)
        x = np.array([v for _, v in members])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        groups = [[i] for i in range(len(x))]
        while len(groups) > 1:
            c = np.array([x[g].sum(0) for g in groups])
            c /= np.linalg.norm(c, axis=1, keepdims=True)
            s = np.where(np.tri(len(c), dtype=bool), -2, c @ c.T)
            i, j = divmod(int(s.argmax()), len(c))
            if s[i, j] < 0.2:
                break
            groups[i] += groups.pop(j)
        want = {members[i][0]: (part, f"Person_{k + 1}") for k, g in enumerate(sorted(groups, key=min)) for i in g}
        assert {i: got[i] for i, _ in members} == want


def plain_links(frames, gap, iou):
    """Linking as a walk over lists that lose items while they are walked."""
    frames = [list(f) for f in frames]
    tracks = []
    while any(frames):
        track = []
        for dets in frames:
            for d in dets:
                if not track:
                    track.append(d)
                    dets.remove(d)
                elif d[0] - track[-1][0] <= gap:
                    if linking._iou(d[2:], track[-1][2:]) > iou:
                        track.append(d)
                        dets.remove(d)
                else:
                    break
        tracks.append(track)
    return tracks


def test_linked_tracks(spark):
    sf = "/root/testdata/sf0.01"
    shots = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in view(spark, sf, "v_boxes").collect():
        shots[r["video_id"], r["frame"] // 100][r["frame"]].append((r["frame"], r["det_id"], float(r["x1"]), float(r["y1"]), float(r["x2"]), float(r["y2"])))
    want = []
    for (video, shot), frames in shots.items():
        kept = [t for t in plain_links([sorted(frames[f]) for f in sorted(frames)], 10, 0.5) if len(t) > 2]
        want += [(video, shot, k, d[0], d[1]) for k, t in enumerate(kept) for d in t]
    got = [(r["video_id"], r["shot"], r["track"], r["frame"], r["det_id"]) for r in catalog.queries()["linked_tracks"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100


def test_refined_segments(spark, tables):
    """Each document's windows, with their own words, through refine(), which has its cases in test_linking."""
    docs = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in view(spark, tables, "v_words").collect():
        docs[r["doc_id"]][int(r["start_s"] // 10)].append((r["start_s"], r["end_s"]))
    want = []
    for doc, wins in docs.items():
        segments = [(min(s for s, _ in w), max(e for _, e in w) + 0.2, str(k % 2), w) for k, w in wins.items()]
        want += [(doc, round(s, 6), round(e, 6), who) for s, e, who in linking.refine(segments)]
    got = [(r["doc_id"], round(r["start_s"], 6), round(r["end_s"], 6), r["label"]) for r in catalog.queries()["refined_segments"](spark, tables).collect()]
    assert sorted(got) == sorted(want) and got


def test_rotated_overlaps(spark, tables):
    """Overlaps by counting points of a fine grid in both boxes."""
    gt, pred = ({r["det_id"]: r for r in view(spark, tables, v).collect()} for v in ("v_gt", "v_pred"))
    rows = catalog.queries()["rotated_overlaps"](spark, tables).collect()
    assert len(rows) == sum(g["video_id"] == p["video_id"] and g["frame"] == p["frame"] and g["category_id"] == p["category_id"] for g in gt.values() for p in pred.values())
    for r in sorted(rows, key=lambda r: -r["iou"])[:25] + rows[:10]:
        inside, sizes = [], []
        for b in (gt[r["gt_det_id"]], pred[r["dt_det_id"]]):
            w, h, t = float(b["x2"] - b["x1"]), float(b["y2"] - b["y1"]), np.radians(float(b["conf"]) * 90)
            inside.append((float(b["x1"]) + w / 2, float(b["y1"]) + h / 2, w, h, t))
            sizes.append(w * h)
        cx, cy, w, h, t = inside[0]
        u, v = np.meshgrid(*[(np.arange(700) + 0.5) / 700 - 0.5] * 2)
        x, y = cx + u * w * np.cos(t) - v * h * np.sin(t), cy + u * w * np.sin(t) + v * h * np.cos(t)
        cx, cy, w, h, t = inside[1]
        a, b = (x - cx) * np.cos(t) + (y - cy) * np.sin(t), (y - cy) * np.cos(t) - (x - cx) * np.sin(t)
        both = ((np.abs(a) <= w / 2) & (np.abs(b) <= h / 2)).mean() * sizes[0]
        assert r["iou"] == pytest.approx(both / (sum(sizes) - both), abs=4e-3)
    assert rotated.area(np.array([[0, 0], [2, 0], [2, 2], [0, 2]])) == 4


def plain_tracker(frames, new=0.7, least=0.1, delay=15, missed=8, double=8, confirm=3, alive=30):
    """Every track's whole history is kept and looked at at the end; frames are (number, detections)."""
    live, all_tracks, out, dead = [], [], [], {}
    for k, (frame, dets) in enumerate(frames):
        seen, before = set(), {t["id"]: t["box"] for t in live}
        for d, box, score in sorted(dets, key=lambda d: (-d[2], d[0])):
            over = {t["id"]: linking._iou(box, before[t["id"]]) for t in live if t["id"] in before}
            near = [t for t in live if over.get(t["id"], 0) >= least]
            if near:
                best = sorted(near, key=lambda t: (-over[t["id"]], t["id"]))[0]
                oldest = sorted(near, key=lambda t: (t["first"], t["id"]))[0]
                for t in near:
                    t["double"] += t is not best and t is not oldest
                if best["id"] not in seen:
                    seen.add(best["id"])
                    best["box"] = box
                    out.append((k, frame, best["id"], d))
            elif score >= new:
                t = {"id": len(all_tracks) + 1, "box": box, "first": frame, "double": 0, "hits": [], "left": alive}
                all_tracks.append(t)
                live.append(t)
                seen.add(t["id"])
                out.append((k, frame, t["id"], d))
        for t in list(live):
            t["hits"].append(t["id"] in seen)
            t["left"] = min(alive, t["left"] + 1) if t["hits"][-1] else t["left"] - 1
            young = frame - t["first"] < delay
            if (young and (t["hits"].count(False) >= missed or t["double"] >= double)) or t["left"] <= 0:
                live.remove(t)
                if young:
                    dead[t["id"]] = k
    # a frame comes out with the one `delay` later: what was removed until then is hidden
    return [(frame, i, d) for k, frame, i, d in out if i not in dead or dead[i] - k >= delay]


def test_track_boxes(spark, tables):
    for sf in (tables, "/root/testdata/sf0.01"):
        videos = collections.defaultdict(lambda: collections.defaultdict(list))
        for r in view(spark, sf, "v_boxes").collect():
            box = tuple(float(r[c]) for c in ("x1", "y1", "x2", "y2"))
            videos[r["video_id"]][int(r["frame"])].append((r["det_id"], box, float(r["conf"])))
        some = sorted(videos)[:2]
        want = [(v, *row) for v in some for row in plain_tracker([(f, videos[v][f]) for f in sorted(videos[v])])]
        got = [(r["video_id"], r["frame"], r["track_id"], r["det_id"]) for r in catalog.queries()["track_boxes"](spark, sf).collect()]
        assert sorted(g for g in got if g[0] in some) == sorted(want) and {g[0] for g in got} <= set(videos) and want
