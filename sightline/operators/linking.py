"""Sequential operators inside one shot, segment list or video: linking, chains of merges and refinement of boundaries."""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.grouped import map_rows
from sightline.operators.suppress import XYXY


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def link(frames: list[list[tuple]], gap: int, iou: float) -> list[list[tuple]]:
    """Tracks from detections (frame, det_id, x1, y1, x2, y2), frame by frame.

    A track begins with the first detection left and takes, in each later frame, a detection that overlaps its last one by
    more than `iou`, while not more than `gap` frames lie between. When a detection is taken the one after it in its frame
    isn't looked at again in that pass: results depend on this, so it is kept.
    """
    left = [list(f) for f in frames]
    tracks = []
    while True:
        track: list[tuple] = []
        for f in left:
            k = 0
            while k < len(f):
                d = f[k]
                if not track:
                    track.append(d)
                    del f[k]
                    k += 1
                elif d[0] - track[-1][0] <= gap:
                    if _iou(d[2:], track[-1][2:]) > iou:
                        track.append(d)
                        del f[k]
                    k += 1
                else:
                    break
            if track and f and f[0][0] - track[-1][0] > gap:
                break  # frames are in order: nothing later can be near enough
        if not track:
            return tracks
        tracks.append(track)


def link_tracks(dets: DataFrame, keys: list[str], gap: int = 10, iou: float = 0.5, least: int = 10) -> DataFrame:
    """(keys, track, frame, det_id) of the tracks longer than `least` detections in each shot."""
    def run(rows: list[tuple]) -> list[tuple]:
        frames = [list(f) for _, f in groupby(rows, key=lambda r: r[0])]
        kept = [t for t in link(frames, gap, iou) if len(t) > least]
        return [(i, d[0], d[1]) for i, t in enumerate(kept) for d in t]

    frame = dets.schema["frame"].dataType.simpleString()
    return map_rows(dets.select(*keys, "frame", "det_id", *XYXY), keys, ["frame", "det_id"], run, f"track int, frame {frame}, det_id string")


def merge_windows(rows: list[tuple[float, float, str]], near: float = 0.1) -> list[tuple[float, float, str]]:
    """Outputs of overlapping windows by (start, end), less those that repeat the last one kept: both ends within `near`."""
    out: list[tuple[float, float, str]] = []
    for s, e, who in sorted(rows):
        if out and abs(s - out[-1][0]) <= near and abs(e - out[-1][1]) <= near and who == out[-1][2]:
            continue
        out.append((s, e, who))
    return out


Segment = tuple[float, float, str, list[tuple[float, float]]]


def refine(segments: list[Segment], pad: float = 0.05, split: float = 0.25, least: float = 0.15, merge: float = 0.10, close: float = 0.12) -> list[tuple[float, float, str]]:
    """Segments (start, end, label, own words) snapped to their words; what is shorter than twice `least`, or 0.5, goes.

    Ends move to the first and last word of the segment, with a pad; a segment is split in the middle of a silence longer
    than `split` if both sides last; one without words stays as it is. Neighbours of one label with a gap of at most `merge`
    become one. Neighbours of two labels that overlap are cut in the middle of the overlap, moved so that both last if they can,
    and a gap of at most `close` between them closes in its middle.
    """
    hard = max(2 * least, 0.5)
    merged: list[list] = []
    for s, e, who in sorted((x for seg in segments for x in _snapped(*seg, pad, split, hard)), key=lambda x: x[:2]):
        if merged and merged[-1][2] == who and s - merged[-1][1] <= merge:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, who])
    out = merged[:1]
    for now in merged[1:]:
        last = out[-1]
        if now[2] == last[2]:
            if now[0] - last[1] <= merge:
                last[1] = max(last[1], now[1])
            else:
                out.append(now)
            continue
        if last[1] > now[0]:
            cut = min(max((last[1] + now[0]) / 2, last[0] + hard / 2, now[0]), last[1], now[1] - hard / 2)
            ahead, behind = max(last[0], cut), min(now[1], cut)
            if ahead - last[0] >= hard:
                last[1] = ahead
            if now[1] - behind >= hard:
                now[0] = behind
        elif now[0] - last[1] <= close:
            last[1] = now[0] = (last[1] + now[0]) / 2
        if last[1] - last[0] < hard:
            out[-1] = now
        elif now[1] - now[0] >= hard:
            out.append(now)
    return [tuple(x) for x in out]


def _snapped(start: float, end: float, who: str, words: list[tuple[float, float]], pad: float, split: float, hard: float) -> list[tuple[float, float, str]]:
    """A segment as the parts that its words and the silences between them make of it."""
    heard = sorted((a, b) for a, b in words or [] if b > a)
    if end <= start or not heard:
        return [(start, end, who)] if end > start else []
    start, end = max(start, heard[0][0] - pad), min(end, max(b for _, b in heard) + pad)
    cuts = [start]
    for (_, before), (after, _) in zip(heard, heard[1:], strict=False):
        middle = before + (after - before) / 2
        if after - before > split and middle - cuts[-1] >= hard and end - middle >= hard:
            cuts.append(middle)
    return [(a, b, who) for a, b in zip(cuts, [*cuts[1:], end], strict=True) if b - a >= hard]


def refine_segments(segments: DataFrame, key: str) -> DataFrame:
    """refine() for each key, of segments (key, start_s, end_s, label, words), words an array of structs (start_s, end_s)."""

    def run(rows: list[tuple]) -> list[tuple]:
        return refine([(s, e, who, [(w["start_s"], w["end_s"]) for w in words or []]) for s, e, who, words in rows])

    return map_rows(segments.select(key, "start_s", "end_s", "label", "words"), [key], ["start_s", "end_s", "label"], run, "start_s double, end_s double, label string")


def register(tracks: list[tuple[int, float, float, np.ndarray]], least: float = 0.6) -> list[int]:
    """Identity of each track (id, start, end, unit vector), taken in order of start.

    The first registered identity that is similar enough and whose last range doesn't overlap takes the track, and its
    range with it; otherwise the track registers a new one.
    """
    known: list[tuple[np.ndarray, float, float]] = []
    out = []
    for _, s, e, v in tracks:
        for i, (u, a, b) in enumerate(known):
            if (e <= a or s >= b) and float(u @ v) >= least:
                known[i] = (u, s, e)
                out.append(i)
                break
        else:
            known.append((v, s, e))
            out.append(len(known) - 1)
    return out


def single_linkage(sim: np.ndarray, spans: list[tuple[float, float]], link_at: float, overlap_at: float, near: np.ndarray | None = None) -> list[int]:
    """Groups of tracks: the best pair of members joins two groups, by a stricter bound (and nearness) where spans overlap."""
    n = len(sim)
    group = list(range(n))
    for x in sorted(((-sim[i, j], i, j) for i in range(n) for j in range(i + 1, n))):
        s, i, j = -x[0], x[1], x[2]
        if s < link_at or group[i] == group[j]:
            continue
        a, b = [k for k in range(n) if group[k] == group[i]], [k for k in range(n) if group[k] == group[j]]
        meet = any(min(spans[p][1], spans[q][1]) > max(spans[p][0], spans[q][0]) for p in a for q in b)
        if meet and (s < overlap_at or (near is not None and not any(near[p, q] for p in a for q in b))):
            continue
        low, high = sorted((group[i], group[j]))
        group = [low if g == high else g for g in group]
    return group


def temporal_merge(centroids: np.ndarray, spans: list[tuple[float, float]], bound: float, gap: float, strict: float, longest: float) -> list[int]:
    """Groups that never share a moment join at a relaxed bound, a stricter one beyond `gap`, never beyond `longest`."""
    n = len(centroids)
    group, span = list(range(n)), {i: spans[i] for i in range(n)}
    sim = centroids @ centroids.T
    for x in sorted(((-sim[i, j], i, j) for i in range(n) for j in range(i + 1, n))):
        s, i, j = -x[0], group[x[1]], group[x[2]]
        if i == j:
            continue
        between = max(span[i][0], span[j][0]) - min(span[i][1], span[j][1])
        if between < 0 or between > longest or s < (bound if between <= gap else strict):
            continue
        low, high = sorted((i, j))
        span[low] = min(span[i][0], span[j][0]), max(span[i][1], span[j][1])
        group = [low if g == high else g for g in group]
    return group


def minibatches(lengths: list[tuple[int, str]], budget: int) -> list[list[tuple[int, str]]]:
    """Items (length, label) from long to short in batches of as many as the first one's length leaves room for."""
    left = sorted(lengths, reverse=True)
    out = []
    while left:
        n = max(budget // max(1, left[0][0]), 1)
        out.append(left[:n])
        left = left[n:]
    return out


def merged_windows(df: DataFrame, keys: list[str], start: str, end: str, label: str, near: float = 0.1) -> DataFrame:
    """merge_windows() of each group."""
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (start, end, label))
    return map_rows(df.select(*keys, start, end, label), keys, [start, end, label], lambda rows: merge_windows(rows, near), kind)


def _vector(values: list[float]) -> np.ndarray:
    x = np.asarray(values, float)
    return x / max(float(np.linalg.norm(x)), 1e-12)


def registered(df: DataFrame, keys: list[str], track: str, start: str, end: str, vector: str, least: float = 0.6) -> DataFrame:
    """(keys, track, identity): register() of each group's tracks, identities numbered from 0."""

    def run(rows: list[tuple]) -> list[tuple]:
        found = register([(t, s, e, _vector(v)) for s, t, e, v in rows], least)
        return [(t, i) for (_, t, _, _), i in zip(rows, found, strict=True)]

    rows = df.select(*keys, start, track, end, vector)
    return map_rows(rows, keys, [start, track], run, f"{track} {df.schema[track].dataType.simpleString()}, identity int")


def linked_groups(df: DataFrame, keys: list[str], track: str, start: str, end: str, vector: str, link_at: float, overlap_at: float) -> DataFrame:
    """(keys, track, group): single_linkage() of each group's tracks; a group is named by its first track's number in order."""

    def run(rows: list[tuple]) -> list[tuple]:
        x = np.array([_vector(v) for *_, v in rows])
        found = single_linkage(x @ x.T, [(s, e) for _, s, e, _ in rows], link_at, overlap_at)
        return [(r[0], g) for r, g in zip(rows, found, strict=True)]

    return map_rows(df.select(*keys, track, start, end, vector), keys, [track], run, f"{track} {df.schema[track].dataType.simpleString()}, group int")


def joined_groups(df: DataFrame, keys: list[str], ident: str, start: str, end: str, vector: str, bound: float, gap: float, strict: float, longest: float) -> DataFrame:
    """(keys, ident, group): temporal_merge() of each video's identities, from their centroids and spans."""

    def run(rows: list[tuple]) -> list[tuple]:
        found = temporal_merge(np.array([_vector(v) for *_, v in rows]), [(s, e) for _, s, e, _ in rows], bound, gap, strict, longest)
        return [(r[0], g) for r, g in zip(rows, found, strict=True)]

    return map_rows(df.select(*keys, ident, start, end, vector), keys, [ident], run, f"{ident} {df.schema[ident].dataType.simpleString()}, group int")


def batched(df: DataFrame, keys: list[str], length: str, item: str, budget: int) -> DataFrame:
    """(keys, item, batch): minibatches() of each group's items, numbered from 0."""

    def run(rows: list[tuple]) -> list[tuple]:
        return [(i, k) for k, b in enumerate(minibatches(rows, budget)) for _, i in b]

    return map_rows(df.select(*keys, length, item), keys, [F.desc(length), F.desc(item)], run, f"{item} {df.schema[item].dataType.simpleString()}, batch int")


def key_frames(n: Column, active: Column, spread: int = 5, most: int = 15) -> Column:
    """Positions to look at among 0 .. n - 1: the active ones (three at least) and five spread ones, thinned by a stride."""
    even = F.transform(F.sequence(F.lit(0), F.lit(spread - 1)), lambda k: F.floor(k * (n - 1) / F.lit(float(spread - 1))).cast("int"))
    both = F.array_sort(F.array_distinct(F.when(F.size(active) >= 3, F.concat(active, even)).otherwise(even)))
    stride = F.greatest(F.ceil(F.size(both) / F.lit(float(most))), F.lit(1))
    return F.filter(both, lambda x, i: i % stride == 0)


def resume(chunks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks that no finished output names yet; failed ones count as unfinished."""
    return chunks.join(done.filter("error is null").select(*keys).distinct(), keys, "left_anti")


def best_annotator(scores: DataFrame, keys: list[str], annotator: str, score: str) -> DataFrame:
    """For each image the annotator of the highest score, an undefined score first, the first one on ties."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).isNull().desc(), F.desc(score), annotator)
    return scores.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def match_cost(logit: Column, l1: Column, overlap: Column, w_class: float, w_box: float, w_giou: float, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """The cost of a prediction for a target: focal class cost, box distance and negative generalized overlap."""
    p = 1 / (1 + F.exp(-logit))
    positive = alpha * (1 - p) ** gamma * -F.log(p + 1e-8)
    negative = (1 - alpha) * p**gamma * -F.log(1 - p + 1e-8)
    return w_class * (positive - negative) + w_box * l1 - w_giou * overlap
