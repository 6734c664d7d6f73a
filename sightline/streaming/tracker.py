"""A tracker that takes frames one at a time, keeps state by video and gives its output late.

Detections are matched with live tracks by IoU; unmatched ones above a score begin tracks. A track that went unmatched for
too long during its first frames, or that lies on a detection together with an older one, is removed, also from frames
that were buffered; frames come out once `delay` newer ones are in, and the rest at the end of the stream.
The same class serves a batch (grouped by video) and a stream (applyInPandasWithState).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.operators.assign import hungarian
from sightline.operators.suppress import pair_iou

OUTPUT = "video_id long, frame long, track_id long, det_id string, x1 double, y1 double, x2 double, y2 double, confirmed boolean"
COLUMNS = ["video_id", "frame", "track_id", "det_id", "x1", "y1", "x2", "y2", "confirmed"]


@dataclass
class Settings:
    """Limits of the tracker."""

    new_score: float = 0.7
    match_iou: float = 0.1
    delay: int = 15
    unmatched: int = 8
    duplicates: int = 8
    confirm: int = 3
    keep_alive: int = 30
    #: Whether tracks and detections are matched one to one by the largest sum of overlaps, and whether unconfirmed rows are hidden.
    one_to_one: bool = False
    hide_unconfirmed: bool = False


@dataclass
class Tracker:
    """State of one video; everything in it can be written as JSON."""

    settings: Settings = field(default_factory=Settings)
    next_id: int = 1
    tracks: dict[int, dict] = field(default_factory=dict)
    buffer: list[dict] = field(default_factory=list)
    removed: list[int] = field(default_factory=list)

    def step(self, frame: int, dets: list[tuple]) -> list[dict]:
        """Take a frame's detections (det_id, x1, y1, x2, y2, score); returns the frames that are due."""
        s = self.settings
        ids = sorted(self.tracks)
        boxes = np.array([self.tracks[i]["box"] for i in ids]).reshape(-1, 4)
        rows, taken = [], {}
        ranked = sorted(dets, key=lambda d: (-d[5], d[0]))
        pairs = self._paired(ranked, ids, boxes) if s.one_to_one else None
        for det_id, *box, score in ranked:
            over = pair_iou(np.array(box, float), boxes) if len(boxes) else np.zeros(0)
            near = [ids[k] for k in np.flatnonzero(over >= s.match_iou)]
            if near:
                best = max(near, key=lambda i: (over[ids.index(i)], -i)) if pairs is None else pairs.get(det_id)
                first = min(near, key=lambda i: (self.tracks[i]["first"], i))
                for i in near:
                    if i != first and i != best:
                        self.tracks[i]["double"] += 1
                if best is not None and best not in taken:
                    taken[best] = True
                    self.tracks[best] |= {"box": list(map(float, box))}
                    rows.append((best, det_id, *map(float, box)))
            elif score >= s.new_score:
                new, self.next_id = self.next_id, self.next_id + 1
                self.tracks[new] = {"box": list(map(float, box)), "first": frame, "miss": 0, "double": 0, "streak": 0, "ok": False, "alive": s.keep_alive}
                taken[new] = True
                rows.append((new, det_id, *map(float, box)))
        for i in list(self.tracks):
            t = self.tracks[i]
            if i in taken:
                t["streak"], t["alive"] = t["streak"] + 1, min(s.keep_alive, t["alive"] + 1)
                t["ok"] = t["ok"] or t["streak"] >= s.confirm
            else:
                t["miss"], t["streak"], t["alive"] = t["miss"] + 1, 0, t["alive"] - 1
            young = frame - t["first"] < s.delay
            if (young and (t["miss"] >= s.unmatched or t["double"] >= s.duplicates)) or t["alive"] <= 0:
                if young:
                    self.removed.append(i)
                del self.tracks[i]
        self.buffer.append({"frame": frame, "rows": rows, "ok": {i: t["ok"] for i, t in self.tracks.items()}})
        return self._out(len(self.buffer) - s.delay)

    def _paired(self, dets: list[tuple], ids: list[int], boxes: np.ndarray) -> dict[str, int]:
        """The track of each detection in the matching of the largest sum of overlaps, of pairs that overlap enough."""
        if not dets or not ids:
            return {}
        over = np.stack([pair_iou(np.array(d[1:5], float), boxes) for d in dets])
        rows, cols = hungarian(-np.where(over >= self.settings.match_iou, over, 0.0))
        return {dets[i][0]: ids[j] for i, j in zip(rows, cols, strict=True) if over[i, j] >= self.settings.match_iou}

    def flush(self) -> list[dict]:
        return self._out(len(self.buffer))

    def _out(self, n: int) -> list[dict]:
        out, gone = [], set(self.removed)
        for entry in self.buffer[: max(0, n)]:
            out += [{"frame": entry["frame"], "track_id": i, "det_id": d, "x1": a, "y1": b, "x2": c, "y2": e, "confirmed": bool(self.tracks.get(i, {}).get("ok", entry["ok"].get(i, False)))} for i, d, a, b, c, e in entry["rows"] if i not in gone]
        if self.settings.hide_unconfirmed:
            out = [r for r in out if r["confirmed"]]
        del self.buffer[: max(0, n)]
        held = {r[0] for entry in self.buffer for r in entry["rows"]}
        self.removed = [i for i in self.removed if i in held]
        return out

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> Tracker:
        d = json.loads(text)
        return cls(Settings(**d["settings"]), d["next_id"], {int(k): v for k, v in d["tracks"].items()}, [{"frame": b["frame"], "rows": [tuple(r) for r in b["rows"]], "ok": {int(k): v for k, v in b["ok"].items()}} for b in d["buffer"]], d["removed"])


def _frames(g: pd.DataFrame) -> Iterator[tuple[int, list[tuple]]]:
    g = g.sort_values("frame")
    rows = zip(*(g[c].tolist() for c in ("frame", "det_id", "x1", "y1", "x2", "y2", "conf")), strict=True)
    for frame, f in groupby(rows, key=lambda r: r[0]):
        yield int(frame), [r[1:] for r in f]


def track(dets: DataFrame, settings: Settings | None = None) -> DataFrame:
    """All frames of each video through one tracker, in order."""
    own = settings or Settings()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t, rows = Tracker(own), []
        for frame, d in _frames(g):
            rows += t.step(frame, d)
        out = pd.DataFrame(rows + t.flush(), columns=COLUMNS[1:])
        out.insert(0, "video_id", int(g["video_id"].iloc[0]))
        return out

    return dets.select("video_id", "frame", "det_id", "x1", "y1", "x2", "y2", "conf").groupBy("video_id").applyInPandas(run, OUTPUT)


def track_stream(dets: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The same over a stream whose batches bring later frames; a row with frame -1 ends its video."""
    own = settings or Settings()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Tracker.load(state.get[0]) if state.exists else Tracker(own)
        g = pd.concat(list(parts))
        rows, ended = [], bool((g["frame"] < 0).any())
        for frame, d in _frames(g[g["frame"] >= 0]):
            rows += t.step(frame, d)
        if ended:
            rows += t.flush()
        state.update((t.dump(),))
        out = pd.DataFrame(rows, columns=COLUMNS[1:])
        out.insert(0, "video_id", key[0])
        yield out.astype({"video_id": "int64", "frame": "int64", "track_id": "int64", "confirmed": "bool"}) if len(out) else out

    chosen = dets.select("video_id", "frame", "det_id", "x1", "y1", "x2", "y2", "conf")
    return chosen.groupBy("video_id").applyInPandasWithState(run, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)
