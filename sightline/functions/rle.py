"""Run-length masks: column-major counts that begin with a run of zeros, and set operations on them without rasters."""

from __future__ import annotations

import numpy as np

Counts = list[int]


def encode(mask: np.ndarray) -> Counts:
    flat = np.asarray(mask, bool).ravel(order="F")
    if not len(flat):
        return []
    cut = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    runs = np.diff(np.concatenate([[0], cut, [len(flat)]])).tolist()
    return [0, *runs] if flat[0] else runs


def decode(counts: Counts, height: int, width: int) -> np.ndarray:
    flat = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
    if len(flat) != height * width:
        raise ValueError("counts don't fill the mask")
    return flat.reshape((height, width), order="F")


def spans(counts: Counts) -> np.ndarray:
    """(n, 2) starts and ends of the runs of ones."""
    ends = np.cumsum(counts)
    s, e = ends[0::2][: len(counts) // 2], ends[1::2]
    return np.stack([s, e], 1)[e > s] if len(e) else np.zeros((0, 2), int)


def area(counts: Counts) -> int:
    return int(sum(counts[1::2]))


def bounds(counts: Counts, height: int) -> tuple[int, int, int, int]:
    """x1, y1, x2, y2 with exclusive ends; zeros for an empty mask."""
    s = spans(counts)
    if not len(s):
        return 0, 0, 0, 0
    x1, x2 = int(s[0, 0] // height), int((s[-1, 1] - 1) // height) + 1
    whole = (s[:, 0] // height) != ((s[:, 1] - 1) // height)
    if whole.any():
        return x1, 0, x2, height
    return x1, int((s[:, 0] % height).min()), x2, int(((s[:, 1] - 1) % height).max()) + 1


def intersection(a: Counts, b: Counts) -> int:
    """Pixels of both masks, by a sweep over their runs."""
    p, q = spans(a), spans(b)
    if not len(p) or not len(q):
        return 0
    edges = np.unique(np.concatenate([p.ravel(), q.ravel()]))
    mid = edges[:-1]
    within = lambda s: (np.searchsorted(s[:, 0], mid, "right") - np.searchsorted(s[:, 1], mid, "right")) > 0
    return int(np.diff(edges)[within(p) & within(q)].sum())


def iou(a: Counts, b: Counts) -> float:
    """Intersection over union, the union counted as 1 at least."""
    i = intersection(a, b)
    return i / max(1, area(a) + area(b) - i)


def masklet_iou(a: list[Counts | None], b: list[Counts | None]) -> float:
    """Summed intersection over summed union of two masks through time; 1 where both are empty throughout."""
    inter = union = 0
    for p, q in zip(a, b, strict=True):
        i = intersection(p or [], q or [])
        inter += i
        union += area(p or []) + area(q or []) - i
    return inter / union if union else 1.0


def union(masks: list[Counts], size: int) -> Counts:
    """The mask of all pixels in any of the masks of `size` pixels."""
    flat = np.zeros(size + 1, int)
    for m in masks:
        s = spans(m)
        np.add.at(flat, s[:, 0], 1)
        np.add.at(flat, s[:, 1], -1)
    return encode((np.cumsum(flat[:-1]) > 0)[:, None])


def from_box(x1: int, y1: int, x2: int, y2: int, height: int, width: int) -> Counts:
    """A filled box as runs."""
    x1, x2, y1, y2 = max(0, x1), min(width, x2), max(0, y1), min(height, y2)
    if x2 <= x1 or y2 <= y1:
        return [height * width]
    if y2 - y1 == height:
        return [x1 * height, (x2 - x1) * height, (width - x2) * height][: 3 if x2 < width else 2]
    out = [x1 * height + y1]
    for k in range(x2 - x1):
        out.append(y2 - y1)
        if k < x2 - x1 - 1:
            out.append(height - (y2 - y1))
    rest = height * width - sum(out)
    return [*out, rest] if rest else out


def compress(counts: Counts) -> str:
    """The printable form: differences to the count two before, five bits a character."""
    out = []
    for i, c in enumerate(counts):
        x = int(c) - (int(counts[i - 2]) if i > 2 else 0)
        more = True
        while more:
            bits = x & 0x1F
            x >>= 5
            more = not (x == 0 and not bits & 0x10 or x == -1 and bits & 0x10)
            out.append(chr((bits | 0x20 if more else bits) + 48))
    return "".join(out)


def expand(text: str) -> Counts:
    out: Counts = []
    at = 0
    while at < len(text):
        x = k = 0
        more = True
        while more:
            c = ord(text[at]) - 48
            x |= (c & 0x1F) << (5 * k)
            more = bool(c & 0x20)
            at, k = at + 1, k + 1
            if not more and c & 0x10:
                x |= -1 << (5 * k)
        out.append(x + out[-2] if len(out) > 2 else x)
    return out


def dilate(mask: np.ndarray, steps: int) -> np.ndarray:
    """The mask grown by one pixel to four sides, `steps` times."""
    m = np.asarray(mask, bool)
    for _ in range(steps):
        g = m.copy()
        g[1:] |= m[:-1]
        g[:-1] |= m[1:]
        g[:, 1:] |= m[:, :-1]
        g[:, :-1] |= m[:, 1:]
        m = g
    return m


def boundary(mask: np.ndarray) -> np.ndarray:
    """Pixels of the mask with a neighbour outside of it or beyond the frame."""
    m = np.pad(np.asarray(mask, bool), 1)
    inner = m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
    return m[1:-1, 1:-1] & ~inner


def boundary_f(found: np.ndarray, truth: np.ndarray, reach: int = 1) -> float:
    """F-measure of boundaries within `reach` pixels of each other; empty against empty is 1."""
    a, b = boundary(found), boundary(truth)
    if not a.any() and not b.any():
        return 1.0
    if not a.any() or not b.any():
        return 0.0
    p, r = (a & dilate(b, reach)).sum() / a.sum(), (b & dilate(a, reach)).sum() / b.sum()
    return float(2 * p * r / (p + r)) if p + r else 0.0


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels from 1, sizes by label) of the eight-connected parts, by union-find over the runs of rows."""
    m = np.asarray(mask, bool)
    parent: list[int] = []
    runs: list[list[tuple[int, int, int]]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for y in range(m.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], m[y].astype(np.int8), [0]])))
        row = []
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            parent.append(len(parent))
            row.append((int(s), int(e), len(parent) - 1))
            for ps, pe, k in runs[-1] if runs else []:
                if ps <= e and s <= pe:
                    parent[find(row[-1][2])] = find(k)
        runs.append(row)
    names: dict[int, int] = {}
    labels = np.zeros(m.shape, np.int32)
    for y, row in enumerate(runs):
        for s, e, k in row:
            labels[y, s:e] = names.setdefault(find(k), len(names) + 1)
    return labels, np.bincount(labels.ravel(), minlength=len(names) + 1)[1:]


def clean(mask: np.ndarray, most: int) -> np.ndarray:
    """Holes and specks of at most `most` pixels filled and removed."""
    m = np.asarray(mask, bool).copy()
    labels, sizes = components(~m)
    for k in np.flatnonzero(sizes <= most):
        m[labels == k + 1] = True
    labels, sizes = components(m)
    for k in np.flatnonzero(sizes <= most):
        m[labels == k + 1] = False
    return m
