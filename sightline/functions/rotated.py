"""Overlap of rotated boxes (cx, cy, w, h, angle in degrees) by clipping one against the other's sides."""

from __future__ import annotations

import numpy as np


def corners(b: np.ndarray) -> np.ndarray:
    """(4, 2) corners, counter-clockwise."""
    cx, cy, w, h, a = b
    t = np.radians(a)
    c, s = np.cos(t), np.sin(t)
    local = np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2
    return local @ np.array([[c, s], [-s, c]]) + [cx, cy]


def clip(poly: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The part of a convex polygon to the left of the line p -> q."""
    if not len(poly):
        return poly
    side = (q[0] - p[0]) * (poly[:, 1] - p[1]) - (q[1] - p[1]) * (poly[:, 0] - p[0])
    out = []
    for i in range(len(poly)):
        j = (i + 1) % len(poly)
        if side[i] >= 0:
            out.append(poly[i])
        if (side[i] > 0 > side[j]) or (side[i] < 0 < side[j]):
            out.append(poly[i] + (poly[j] - poly[i]) * side[i] / (side[i] - side[j]))
    return np.array(out).reshape(-1, 2)


def area(poly: np.ndarray) -> float:
    if len(poly) < 3:
        return 0.0
    x, y = poly[:, 0], poly[:, 1]
    return float(abs(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1))) / 2)


def iou(a: np.ndarray, b: np.ndarray) -> float:
    poly, sides = corners(a), corners(b)
    for i in range(4):
        poly = clip(poly, sides[i], sides[(i + 1) % 4])
    inter = area(poly)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if union > 0 else 0.0
