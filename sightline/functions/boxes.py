"""Box arithmetic as column expressions. Boxes are four columns; xyxy unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> Box:
    """The four columns of a box whose names share a prefix."""
    a, b, c, d = (F.col(prefix + n) for n in names)
    return a, b, c, d


def xyxy_to_xywh(b: Box) -> Box:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def xywh_to_xyxy(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def xyxy_to_cxcywh(b: Box) -> Box:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def cxcywh_to_xyxy(b: Box) -> Box:
    return b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2


def xywh_to_cxcywh(b: Box) -> Box:
    return xyxy_to_cxcywh(xywh_to_xyxy(b))


def cxcywh_to_xywh(b: Box) -> Box:
    return xyxy_to_xywh(cxcywh_to_xyxy(b))


def normalize(b: Box, width: Column, height: Column) -> Box:
    return b[0] / width, b[1] / height, b[2] / width, b[3] / height


def scale(b: Box, sx: float | Column, sy: float | Column) -> Box:
    return b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy


def clip(b: Box, width: float | Column, height: float | Column) -> Box:
    bound = lambda c, top: F.greatest(F.least(c, F.lit(top) if not isinstance(top, Column) else top), F.lit(0.0))
    return bound(b[0], width), bound(b[1], height), bound(b[2], width), bound(b[3], height)


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def non_empty(b: Box, least: float = 0.0) -> Column:
    return (b[2] - b[0] > least) & (b[3] - b[1] > least)


def inside(b: Box, width: float, height: float, margin: float = 0.0) -> Column:
    return (b[0] >= -margin) & (b[1] >= -margin) & (b[2] < width + margin) & (b[3] < height + margin)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def union_area(a: Box, b: Box) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    return F.coalesce(F.try_divide(intersection(a, b), union_area(a, b)), F.lit(0.0))


def ioa(a: Box, b: Box) -> Column:
    """Intersection over the second box's area."""
    return F.coalesce(F.try_divide(intersection(a, b), area(b)), F.lit(0.0))


def iom(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))


def giou(a: Box, b: Box) -> Column:
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    return iou(a, b) - F.coalesce(F.try_divide(hull - union_area(a, b), hull), F.lit(0.0))


def centre_distance(a: Box, b: Box) -> Column:
    """Distance of the centres over the longest side of both boxes, sides of at least 1."""
    ca, cb = xyxy_to_cxcywh(a), xyxy_to_cxcywh(b)
    side = F.greatest(F.lit(1.0), ca[2], ca[3], cb[2], cb[3])
    return F.sqrt((ca[0] - cb[0]) ** 2 + (ca[1] - cb[1]) ** 2) / side


def euclidean_similarity(a: Box, b: Box) -> Column:
    """max(0, 1 - d / 2) for the distance d of the centres of normalized boxes."""
    ca, cb = xyxy_to_cxcywh(a), xyxy_to_cxcywh(b)
    return F.greatest(F.lit(0.0), 1 - F.sqrt((ca[0] - cb[0]) ** 2 + (ca[1] - cb[1]) ** 2) / 2)


def point_distance(x: Column, y: Column, b: Box) -> Column:
    """Distance of a point to a box, 0 inside."""
    dx = F.greatest(b[0] - x, x - b[2], F.lit(0.0))
    dy = F.greatest(b[1] - y, y - b[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def from_normalized(b: Box, width: int, height: int) -> Box:
    """A normalized xywh box in whole pixels: rounded half to even, clamped to the frame."""
    px = lambda c, top: F.least(F.greatest(F.rint(c).cast("int"), F.lit(0)), F.lit(top))
    return px(b[0] * width, width - 1), px(b[1] * height, height - 1), px((b[0] + b[2]) * width, width), px((b[1] + b[3]) * height, height)


def normalize_angle(angle: Column) -> Column:
    """Degrees in [-180, 180)."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def rotated_to_xyxy(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Box:
    """The upright hull of a rotated box."""
    t = F.radians(angle)
    c, s = F.abs(F.cos(t)), F.abs(F.sin(t))
    hw, hh = (c * w + s * h) / 2, (s * w + c * h) / 2
    return cx - hw, cy - hh, cx + hw, cy + hh


def named(b: Box, names: tuple[str, ...] = ("x1", "y1", "x2", "y2"), prefix: str = "") -> list[Column]:
    return [c.alias(prefix + n) for c, n in zip(b, names, strict=True)]
