"""Box expressions. A box is four columns: (x, y, w, h) or corners (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def corners(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of corner boxes; 0 where the union has no area."""
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    both = width * height
    area = lambda c: F.greatest(c[2] - c[0], F.lit(0.0)) * F.greatest(c[3] - c[1], F.lit(0.0))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def to_yolo(box: Box, width: Column, height: Column) -> Box:
    """Normalised centre and size of an xywh box."""
    x, y, w, h = box
    return (x + w / 2) / width, (y + h / 2) / height, w / width, h / height


def inside(box: Box, width: Column, height: Column, tolerance: float = 1e-6) -> Column:
    """Whether an xywh box has an area and lies in the image; NaN fails."""
    x, y, w, h = box
    number = ~(F.isnan(x) | F.isnan(y) | F.isnan(w) | F.isnan(h))
    return number & (w > 0) & (h > 0) & (x >= -tolerance) & (y >= -tolerance) & (x + w <= width + tolerance) & (y + h <= height + tolerance)


def oriented_point(x: Column, y: Column, width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """A point after the eight EXIF orientations; others leave it alone."""
    maps = {1: (x, y), 2: (width - x, y), 3: (width - x, height - y), 4: (x, height - y), 5: (y, x), 6: (height - y, x), 7: (height - y, width - x), 8: (y, width - x)}
    px, py = x, y
    for k, (u, v) in maps.items():
        px, py = F.when(orientation == k, u).otherwise(px), F.when(orientation == k, v).otherwise(py)
    return px, py


def fit_long_side(width: Column, height: Column, limit: int = 1152) -> tuple[Column, Column, Column]:
    """(scale, width, height) with the long side at most limit and sides at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(width, height))
    side = lambda v: F.greatest(F.lit(1), F.rint(v * scale).cast("int"))
    return scale, side(width), side(height)


def clamp(box: Box, width: Column, height: Column) -> Box:
    """Origin raised to 0 without shrinking the size, then the size cut at the image's edge."""
    x, y = F.greatest(box[0], F.lit(0.0)), F.greatest(box[1], F.lit(0.0))
    return x, y, F.least(box[2], width - x), F.least(box[3], height - y)


def area_fraction(w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), w * h / (width * height))
