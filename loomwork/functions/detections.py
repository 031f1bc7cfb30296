"""Detections of one image: checks, clipping, flags and review buckets.

A detection is a struct (x1, y1, x2, y2, score, class_id); an image has an array of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.boxes import oriented_point
from loomwork.functions.scalars import case

INVALID, WRONG_CLASS, POOR = "invalid_model_detection", "unexpected_model_class", "possible_poor_localization"


def finite(*cols: Column) -> Column:
    """Whether all values are numbers, neither NaN nor infinite; null is not."""
    inf = F.lit(float("inf"))
    out = F.lit(True)
    for c in cols:
        c = c.cast("double")
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < inf), F.lit(False))
    return out


def clipped(d: Column, width: Column, height: Column) -> list[Column]:
    cut = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    return [cut(d["x1"], width), cut(d["y1"], height), cut(d["x2"], width), cut(d["y2"], height)]


def rejected_for(d: Column, width: Column, height: Column, known: int = 0) -> Column:
    """Why a detection is rejected, or null: not finite, score outside 0..1, another class, no area after clipping."""
    x1, y1, x2, y2 = clipped(d, width, height)
    number = finite(d["x1"], d["y1"], d["x2"], d["y2"], d["score"])
    return F.when(~number | ~d["score"].between(0, 1), INVALID).when(d["class_id"] != known, WRONG_CLASS).when((x2 <= x1) | (y2 <= y1), INVALID)


def placed(d: Column, width: Column, height: Column) -> Column:
    """A valid detection clipped to its image, with localization flags: clipped, tiny (under 8 pixels or 1 %), at the edge (within 1 pixel)."""
    x1, y1, x2, y2 = box = clipped(d, width, height)
    moved = (x1 != d["x1"]) | (y1 != d["y1"]) | (x2 != d["x2"]) | (y2 != d["y2"])
    tiny = (x2 - x1 < F.greatest(F.lit(8.0), width * 0.01)) | (y2 - y1 < F.greatest(F.lit(8.0), height * 0.01))
    edge = (x1 <= 1) | (y1 <= 1) | (x2 >= width - 1) | (y2 >= height - 1)
    flags = F.array_compact(F.array(F.when(moved, F.lit("out_of_bounds_clipped")), F.when(tiny, F.lit("tiny_box")), F.when(edge, F.lit("edge_box"))))
    return F.struct((-d["score"]).alias("order"), F.array(*box).alias("xyxy"), d["score"].alias("score"), flags.alias("localization_flags"))


def sanitised(detections: Column, width: Column, height: Column, known: int = 0) -> Column:
    """struct(detections sorted by falling score and then box, rejected, flags sorted)."""
    reason = lambda d: rejected_for(d, width, height, known)
    good = F.array_sort(F.transform(F.filter(detections, lambda d: reason(d).isNull()), lambda d: placed(d, width, height)))
    bad = F.filter(F.transform(detections, reason), lambda r: r.isNotNull())
    poor = F.when(F.exists(good, lambda d: F.size(d["localization_flags"]) > 0), F.array(F.lit(POOR))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.transform(good, lambda d: d.dropFields("order")).alias("detections"), F.size(bad).alias("rejected"), F.array_sort(F.array_union(F.array_distinct(bad), poor)).alias("flags"))


def bucket_of(score: Column, error: Column | None = None, rejected: Column | None = None) -> Column:
    """struct(bucket, reason) of an image's best score; an error and rejected detections go first."""
    first = [(error.isNotNull() & (error != ""), F.lit("recheck_needed"), F.lit("error"))] if error is not None else []
    if rejected is not None:
        first.append((rejected > 0, F.lit("recheck_needed"), F.lit(INVALID)))
    steps = [
        *first,
        (score.isNull(), F.lit("recheck_needed"), F.lit("no_detection_above_floor")),
        (score > 0.80, F.lit("passed"), F.lit("score_above_0.80")),
        (score >= 0.50, F.lit("probably_passed"), F.lit("score_0.50_to_0.80")),
        (score > 0.20, F.lit("recheck_needed"), F.lit("score_above_0.20_below_0.50")),
    ]
    name = case([(c, b) for c, b, _ in steps], "recheck_needed")
    return F.struct(name.alias("bucket"), case([(c, r) for c, _, r in steps], "score_at_or_below_0.20").alias("reason"))


def review_flags(clean: Column, error: Column | None = None) -> Column:
    """Sorted review flags of an image from what sanitised() gives."""
    n = F.size(clean["detections"])
    more = [F.when(n > 0, F.lit("species_label_provisional_per_box")).otherwise(F.lit("no_detection_review")), F.when(n > 1, F.lit("multiple_detections")), F.when(clean["rejected"] > 0, F.lit("invalid_model_detection_review"))]
    if error is not None:
        more.append(F.when(error.isNotNull() & (error != ""), F.lit("inference_error_review")))
    return F.array_sort(F.array_union(clean["flags"], F.array_compact(F.array(*more))))


def volume_flags(areas: Column, reason: Column) -> dict[str, Column]:
    """The ten flags of small or many boxes and the two composite ones. areas: array of struct(score, area share), best score first."""
    count = lambda floor: F.size(F.filter(areas, lambda d: d["score"] >= floor))
    top = F.try_element_at(areas, F.lit(1))["area"]
    below = lambda share: F.exists(areas, lambda d: (d["score"] >= 0.20) & (d["area"] < share))
    small = lambda share: F.coalesce(top < share, F.lit(False))
    out = {
        "more_than_three_0.20": count(0.20) > 3, "more_than_three_0.05": count(0.05) > 3,
        "top_below_0.1pct": small(0.001), "top_below_0.5pct": small(0.005), "top_below_1pct": small(0.01),
        "any_0.20_below_0.1pct": below(0.001), "any_0.20_below_0.5pct": below(0.005), "any_0.20_below_1pct": below(0.01),
        "zero_0.20_boxes": count(0.20) == 0, "invalid_detection": F.coalesce(reason == INVALID, F.lit(False)),
    }
    out["small_or_many_priority"] = out["any_0.20_below_0.5pct"] | out["more_than_three_0.20"]
    out["small_or_many_watchlist"] = out["any_0.20_below_1pct"] | out["more_than_three_0.20"]
    return out


def best_predictions(detections: Column, floor: float = 0.0001, most: int = 100) -> Column:
    """An image's detections of at least `floor`, best first, at most `most`. detections: array of struct beginning with score."""
    ranked = F.array_sort(F.filter(detections, lambda d: d["score"] >= floor), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    return F.slice(ranked, 1, most)


def repaired_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct of the corners in order, and whether they were reversed."""
    return F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"), ((x1 > x2) | (y1 > y2)).alias("reversed"))


def transformed_box(box: tuple[Column, Column, Column, Column], width: Column, height: Column, orientation: Column, out_width: Column, out_height: Column, tolerance: float = 0.05, least: float = 0.5) -> Column:
    """array(x, y, w, h) after orientation and scaling, clipped and rounded to 4 places; null outside the image or below `least`."""
    x, y, w, h = (c.cast("double") for c in box)
    inside = finite(x, y, w, h) & (x >= -tolerance) & (y >= -tolerance) & (w > 0) & (h > 0) & (x + w <= width + tolerance) & (y + h <= height + tolerance)
    left, top = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    w, h = F.least(w, width - left), F.least(h, height - top)
    points = [oriented_point(a, b, width, height, orientation) for a in (left, left + w) for b in (top, top + h)]
    turned = orientation.isin(5, 6, 7, 8)
    xs = [p[0] * out_width / F.when(turned, height).otherwise(width) for p in points]
    ys = [p[1] * out_height / F.when(turned, width).otherwise(height) for p in points]
    x1, x2 = F.greatest(F.lit(0.0), F.least(*xs)), F.least(out_width.cast("double"), F.greatest(*xs))
    y1, y2 = F.greatest(F.lit(0.0), F.least(*ys)), F.least(out_height.cast("double"), F.greatest(*ys))
    return F.when(inside & (x2 - x1 > least) & (y2 - y1 > least), F.array(*(F.round(v, 4) for v in (x1, y1, x2 - x1, y2 - y1))))


def candidate_box(box: tuple[Column, Column, Column, Column], width: Column, height: Column, least: float = 0.5) -> Column:
    """struct(x, y, w, h, area) of an xywh box: origin raised to 0, size cut at the edge, rounded to 2 places; null where a side is at most `least`."""
    x, y = F.greatest(box[0], F.lit(0.0)), F.greatest(box[1], F.lit(0.0))
    w, h = F.round(F.least(box[2], width - x), 2), F.round(F.least(box[3], height - y), 2)
    return F.when((w > least) & (h > least), F.struct(F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), w.alias("w"), h.alias("h"), F.round(w * h, 2).alias("area")))


def yolo_line_problem(line: Column, classes: int = 11, tolerance: float = 0.0) -> Column:
    """Why a label line 'class cx cy w h' is invalid, or null."""
    v = F.transform(F.split(F.trim(line), r"\s+"), lambda s: s.try_cast("double"))
    c, x, y, w, h = (F.try_element_at(v, F.lit(k)) for k in range(1, 6))
    whole = (c == F.floor(c)) & (c >= 0) & (c < classes)
    inside = (w > 0) & (w <= 1 + tolerance) & (h > 0) & (h <= 1 + tolerance) & (x - w / 2 >= -tolerance) & (x + w / 2 <= 1 + tolerance) & (y - h / 2 >= -tolerance) & (y + h / 2 <= 1 + tolerance)
    return F.when(F.size(v) != 5, "fields").when(~finite(c, x, y, w, h), "number").when(~whole, "class").when(~inside, "geometry")


def geometry(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Dense derived columns of an xywh box."""
    return {"area": w * h, "aspect": F.when(h != 0, w / h), "cx": x + w / 2, "cy": y + h / 2, "relative_area": w * h / (width * height)}
