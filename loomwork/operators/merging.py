"""Boxes of one image against each other: merged overlaps, and one-to-one reuse of near-equal boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _roots(boxes: np.ndarray, kinds: np.ndarray, barred: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest index that overlaps above the threshold reach, within a kind. boxes: corners."""
    low, high = np.maximum(boxes[:, None, :2], boxes[None, :, :2]), np.minimum(boxes[:, None, 2:], boxes[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(2)
    area = (boxes[:, 2:] - boxes[:, :2]).prod(1)
    union = area[:, None] + area[None, :] - both
    near = np.divide(both, union, out=np.zeros_like(both), where=union != 0) > threshold
    near &= (kinds[:, None] == kinds[None, :]) & ~barred[:, None] & ~barred[None, :]
    near |= np.eye(len(boxes), dtype=bool)
    root = np.arange(len(boxes))
    while True:
        lower = np.where(near, root[None, :], len(root)).min(1)
        if (lower == root).all():
            return root
        root = lower


def merged_boxes(boxes: DataFrame, winner: list[Column], threshold: float = 0.80, barred: Column | None = None) -> DataFrame:
    """One row for each component of overlapping boxes: image_id, ann_id, label and score of the winner (first in the
    order `winner`, then by id), x1, y1, x2, y2 of the union, flags (their union), members (ids, sorted).

    boxes: (image_id, ann_id, label, x1, y1, x2, y2, score, flags).  Boxes of one image and label belong together where
    a chain of overlaps above the threshold joins them; barred boxes stay alone.  An image is one row while its
    components are found, so an image's boxes must fit a task, as they do by nature.
    """
    bar = F.coalesce(barred, F.lit(False)) if barred is not None else F.lit(False)
    kinds = dict(boxes.dtypes)
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(*winner, "ann_id"))
    listed = boxes.select("image_id", F.struct(place.alias("place"), F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))).alias("box"), F.hash("label").alias("kind"), bar.alias("barred"), "ann_id", "label", F.col("score").cast("double").alias("score"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags")).alias("b"))
    images = listed.groupBy("image_id").agg(F.array_sort(F.collect_list("b")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, roots, begin = lists.flatten(), [], 0
            corners = np.asarray(flat.field("box").flatten()).reshape(-1, 4)
            kind, barred = flat.field("kind").to_numpy(), flat.field("barred").to_numpy(zero_copy_only=False)
            for n in lists.value_lengths().to_pylist():
                roots.append(_roots(corners[begin : begin + n], kind[begin : begin + n], barred[begin : begin + n], threshold))
                begin += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.list_(pa.int32()))], names=["image_id", "b", "root"])

    rooted = images.mapInArrow(run, f"image_id {kinds['image_id']}, b {dict(images.dtypes)['b']}, root array<int>")
    # the root is the component's first box in the winner's order
    parts = F.transform(F.array_distinct("root"), lambda r: F.struct(F.element_at("b", r + 1).alias("best"), F.filter("b", lambda x, i: F.element_at("root", i + 1) == r).alias("all")))
    each = rooted.select("image_id", F.explode(parts).alias("p"))
    side = lambda k, f: f(F.transform("p.all", lambda x: F.element_at(x["box"], k)))
    return each.select("image_id", "p.best.ann_id", "p.best.label", "p.best.score", side(1, F.array_min).alias("x1"), side(2, F.array_min).alias("y1"), side(3, F.array_max).alias("x2"), side(4, F.array_max).alias("y2"), F.array_sort(F.array_distinct(F.flatten(F.transform("p.all", lambda x: x["flags"])))).alias("flags"), F.array_sort(F.transform("p.all", lambda x: x["ann_id"])).alias("members"))


def reused_ids(new: DataFrame, old: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """new with old_id: each old box of the same image and label whose x, y, w, h differ by less than the tolerance is
    used once.  New boxes go in the order of `pos` and take the first free old one by id.

    new: (image_id, pos, label, x, y, w, h); old: (image_id, ann_id, label, x, y, w, h).  Near boxes are joined on
    rounded origins (own and neighbouring cells); chains of choices live within an image's few candidates.
    """
    cell = lambda v: F.floor(v / (2 * tolerance)).cast("long")
    around = lambda v: F.explode(F.array_distinct(F.array(cell(v - tolerance), cell(v + tolerance))))
    o = old.select(F.col("image_id").alias("oi"), F.col("label").alias("ol"), F.col("ann_id"), *[F.col(c).alias(f"o{c}") for c in "xywh"]).withColumn("oc", cell(F.col("ox")))
    near = new.withColumn("cell", around(F.col("x"))).join(o, (F.col("image_id") == F.col("oi")) & (F.col("label") == F.col("ol")) & (F.col("cell") == F.col("oc")))
    for c in "xywh":
        near = near.where(F.abs(F.col(c) - F.col(f"o{c}")) < tolerance)
    candidates = near.groupBy("image_id", "pos").agg(F.array_sort(F.collect_set("ann_id")).alias("ids"))
    per_image = candidates.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("c"))
    kind = dict(old.dtypes)["ann_id"]
    start = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("used"), F.expr(f"cast(array() as array<struct<pos:{dict(new.dtypes)['pos']},id:{kind}>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        free = F.try_element_at(F.array_except(x["ids"], a["used"]), F.lit(1))
        return F.when(free.isNull(), a).otherwise(F.struct(F.concat(a["used"], F.array(free)).alias("used"), F.concat(a["out"], F.array(F.struct(x["pos"].alias("pos"), free.alias("id")))).alias("out")))

    chosen = per_image.select("image_id", F.explode(F.aggregate("c", start, step, lambda a: a["out"])).alias("m")).select(F.col("image_id").alias("mi"), F.col("m.pos").alias("mp"), F.col("m.id").alias("old_id"))
    return new.join(chosen, (F.col("image_id") == F.col("mi")) & (F.col("pos") == F.col("mp")), "left").select(*new.columns, "old_id")
