"""Writers: JSON lines, CSV, COCO documents, YOLO labels and small summaries."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.boxes import to_yolo
from loomwork.operators import gates
from loomwork.operators.relational import numbered


def write_jsonl(df: DataFrame, path: str) -> None:
    """Columns in name order; refuses to overwrite."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(path)


def write_table(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def _filesystem(spark: SparkSession, path: str) -> tuple[object, object]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def save_json(spark: SparkSession, path: str, value: object) -> None:
    """A small summary: written beside its place and renamed, so readers see all of it or none; NaN raises."""
    data = json.dumps(value, indent=2, sort_keys=True, allow_nan=False).encode()
    target, fs = _filesystem(spark, path)
    part, _ = _filesystem(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(data)
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot rename to {path}")


def staged(spark: SparkSession, path: str, write: object, check: object = None) -> None:
    """write(folder) fills a folder beside path; check(folder), if given, returns problems; without any the folder becomes path."""
    target, fs = _filesystem(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    folder = f"{path}.stage-{uuid.uuid4().hex}"
    stage, _ = _filesystem(spark, folder)
    try:
        write(folder)
        if check is not None:
            gates.require(check(folder))
    except Exception:
        fs.delete(stage, True)
        raise
    if not fs.rename(stage, target):
        raise OSError(f"cannot rename to {path}")


def dense_ids(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """images and annotations with new ids, from 1 in file order within each split, in ranges instead of one task a split.

    images: (split, image_id, file_name, ...); annotations: (image_id, ann_id, ...).
    """
    i = numbered(images, ["split"], ["file_name", "image_id"], "id")
    a = annotations.join(i.select("image_id", "split", F.col("id").alias("new_image")), "image_id")
    return i, numbered(a, ["split"], ["new_image", "ann_id"], "id")


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(split, document): one JSON document a split, ids dense from 1 in file order.

    images: (split, image_id, file_name, width, height); annotations: (image_id, ann_id, category_id, x, y, w, h).
    The document of a split is one row by its format; coco_lines writes any size, one object a line.
    """
    i, a = dense_ids(images, annotations)
    di = i.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("id", "file_name", "width", "height"))).alias("images"))
    da = a.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("id", F.col("new_image").alias("image_id"), "category_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd")))).alias("annotations"))
    dc = categories.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("categories"))
    out = di.join(da, "split", "left").join(F.broadcast(dc))  # one row
    return out.select("split", F.to_json(F.struct("categories", "images", "annotations")).alias("document"))


def coco_lines(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(split, kind, id, value): the objects of coco_document one by one, for splits that are no single row."""
    i, a = dense_ids(images, annotations)
    box = F.struct("id", F.col("new_image").alias("image_id"), "category_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"))
    return i.select("split", F.lit("image").alias("kind"), "id", F.to_json(F.struct("id", "file_name", "width", "height")).alias("value")).union(a.select("split", F.lit("annotation"), "id", F.to_json(box)))


def export_problems(images: DataFrame, annotations: DataFrame, categories: int, splits: int = 3) -> DataFrame:
    """What must hold of an export: boxes inside their images, no pixels in two splits, every label in every split.

    images: (split, image_id, width, height, pixel_hash); annotations: (image_id, ann_id, category_id, x, y, w, h).
    """
    b = annotations.join(images.select("image_id", "split", "width", "height"), "image_id")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") + F.col("w") <= F.col("width") + 1e-4) & (F.col("y") + F.col("h") <= F.col("height") + 1e-4)
    twice = gates.one_label(images, "pixel_hash", "split", "pixels_in_two_splits")
    n = gates.row_count(b.select("category_id").distinct(), categories, "labels")
    return gates.report([gates.references(annotations, "image_id", images, "image_id", "orphan"), gates.holds(b, "ann_id", inside, "geometry"), twice, gates.every_group_has(b, "category_id", "split", splits, "labels_in_splits"), n])


def write_export(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, splits: int = 3) -> None:
    """Checked COCO documents below path, staged: path appears only when all of what must hold does."""
    gates.require(export_problems(images, annotations, categories.count(), splits))
    document = coco_document(images, annotations, categories)
    staged(images.sparkSession, path, lambda folder: document.write.partitionBy("split").text(folder))


def yolo_labels(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(split, file_name, labels): a line 'class cx cy w h' for each box, classes from 0; no boxes give an empty text."""
    a = annotations.join(images.select("image_id", "width", "height"), "image_id")
    cx, cy, w, h = to_yolo((F.col("x"), F.col("y"), F.col("w"), F.col("h")), F.col("width"), F.col("height"))
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("category_id") - 1, cx, cy, w, h)
    lines = a.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ann_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("labels"))
    return images.join(lines, "image_id", "left").select("split", "file_name", F.coalesce("labels", F.lit("")).alias("labels"))


def write_yolo(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """One label file an image below path/labels (folders split=, stem=), and path/manifest with digests; staged.

    Stems repeat in no split (a gate). Boxes outside their image raise, they are not clipped.
    """
    labels = yolo_labels(images, annotations).withColumn("stem", F.regexp_replace("file_name", r"\.[^./]+$", ""))
    rejected = annotations.join(images.select("image_id", "width", "height"), "image_id")
    inside = (F.col("w") > 0) & (F.col("h") > 0) & (F.least("x", "y") >= 0) & (F.col("x") + F.col("w") <= F.col("width") + 1e-6) & (F.col("y") + F.col("h") <= F.col("height") + 1e-6)
    name = F.concat_ws("/", "split", "stem")
    gates.require(gates.report([gates.holds(rejected, "ann_id", inside, "outside"), gates.unique_key(labels.withColumn("name", name), "name")]))

    def write(folder: str) -> None:
        labels.select("split", "stem", "file_name", F.sha2("labels", 256).alias("sha256")).write.json(f"{folder}/manifest")
        labels.select("split", "stem", F.col("labels").alias("value")).write.partitionBy("split", "stem").text(f"{folder}/labels")

    staged(images.sparkSession, path, write)


def markdown_table(rows: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A small aggregated table as Markdown; more than `most` rows raise."""
    found = rows.select(*columns).take(most + 1)
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in found)])
