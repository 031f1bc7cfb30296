"""Readers of manifests, annotation documents, result files and image folders."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators import gates


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a broken line fails the read (broken_lines says where)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, value) of text files, from 1 within each file.

    Rows of a block are read in order, so their running ids tell the place within the block;
    the blocks of a file are then put in order of their start (one row a block).
    """
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = rows.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.join(blocks, ["path", "block"]).select("path", (F.col("begin") + F.col("id") - F.col("first") + 1).alias("line_number"), "value")


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line_number, value) of the lines that are no JSON object of the schema."""
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return numbered_lines(spark, path).where(F.trim("value") != "").withColumn("p", parsed).where("p is null or p._broken is not null").drop("p")


def read_keyed_jsonl(spark: SparkSession, path: str, schema: str, key: str, required: list[str] | None = None) -> DataFrame:
    """read_jsonl, with a key that is neither empty nor repeated and required fields that are there; raises otherwise."""
    rows = read_jsonl(spark, path, schema)
    present = F.lit(True)
    for c in required or []:
        present = present & F.col(c).isNotNull()
    gates.require(gates.report([gates.holds(rows, key, F.trim(F.col(key).cast("string")) != "", "empty_key"), gates.unique_key(rows, key), gates.holds(rows, key, present, "required")]))
    return rows


def read_latest(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One row a key: the last line wins."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "").select("path", "line_number", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return rows.groupBy(F.col(f"r.{key}")).agg(F.max_by("r", F.struct("path", "line_number")).alias("r")).select("r.*")


def read_table(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """CSV with a header, names stripped; every value a string, or of the type its column allows."""
    df = spark.read.option("header", True).option("inferSchema", typed).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


#: The fields of an annotation document.
COCO = (
    "categories array<struct<id:long,name:string,supercategory:string>>, images array<struct<id:long,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>>"
)


def read_coco(spark: SparkSession, path: str, split: str, category_ids: list[int] | None = None) -> dict[str, DataFrame]:
    """categories, images and annotations of one document, each with its split; other category ids than the given ones raise."""
    document = spark.read.schema(COCO).option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = {k: document.select(F.explode(k).alias("x")).select("x.*").withColumn("split", F.lit(split)) for k in ("categories", "images", "annotations")}
    if category_ids is not None:
        gates.require(gates.category_schema(out["categories"], category_ids, [split]))
    return out


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """(filename, label, xmin, ymin, xmax, ymax) of VOC XML files."""
    schema = "filename string, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    each = rows.select("filename", F.explode("object").alias("o"))
    return each.select("filename", F.col("o.name").alias("label"), "o.bndbox.xmin", "o.bndbox.ymin", "o.bndbox.xmax", "o.bndbox.ymax")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def list_files(spark: SparkSession, path: str, extensions: str = "jpe?g|png|webp") -> DataFrame:
    """(path, length) of the files with these extensions in any case; no file is opened."""
    return _files(spark, path).select("path", "length").where(F.col("path").rlike(rf"(?i)\.({extensions})$"))


def list_folders(spark: SparkSession, path: str, besides: str | None = None) -> DataFrame:
    """(folder): the folders right below path that hold files, but for one name; no file is opened."""
    below = F.regexp_extract("path", rf"{path.rstrip('/').split('/')[-1]}/([^/]+)/", 1)
    names = _files(spark, path).select(below.alias("folder")).where("folder <> ''").distinct()
    return names.where(F.col("folder") != besides) if besides else names


def read_folder(spark: SparkSession, path: str, extensions: str = "jpe?g|png|webp") -> DataFrame:
    """(path, length, sha256, kind) of every file below a folder; kind: image, rendered, xml or other."""
    name = F.lower("path")
    kind = F.when(name.contains("-rendered"), "rendered").when(name.rlike(rf"\.({extensions})$"), "image").when(name.endswith(".xml"), "xml").otherwise("other")
    return _files(spark, path).select("path", "length", F.sha2("content", 256).alias("sha256"), kind.alias("kind"))


def image_size(data: bytes) -> tuple[str | None, int | None, int | None, str | None]:
    """(format, width, height, error) from an image's header."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("PNG", *struct.unpack(">II", data[16:24]), None)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("GIF", *struct.unpack("<HH", data[6:10]), None)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                return "WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), None
            if kind == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), None
            return "WEBP", *(x & 0x3FFF for x in struct.unpack("<HH", data[26:30])), None
        if data[:2] == b"\xff\xd8":
            at = 2
            while True:
                mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if data[at] != 0xFF:
                    return "JPEG", None, None, "no frame header"
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "JPEG", width, height, None
                at += 2 + size
        return None, None, None, "unknown format"
    except (struct.error, IndexError):
        return None, None, None, "truncated"


def probe_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, width, height, error) of every file below a folder that has bytes, from its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [image_size(b or b"") for b in batch.column(1).to_pylist()]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], names=["path", "format", "width", "height", "error"])

    # headers lie in the first 64 KiB, so no more of a file goes to Python
    return _files(spark, path).select("path", F.substring("content", 1, 1 << 16).alias("content")).mapInArrow(run, "path string, format string, width int, height int, error string")


def read_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One row for each result file of a pattern, with its path."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("path", F.input_file_name())


def newest_run(runs: DataFrame, fingerprint: str) -> DataFrame:
    """(path, name) of the last completed run, by name, of a fingerprint. runs: (path, name, fingerprint, completed)."""
    own = runs.where((F.col("fingerprint") == fingerprint) & F.col("completed"))
    return own.agg(F.max(F.struct("name", "path")).alias("m")).where("m is not null").select("m.path", "m.name")
