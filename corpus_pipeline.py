"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage is (spark, docs, sf_dir) -> DataFrame.  All but the last return the columns
of documents; the last returns the shard of every document that is left.  Further columns
of documents, whatever their names, go along; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.decontaminate import drop_contaminated
from loomwork.llm.minhash import drop_near_duplicates
from loomwork.llm.mixing import mixed
from loomwork.llm.repetition import drop_repetitive
from loomwork.llm.sharding import shard_documents
from loomwork.store import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go; null and empty texts are rejected (fewer than 20 words)."""
    return drop_repetitive(docs)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, of rows that repeat too; rows without words all stay; null ids count as ids do."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, those with a null id too; null and empty texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight says; a null source is the source ''."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every row that is left, repeated rows one by one, equal texts together."""
    return shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_documents),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
    ("sharding", sharding),
]

#: Minhash classes feed a hash-ordered mix and a sequential schedule, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out = out.withColumns({c: out[c].cast("string") for c, kind in out.dtypes if kind == "void"})
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
