"""Embedding analytics: centroids, cosine matrices, margins and label neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centroid): the mean vector of each label, scaled to length one (lengths below 1e-8 count as 1e-8)."""
    each = vectors.select(label, F.posexplode(vector).alias("dim", "v"))
    means = each.groupBy(label, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    rows = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("c"))
    norm = F.greatest(F.sqrt(dot("c", "c")), F.lit(1e-8))
    return rows.withColumn("norm", norm).select(label, F.transform("c", lambda x: x / F.col("norm")).alias("centroid"))


def similarity_matrix(means: DataFrame, label: str = "label") -> DataFrame:
    """(a, b, cosine) of every pair of labels (a table of labels squared, not of rows)."""
    all_means = means.agg(F.collect_list(F.struct(F.col(label).alias("b"), F.col("centroid").alias("v"))).alias("others"))
    each = means.join(F.broadcast(all_means)).select(F.col(label).alias("a"), "centroid", F.explode("others").alias("o"))
    return each.select("a", F.col("o.b").alias("b"), dot("centroid", "o.v").alias("cosine"))


def margins(vectors: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, own, rival, rival_label, margin): cosine to the own centroid and to the best other one."""
    means = {r[label]: np.array(r["centroid"]) for r in centroids(vectors, label, vector).collect()}  # one row a label
    names = sorted(means)
    matrix = np.array([means[k] for k in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([v or [0.0] * matrix.shape[1] for v in batch.column(2).to_pylist()], float).reshape(batch.num_rows, -1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
            s = x @ matrix.T
            at = np.array([names.index(v) for v in batch.column(1).to_pylist()], int)
            own = s[np.arange(len(at)), at]
            s[np.arange(len(at)), at] = -np.inf
            best = s.argmax(1)
            rival = s.max(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(rival), pa.array([names[k] for k in best], batch.column(1).type), pa.array(own - rival)], names=[id_col, label, "own", "rival", "rival_label", "margin"])

    kinds = dict(vectors.dtypes)
    return vectors.where(F.col(label).isNotNull()).select(id_col, label, vector).mapInArrow(run, f"{id_col} {kinds[id_col]}, {label} {kinds[label]}, own double, rival double, rival_label {kinds[label]}, margin double")


def _packed(vectors: DataFrame, id_col: str, vector: str, group: str | None, block: int) -> DataFrame:
    """Runs of rows as (ids, groups, matrix of unit vectors, width), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, block):
                part = batch.slice(begin, block)
                x = np.asarray(part.column(2).flatten()).astype(np.float32).reshape(part.num_rows, -1)
                x = x / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-8)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.string())), pa.array([x.astype(float).tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], names=["ids", "groups", "matrix", "width"])

    kind = F.col(group).cast("string") if group else F.lit(None).cast("string")
    return vectors.where(F.size(vector) > 0).select(F.col(id_col).cast("long"), kind.alias("g"), vector).mapInArrow(run, "ids array<long>, groups array<string>, matrix binary, width int")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", block: int = 2000, group: str | None = None) -> DataFrame:
    """(query, neighbour, rank, cosine): for a stated query set, the k most similar other rows; rows of the query's own group are left out.

    Runs of queries meet runs of rows as matrices on the executors; each meeting returns its k
    best for a query.  Vectors are of one length; null and empty ones are no neighbours.
    """
    side = lambda df, x: _packed(df, id_col, vector, group, block).select(*[F.col(c).alias(f"{x}_{c}") for c in ("ids", "groups", "matrix", "width")])
    met = side(queries, "q").crossJoin(side(vectors, "r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, r = (np.frombuffer(row[f"{x}_matrix"]).reshape(-1, row[f"{x}_width"]) for x in "qr")
                ids, own = np.array(row["q_ids"]), np.array(row["r_ids"])
                s = q @ r.T
                barred = ids[:, None] == own[None, :]
                if group:
                    a, b = (np.array(row[f"{x}_groups"], object) for x in "qr")
                    barred |= (a[:, None] == b[None, :]) & (a != None)[:, None]  # noqa: E711
                s[barred] = -np.inf
                top = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, top.shape[1])), pa.array(own[top.ravel()]), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["query", "neighbour", "cosine"])

    best = met.mapInArrow(run, "query long, neighbour long, cosine double").where(F.col("cosine") > float("-inf"))
    w = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbour")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "neighbour", "rank", "cosine")
