"""Quality selection by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of target rows and one
of all rows, give each text the log ratio of its features.  Adding Gumbel noise (from a
hash of the id, so runs agree) and taking the k largest keys samples k texts without
replacement in proportion to the ratio.

The target model is fitted on at most `target_rows` labelled rows (a documented bound,
smallest id hashes first); the counts of the raw model cover every row.  A model is one
array of `buckets` numbers at any input size.  The k-th key is found by counting bins,
not by sorting.

Defined results: null and empty texts have no features and weight 0; without target
rows all weights are 0; rows that repeat get equal keys and stay or go together, so
`kept` may exceed k by such ties; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.store import stored
from loomwork.llm.textarrays import chunks, mix, text_of, window_hash, words_of


@dataclass(frozen=True)
class ResamplingRules:
    share: float = 0.85  # of the rows that are kept
    buckets: int = 1 << 16
    target_rows: int = 20_000
    smoothing: float = 1.0
    seed: int = 7


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a chunk and the text of each."""
    words = words_of(data, offsets)
    text = text_of(words.first)
    pairs = window_hash(words.hash, 2)
    at = np.flatnonzero(text[: len(pairs)] == text[1:]) if len(pairs) else np.zeros(0, np.int64)
    size = np.uint64(buckets)
    return np.concatenate([words.hash % size, pairs[at] % size]).astype(np.int64), np.concatenate([text, text[at]])


def feature_ratios(docs: DataFrame, target_ids: DataFrame, rules: ResamplingRules) -> np.ndarray:
    """log(target probability / raw probability) of each bucket. docs: (doc_id, text); target_ids: (doc_id)."""
    chosen = target_ids.select(F.col("doc_id").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.target_rows).withColumn("target", F.lit(True))
    flagged = docs.join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))  # at most target_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(rules.buckets, np.int64), np.zeros(rules.buckets, np.int64)
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in chunks(batch.column(0)):
                feature, text = _features(data, offsets, rules.buckets)
                raw += np.bincount(feature, minlength=rules.buckets)
                target += np.bincount(feature[flags[first:last][text]], minlength=rules.buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    counts = flagged.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(rules.buckets, rules.smoothing), np.full(rules.buckets, rules.smoothing)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    if not counts["target"].sum():
        return np.zeros(rules.buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def importance_resample(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ResamplingRules | None = None) -> DataFrame:
    """doc_id, n_features, log_weight, gumbel_key, kept for each row of docs."""
    rules = rules or ResamplingRules()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ratios = feature_ratios(rows, target_ids, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn = batch.column(2).to_numpy().view(np.uint64)
            for first, last, data, offsets in chunks(batch.column(1)):
                feature, text = _features(data, offsets, rules.buckets)
                n = np.bincount(text, minlength=last - first)
                weight = np.bincount(text, ratios[feature], minlength=last - first)
                u = (mix(turn[first:last]) >> np.uint64(11)).astype(np.float64) / (1 << 53)
                key = weight - np.log(-np.log(u + 2.0**-54))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(weight), pa.array(key)], names=["doc_id", "n_features", "log_weight", "gumbel_key"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = stored(rows.select("doc_id", "text", F.xxhash64(F.lit(rules.seed), "doc_id").alias("turn")).mapInArrow(run, f"doc_id {kind}, n_features long, log_weight double, gumbel_key double"))
    bound = kth_largest(keyed, "gumbel_key", rules.share)
    return keyed.withColumn("kept", F.col("gumbel_key") >= F.lit(bound))


def kth_largest(rows: DataFrame, column: str, share: float, bins: int = 4096) -> float:
    """The k-th largest value, k being the rounded share of all rows, by counting narrower and narrower bins."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    k = round(share * n)
    if not k:
        return float("inf")
    while low < high:
        step = (high - low) / bins
        if step <= 0 or low + step == low:
            break
        counts = dict(rows.where(F.col(column).between(low, high)).groupBy(F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1)).alias("bin")).agg(F.struct(F.count(F.lit(1)), F.min(column), F.max(column))).collect())
        for at in sorted(counts, reverse=True):
            size, least, most = counts[at]
            if k <= size:
                break
            k -= size
        low, high = least, most
        if k == size:
            return low
        if k == 1:
            return high
    return low
