"""Queries of the training-data operators over the documents tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.decontaminate import contamination
from loomwork.llm.line_dedup import repeated_lines
from loomwork.llm.minhash import NearDuplicateRules, near_duplicates
from loomwork.llm.mixing import mix_sources
from loomwork.llm.pii import span_report
from loomwork.llm.repetition import MEASURES, repetition_report
from loomwork.llm.resampling import importance_resample
from loomwork.llm.sharding import shard_documents
from loomwork.llm.suffix_tree import suffix_tree_scores
from loomwork.llm.toxicity import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(_table(spark, sf_dir, "documents"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op3_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(_table(spark, sf_dir, "documents"))


def op5_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_partners", F.size("removed").cast("long").alias("n_removed"), "removed_chars", F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed_lines"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), rules=NearDuplicateRules(width=4))


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_report(_table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return importance_resample(_table(spark, sf_dir, "documents"), labels)


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_tree, op2_temperature_mixing, op3_lpt_sharding, op4_pii_boosting, op5_line_alignment, op6_decontamination, op7_minhash_join, op8_repetition, op9_importance_resampling, op10_toxicity_grammar)
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_BENCH_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BENCH_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_BENCH_WORD}) AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, k WHERE len(w) >= k),
ds AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM dw),
h AS (SELECT ds.doc_id, ds.i, ds.k, bw.item_id FROM ds JOIN bw ON ds.win = bw.win AND ds.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 80 * (p.k + q.k - m)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) LEFT JOIN n USING (doc_id)
"""


def _covered(n: int, value: str) -> str:
    return f"""(SELECT doc_id, sum({value}) AS v FROM (SELECT DISTINCT doc_id, p FROM (
  SELECT doc_id, unnest(range(i, i + {n})) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (
    SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM d WHERE len(w) >= {n}))) WHERE k > 1))
  JOIN x USING (doc_id, p) GROUP BY doc_id)"""


_OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, length(unnest(w)) AS c FROM d),
l AS (SELECT doc_id, q, row_number() OVER (PARTITION BY doc_id, q) AS r FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS q FROM d) WHERE regexp_matches(q, {_WORD})),
ld AS (SELECT doc_id, count(*) AS n, sum(length(q)) AS c FROM l WHERE r > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce((SELECT sum(c) FROM x WHERE x.doc_id = d.doc_id), 0) AS word_chars, length(t) AS chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ld.n, 0) AS n_dup_lines, coalesce(ld.c, 0) AS line_chars, coalesce(r8.v, 0) AS n_repeat_words,
  coalesce(c5.v, 0) AS v5, coalesce(c6.v, 0) AS v6, coalesce(c8.v, 0) AS v8, coalesce(c10.v, 0) AS v10
  FROM d LEFT JOIN ld USING (doc_id) LEFT JOIN {_covered(8, "1")} r8 USING (doc_id) LEFT JOIN {_covered(5, "c")} c5 USING (doc_id)
  LEFT JOIN {_covered(6, "c")} c6 USING (doc_id) LEFT JOIN {_covered(8, "c")} c8 USING (doc_id) LEFT JOIN {_covered(10, "c")} c10 USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (line_chars > 0.30 * greatest(chars, 1) OR n_symbols > 0.10 * n_words OR v5 > 0.45 * greatest(word_chars, 1) OR v6 > 0.40 * greatest(word_chars, 1)
    OR v8 > 0.35 * greatest(word_chars, 1) OR v10 > 0.32 * greatest(word_chars, 1)) AS kept
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": _OP6, "op7_minhash_join": _OP7, "op8_repetition": _OP8}
