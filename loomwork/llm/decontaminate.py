"""Benchmark decontamination in DataFrame functions only.

The benchmark's windows of `width` words form a hash set.  A document is scanned by
probes first: runs of `probe` words at every (width - probe + 1)-th place, one of which
lies whole inside any window that the document holds.  Only a document with a probe that
occurs in some window has all its windows hashed, looked up in the set, and verified word
by word before they count.  Probes (one number for every nine words) and windows meet
their sets by hash joins on stored tables: Spark broadcasts a set while its size is below
spark.sql.autoBroadcastJoinThreshold and shuffles both sides beyond it, with one result.
What grows with the documents is joined in one way at every size: texts are shuffled once,
as they are, to the keys of those with a probe, which are stored; every later step reads
these texts only, and documents are shuffled once more where the contaminated ones go.

Defined results: words are runs of 0-9, a-z (A-Z count as a-z) and any non-ASCII
characters; an item of fewer words than `width`, but not none, is one window; a null
or empty text has no words; rows that repeat are reported one by one; a null id counts
as an id; an empty benchmark hits nothing.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.store import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Outside the word characters 0-9, A-Z, a-z and U+0080 upwards.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RUNS = "array<struct<at:int,len:int,hash:bigint>>"


@dataclass(frozen=True)
class ContaminationRules:
    width: int = 13
    percent: int = 5  # contaminated: hit words of at least this percentage
    probe: int = 5


def words_of_text(text: Column) -> Column:
    """The words in their own case; split leaves an empty string at an end only."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def lowered(word: Column) -> Column:
    """A-Z only: full lower-casing would change other letters, by their neighbours even."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def benchmark_windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, len, hash, items): each distinct window and the items that hold it."""
    words = items.select(F.col(id_col).alias("item"), F.transform(words_of_text(F.col(text_col)), lowered).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    each = words.select("item", size.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("window"))
    return each.groupBy("window", "len").agg(F.collect_set("item").alias("items")).withColumn("hash", F.xxhash64("window"))


def _starts(words: Column, n: int, step: int = 1) -> Column:
    """1, 1 + step, ... as long as n words follow."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1), F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))


def _probes(length: int, rules: ContaminationRules) -> tuple[int, int]:
    """(words of a probe, step) for windows of this length."""
    n = min(rules.probe, length)
    return n, length - n + 1


def _window_probes(windows: DataFrame, length: int, rules: ContaminationRules) -> DataFrame:
    """(len, hash) of every run of a probe's length inside the windows of one length."""
    size, _ = _probes(length, rules)
    hashes = F.transform(_starts(F.col("window"), size), lambda i: F.xxhash64(F.slice("window", i, size)))
    return windows.where(F.col("len") == length).select("len", F.explode(hashes).alias("hash"))


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, rules: ContaminationRules) -> DataFrame:
    """One row for each id and text with a window: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, hits."""
    windows = stored(benchmark_windows(items, rules.width))
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most `width` numbers
    probes = stored(reduce(DataFrame.union, [_window_probes(windows, n, rules) for n in lengths], windows.select("len", "hash").limit(0)).distinct())
    base = _keyed(docs, id_col, text_col)
    spelled = lambda df: df.select("doc_id", "text_key", words_of_text(F.col("text")).alias("w"))

    def runs(size_and_step: Callable[[int], tuple[int, int]]) -> Column:
        """(at, len, hash) of runs of words, for windows of every length."""
        each = [F.transform(_starts(F.col("w"), *size_and_step(n)), _run_of(n, size_and_step(n)[0])) for n in lengths]
        return F.explode(F.concat(*each) if each else F.expr(f"cast(array() as {_RUNS})"))

    tried = spelled(base).select("doc_id", "text_key", runs(lambda n: _probes(n, rules)).alias("g")).select("doc_id", "text_key", "g.len", "g.hash")
    some = stored(tried.join(probes, ["len", "hash"], "left_semi").select("doc_id", "text_key").distinct())
    texts = stored(_of(base, some, "left_semi", "shuffle_hash").dropDuplicates(["doc_id", "text_key"]))
    every = spelled(texts).select("doc_id", "text_key", runs(lambda n: (n, 1)).alias("g")).select("doc_id", "text_key", "g.*")
    met = stored(every.join(windows.select("len", "hash"), ["len", "hash"], "left_semi"))
    # the words themselves decide
    spelt = _of(met, spelled(texts), "inner", "merge").select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), "at", "len", "hash", F.transform(F.expr("slice(w, at + 1, len)"), lowered).alias("window"))
    verified = spelt.join(windows.select("len", "hash", F.col("window").alias("item_window"), "items"), ["len", "hash"]).where("window = item_window")
    span = F.struct("at", (F.col("at") + F.col("len")).alias("end"))
    per_doc = verified.groupBy("doc_id", "text_key", "n_words").agg(F.array_sort(F.collect_set(span)).alias("hits"), F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda x: x.cast("string")))).alias("ids"))
    covered = F.aggregate("hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, h: F.struct((a["n"] + F.greatest(h["end"] - F.greatest(h["at"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], h["end"]).alias("end")), lambda a: a["n"].cast("long"))
    per_doc = per_doc.withColumn("n_hit", covered)
    contaminated = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= rules.percent * F.col("n_words"))
    return stored(per_doc.select("doc_id", "text_key", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), contaminated.alias("contaminated"), "hits"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ContaminationRules | None = None) -> DataFrame:
    """One row for each document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, hits (word spans)."""
    per_doc = _hits(docs, items, id_col, text_col, rules or ContaminationRules()).drop("n_words")
    out = _of(_keyed(docs, id_col, text_col).select("doc_id", "text_key", F.size(words_of_text(F.col("text"))).cast("long").alias("n_words")), per_doc, "left", "merge")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"), F.coalesce("hits", F.expr("cast(array() as array<struct<at:int,end:int>>)")).alias("hits"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", text_key(F.col("text")).alias("text_key"), "text")


def _run_of(length: int, size: int) -> Callable[[Column], Column]:
    return lambda i: F.struct((i - 1).cast("int").alias("at"), F.lit(length).alias("len"), F.xxhash64(F.transform(F.slice("w", i, size), lowered)).alias("hash"))


def _of(left: DataFrame, right: DataFrame, how: str, by: str) -> DataFrame:
    """left joined with right on (doc_id, text_key) by this join, null ids with null ids; the columns of right under their own names."""
    names = [c for c in right.columns if c not in ("doc_id", "text_key")]
    other = right.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), *names).hint(by)
    out = left.join(other, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), how)
    return out if how in ("left_semi", "left_anti") else out.drop("__id", "__key")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ContaminationRules | None = None) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    bad = _hits(docs, items, id_col, text_col, rules or ContaminationRules()).where("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")).hint("shuffle_hash")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad_id"]) & (text_key(docs[text_col]) == bad["__bad_key"]), "left_anti")
