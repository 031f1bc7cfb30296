"""Line deduplication by pairwise alignment.

Lines are hashed.  A line goes if it lies in an aligned block of at least `block_chars`
characters with any earlier document that shares a line of `line_chars`.  Pairs are
aligned with patience diff (anchors are the lines unique in both, in longest increasing
order, extended to their neighbours).  The earliest holder of each shared line comes
first, so a copied line of n holders mostly takes n - 1 pairs.  For lines still there,
every least run of lines around them that has `block_chars` characters is looked up: a
block that removes the line holds such a run in both documents.  Its earlier holders are
aligned in growing portions until the line is removed or all have been tried, so lines
that many documents share and no alignment removes cost pairs by the square.

Defined results: later means the larger id; n_partners counts the alignments made; rows
that share an id and the text count as one document, rows that share the id only are
documents of their own that are not compared with each other; rows without an id stay as
they are; null and empty texts have one empty line and pair with nothing; blank lines are
no anchors, but may lie inside a block; repeated lines within one document stay (that is
another rule's concern).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.store import stored


DOC = ["doc_id", "text_key"]
PAIR = [*DOC, "earlier", "earlier_key"]


@dataclass(frozen=True)
class LineRules:
    line_chars: int = 20  # shorter lines name no pair
    block_chars: int = 40


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned blocks (start in a, start in b, length) in order."""
    matched: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        at: dict[int, list[int]] = {}
        for i in range(a0, a1):
            at.setdefault(a[i], [0, 0, i, 0])[0] += 1
        for j in range(b0, b1):
            if (x := at.get(b[j])) is not None:
                x[1] += 1
                x[3] = j
        anchors = [(x[2], x[3]) for x in at.values() if x[0] == 1 and x[1] == 1]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(anchors):
            spot = bisect_left(tails, j)
            back.append(ends[spot - 1] if spot else -1)
            tails[spot : spot + 1], ends[spot : spot + 1] = [j], [k]
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(anchors[k])
            k = back[k]
        if not chain:
            continue
        chain.reverse()
        # an anchor opens the piece that starts with it, so its common head is taken there
        for (x, y), (x1, y1) in zip([(a0, b0), *chain], [*chain, (a1, b1)], strict=True):
            work.append((x, x1, y, y1))
    matched.sort()
    blocks: list[tuple[int, int, int]] = []
    for i, j in matched:
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def least_runs(lengths: list[int], lines: list[int], chars: int) -> dict[tuple[int, int], list[int]]:
    """The runs (first, last) of at least `chars` characters that hold one of `lines` and no shorter such run with it, each with these lines."""
    n, total = len(lengths), [0, *accumulate(lengths)]
    before, last = [], -1  # the nearest line before that has characters
    for k, size in enumerate(lengths):
        before.append(last)
        last = k if size else last
    runs: dict[tuple[int, int], list[int]] = {}
    for k in lines:
        s, best = k, n
        while s >= 0 and best > k:
            t = max(bisect_left(total, total[s] + chars) - 1, k)
            if t < best:
                runs.setdefault((s, t), []).append(k)
                best = t
            s = before[s]
    return runs


def run_keys(h: list[int], n: list[int], gone: set[int], rules: LineRules) -> dict[int, list[int]]:
    """Keys a document is found by, each with the lines still there that look for its other holders.

    Blank lines differ in length and share a hash, so runs count them as empty.  Lines
    whose own run needs the length of a blank one look by every long line instead.
    """
    runs = least_runs([k if x else 0 for x, k in zip(h, n, strict=True)], list(range(len(h))), rules.block_chars)
    keys: dict[int, list[int]] = {}
    for (s, t), lines in runs.items():
        keys.setdefault(h[s] if s == t else hash(tuple(h[s : t + 1])), []).extend(k for k in lines if k not in gone)
    there: list[int] = []
    if any(k and not x for x, k in zip(h, n, strict=True)):
        own = least_runs(n, [k for k in range(len(h)) if k not in gone], rules.block_chars)
        there = sorted({k for (s, t), lines in own.items() if any(n[i] and not h[i] for i in range(s, t + 1)) for k in lines})
    for x, k in zip(h, n, strict=True):
        if x and k >= rules.line_chars:
            keys[x] = sorted({*keys.get(x, ()), *there})
    return keys


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None) -> DataFrame:
    """One row for each document: doc_id, text_key, n_lines, n_partners, removed (indices of deleted lines, sorted), removed_chars."""
    rules = rules or LineRules()
    kind = docs.schema[id_col].dataType.simpleString()
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    # one hash for all blank lines
    arrays = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), lines.alias("l")).select(*DOC, F.transform("l", lambda x: F.when(F.trim(x) == "", F.lit(0)).otherwise(F.xxhash64(x))).alias("h"), F.transform("l", F.length).alias("n"))
    arrays = stored(arrays.dropDuplicates(DOC))
    early = arrays.select(F.col("doc_id").alias("earlier"), F.col("text_key").alias("earlier_key"), F.col("h").alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for a, b, n in zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True):
                if {x for x, k in zip(b, n, strict=True) if x and k >= rules.line_chars}.isdisjoint(a):
                    gone.append(None)
                    continue
                out: list[int] = []
                for _, j, size in patience_blocks(a, b):
                    if sum(n[j : j + size]) >= rules.block_chars:
                        out.extend(range(j, j + size))
                gone.append(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(gone, pa.list_(pa.int32()))], names=[*PAIR, "gone"])

    def align(pairs: DataFrame) -> DataFrame:
        both = pairs.select(*PAIR).join(early, PAIR[2:]).join(arrays.withColumnRenamed("h", "b"), DOC).select(*PAIR, "a", "b", "n")
        return stored(both.mapInArrow(run, f"doc_id {kind}, text_key long, earlier {kind}, earlier_key long, gone array<int>"))

    def union_of(aligned: DataFrame) -> DataFrame:
        return aligned.groupBy(*DOC).agg(F.count("gone").alias("n_partners"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("gone")))).alias("removed"))

    posts = arrays.select(*DOC, F.explode(F.arrays_zip("h", "n")).alias("x")).select(*DOC, F.col("x.h").alias("h"), F.col("x.n").alias("n")).where((F.col("n") >= rules.line_chars) & (F.col("h") != 0)).select(*DOC, "h")
    shared = posts.groupBy("h").agg(F.min("doc_id").alias("earlier"), F.min_by("text_key", "doc_id").alias("earlier_key"), F.max("doc_id").alias("latest")).where("earlier < latest")
    aligned = align(posts.join(shared.select("h", *PAIR[2:]), "h").where("doc_id > earlier").select(*PAIR).distinct())

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, left = [], [], []
            for r, (h, n, gone) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                for key, at in run_keys(h, n, set(gone or ()), rules).items():
                    rows.append(r)
                    keys.append(key)
                    left.append(at or None)
            taken = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(keys, pa.int64()), pa.array(left, pa.list_(pa.int32()))], names=[*DOC, "key", "at"])

    held = arrays.where("doc_id is not null").join(union_of(aligned).select(*DOC, "removed"), DOC, "left").select(*DOC, "h", "n", "removed").mapInArrow(post, f"doc_id {kind}, text_key long, key long, at array<int>")
    by = Window.partitionBy("key").orderBy(*DOC)
    held = held.withColumns({"place": F.row_number().over(by), "next": F.lead("doc_id").over(by)})
    held = stored(held.where("place > 1 or next is not null").drop("next"))
    active, low, high = held.where("place > 1 and at is not null"), 0, 8
    while active.limit(1).count():
        salts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
        portion = held.where((F.col("place") > low) & (F.col("place") <= high)).select("key", F.col("doc_id").alias("earlier"), F.col("text_key").alias("earlier_key"), salts)
        pairs = active.select("key", *DOC, F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int").alias("salt")).join(portion, ["key", "salt"]).where("earlier < doc_id").select(*PAIR).distinct()
        aligned = aligned.unionByName(align(pairs.join(aligned.select(*PAIR), PAIR, "left_anti")))
        still = F.size(F.array_except("at", F.coalesce("removed", F.array().cast("array<int>")))) > 0
        active = stored(active.where(F.col("place") > high + 1).join(union_of(aligned).select(*DOC, "removed"), DOC, "left").where(still).select(*DOC, "key", "at", "place"))
        low, high = high, high * 8

    out = arrays.join(union_of(aligned), DOC, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda s, i: s + F.element_at("n", i + 1))
    return out.select(*DOC, F.size("h").cast("long").alias("n_lines"), F.coalesce("n_partners", F.lit(0)).cast("long").alias("n_partners"), "removed", chars.alias("removed_chars"))


def delete_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None) -> DataFrame:
    """docs with the text of later documents shortened; other columns stay."""
    gone = repeated_lines(docs, id_col, text_col, rules).where(F.size("removed") > 0).select("doc_id", "text_key", "removed")
    joined = docs.join(gone, (docs[id_col] == gone["doc_id"]) & (text_key(docs[text_col]) == gone["text_key"]), "left")
    kept = F.array_join(F.filter(F.split(docs[text_col], "\n"), lambda x, i: ~F.array_contains(gone["removed"], i)), "\n")
    text = F.when(gone["removed"].isNotNull(), kept).otherwise(docs[text_col]).alias(text_col)
    return joined.select(*[text if c == text_col else docs[c] for c in docs.columns])
