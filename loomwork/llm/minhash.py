"""Near-duplicate classes by a signature-coordinate inverted join.

Every distinct shingle set gets K minhash coordinates.  It is posted under its
coordinate-value pairs, rarest first, and only under the first K - M + 1 of them
(prefix filter): two sets that agree on M coordinates or more still meet under one.
A pair that meets is kept when its signatures collide at M coordinates or more, and
is then confirmed on the full shingle sets.  With K = 48 and M = 24 a pair at the
Jaccard limit of 0.8 is missed with a probability below 1e-6; M = 1 posts every
coordinate and misses a pair only if no coordinate agrees (below 1e-33).

Large posting lists are not expanded into pairs.  First each member of a list is
compared with one pivot of the list only, and what is confirmed joins components.
Lists that lie in one component are then skipped (skip merging).  The members of every
other list are cut into units, that carry signatures, not texts.  A unit counts the
collisions of its members across components and names, instead of pairs, the groups of
members that collisions connect; a pair counts only in the unit of the first coordinate
whose list holds both, so it is looked at once.  Texts travel only to these groups, where
the full sets decide and only links that join components come out.  No link between
components is lost, and no step makes pairs by the square of a list.

Defined results: shingles are runs of `width` lower-cased words, a shorter text is
one shingle, a text without words (or null) has the empty set and links with
nothing.  Rows that share an id are linked with each other if they have words.  Rows
without an id take part; their component is the smallest id they reach, or null.  Equal
sets form one class without pairs.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.components import connected_components
from loomwork.store import forget, stored
from loomwork.llm.textarrays import chunks, mix, text_of, window_hash, words_of


@dataclass(frozen=True)
class NearDuplicateRules:
    width: int = 5
    percent: int = 80  # 100 * intersection >= percent * union
    coordinates: int = 48  # at most 63
    least_matches: int = 24
    pivots: bool = True
    unit_rows: int = 4096  # of one block of a list; a unit joins two
    unit_shingles: int = 200_000  # of one block whose full sets are compared


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the first of each text."""
    words = words_of(data, offsets)
    keys = window_hash(words.hash, width)
    text = text_of(words.first)
    at = np.flatnonzero(text[: len(keys)] == text[width - 1 :]) if len(keys) else np.zeros(0, np.int64)
    keys, owner = keys[at], text[at]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width):  # the words of the text, in order, and how many
            has = counts[short] > k
            whole[has] = mix(whole[has] * np.uint64(31) + words.hash[words.first[short[has]] + k])
        keys = np.concatenate([keys, mix(whole + counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.argsort(keys)
    order = order[np.argsort(owner[order], kind="stable")]
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(len(offsets)))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(rows: DataFrame, rules: NearDuplicateRules) -> DataFrame:
    """doc_id, text_key, n_shingles, two 64-bit sums that identify the set (set, check), and the signature. rows: (doc_id, text)."""
    multiply, add = _coefficients(rules.coordinates)
    high = np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(2)):
                keys, starts = _shingles(data, offsets, rules.width)
                counts = np.diff(starts)
                full = np.flatnonzero(counts)
                low = np.zeros((last - first, 2), np.uint64)
                sig = np.zeros((last - first, rules.coordinates), np.int32)
                if len(keys):
                    at = starts[full]
                    low[full, 0] = np.add.reduceat(mix(keys), at)
                    low[full, 1] = np.add.reduceat(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for k in range(rules.coordinates):
                        v = keys * multiply[k]
                        v += add[k]
                        v ^= v >> high
                        v *= multiply[k]
                        sig[full, k] = np.minimum.reduceat((v >> high).astype(np.uint32), at).view(np.int32)
                values = pa.array(sig.ravel())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, last - first) for k in (0, 1)), pa.array(counts, pa.int64()), pa.array(low[:, 0].view(np.int64)), pa.array(low[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, rules.coordinates), pa.int32()), values)],
                    names=["doc_id", "text_key", "n_shingles", "set", "check", "sig"],
                )

    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(k, T.LongType()) for k in ("text_key", "n_shingles", "set", "check")), T.StructField("sig", T.ArrayType(T.IntegerType()))])
    return rows.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(run, schema)


def postings(sets: DataFrame, rules: NearDuplicateRules) -> DataFrame:
    """(set, key, pivot) of each set's rarest K - M + 1 coordinate-value pairs, those that only one set has left out; pivot: the smallest set of the key."""
    value = F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    each = sets.select("set", F.posexplode("sig").alias("k", "v")).select("set", (F.shiftleft(F.col("k").cast("long"), 32) + value).alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("set").alias("pivot")).where("df > 1")
    met = each.join(shared, "key")
    # pairs that only one set has are the rarest of all: they fill the prefix first
    rank = F.row_number().over(Window.partitionBy("set").orderBy(F.col("df").desc(), "key"))
    return met.withColumn("from_commonest", rank).where(F.col("from_commonest") >= rules.least_matches).select("set", "key", "pivot")


def in_units(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """run(the rows of one unit) for all units, the runs of equal integer keys; many small units cost no more than their rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(k).to_numpy() for k in keys])
            cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1
            if last is not None and (names[:, 0] != last).any():
                cuts = np.concatenate([[0], cuts])
            begin = 0
            for cut in cuts:
                if cut > begin:
                    held.append(batch.slice(begin, cut - begin))
                if held:
                    yield run(pa.Table.from_batches(held).combine_chunks())
                held, begin = [], cut
            held.append(batch.slice(begin))
            last = names[:, -1]
        if held:
            yield run(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def _with_texts(members: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """members (a stored table with set) and a text of each set."""
    named = members.join(sets.select("set", "rep", "rep_key"), "set")
    texts = rows.select(F.col("doc_id").alias("__id"), text_key(F.col("text")).alias("__key"), "text")
    return texts.join(named, F.col("rep").eqNullSafe(F.col("__id")) & (F.col("rep_key") == F.col("__key"))).select(*members.columns, "text")


def _once(unit: pa.Table) -> pa.Table:
    """The unit with one row for each set."""
    first = np.sort(np.unique(unit.column("set").to_numpy(), return_index=True)[1])
    return unit if len(first) == unit.num_rows else unit.take(pa.array(first))


def _links(ends: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _pivot_links(posts: DataFrame, sets: DataFrame, rows: DataFrame, rules: NearDuplicateRules) -> DataFrame:
    """Confirmed links (a, b) of sets with the pivots of their lists."""
    pairs = posts.where("set <> pivot").select(F.col("set").alias("a"), F.col("pivot").alias("b")).distinct()
    side = lambda x: sets.select(F.col("set").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    matches = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    sized = 100 * F.least("n_a", "n_b") >= rules.percent * F.greatest("n_a", "n_b")
    likely = stored(pairs.join(side("a"), "a").join(side("b"), "b").where(sized & (matches >= rules.least_matches)).select("a", "b", "n_a"))
    # the members of a pivot are cut into parts of bounded size
    parts = likely.groupBy("b").agg(F.ceil(F.sum("n_a") / rules.unit_shingles).alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts")).alias("part")
    star = likely.join(parts, "b").select(F.col("b").alias("pivot"), part, F.col("a").alias("set"))
    star = stored(star.union(star.select("pivot", "part", F.col("pivot").alias("set")).distinct()))

    def compare(unit: pa.Table) -> pa.RecordBatch:
        unit = _once(unit)
        names = unit.column("set").to_numpy()
        numbers, starts = _sets_of(unit.column("text"), rules.width)
        hub = np.flatnonzero(names == unit.column("pivot")[0].as_py())
        if not len(hub):
            return _links([])
        near = np.flatnonzero(names != names[hub[0]])
        near = near[_similar(int(hub[0]), near, numbers, starts, np.zeros(int(numbers.max(initial=0)) + 1, bool), rules)]
        return _links([(int(names[x]), int(names[hub[0]])) for x in near])

    return stored(in_units(_with_texts(star, sets, rows), ["pivot", "part"], compare, "a long, b long"))


def _unit_links(posts: DataFrame, label: DataFrame, sets: DataFrame, rows: DataFrame, rules: NearDuplicateRules) -> DataFrame:
    """Links (a, b) between members of one list that are in different components yet."""
    placed = stored(posts.join(label, "set", "left").select("key", "set", F.coalesce("component", "set").alias("comp")))
    member = F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "set")).alias(f"h{k}") for k in (0, 1))
    parts = placed.groupBy("key", "comp").agg(*member)
    whole = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max("n").alias("main_n"), F.max_by("comp", "n").alias("main"), F.sum("n").alias("n"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1")).where("parts > 1")
    # lists of the same members count once
    one = whole.groupBy("h0", "h1", "n").agg(F.min("key").alias("key"), F.min("main_n").alias("main_n"))
    blocks = lambda n: F.ceil(n / rules.unit_rows).cast("int")
    lists = whole.select("key", "main").join(one.select("key", blocks(F.col("n") - F.col("main_n")).alias("few"), blocks(F.col("n")).alias("all")), "key")
    met = stored(placed.join(lists, "key"))
    turn = lambda n: F.pmod(F.xxhash64(F.lit(2), "set"), F.col(n)).cast("int")
    every = met.select("key", "set", "comp", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), turn("all").alias("j"))
    others = met.where("comp <> main and all > 1").select("key", "set", "comp", turn("few").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"))
    # the coordinates whose lists are still looked at
    masks = met.groupBy("set").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(key, 32) as int))")).alias("mask"))
    known = masks.join(sets.select("set", "n_shingles", "sig"), "set")
    units = every.union(others).join(known, "set")
    groups = stored(in_units(units, ["key", "i", "j"], lambda unit: _groups(unit, rules), "unit long, set long, comp long"))

    def compare(unit: pa.Table) -> pa.RecordBatch:
        unit = _once(unit)
        names = unit.column("set").to_numpy()
        comp = np.unique(unit.column("comp").to_numpy(), return_inverse=True)[1]
        return _links([(int(names[x]), int(names[y])) for x, y in _forest(comp, *_sets_of(unit.column("text"), rules.width), rules)])

    return stored(in_units(_with_texts(groups, sets, rows), ["unit"], compare, "a long, b long"))


def _groups(unit: pa.Table, rules: NearDuplicateRules) -> pa.RecordBatch:
    """(unit, set, comp): members of a unit that enough collisions connect with members of other components, cut into blocks of bounded size."""
    unit = _once(unit)
    sizes = unit.column("n_shingles").to_numpy()
    comp = np.unique(unit.column("comp").to_numpy(), return_inverse=True)[1]
    sig = np.asarray(unit.column("sig").combine_chunks().flatten()).reshape(len(sizes), -1)
    mask = unit.column("mask").to_numpy().view(np.uint64)
    ids = [unit.column(k)[0].as_py() for k in ("key", "i", "j")]
    own = np.uint64(1) << np.uint64(ids[0] >> 32)
    bit = np.uint64(1) << np.arange(sig.shape[1], dtype=np.uint64)
    root = np.arange(len(sizes))
    met = np.zeros(len(sizes), bool)
    outside = np.flatnonzero(comp != np.bincount(comp).argmax())
    by_coordinate = np.ascontiguousarray(sig.T)
    rows = max(1, (1 << 22) // len(sizes))
    for begin in range(0, len(outside), rows):
        some = outside[begin : begin + rows]
        hits = np.zeros((len(some), len(sizes)), np.uint8)
        for column in by_coordinate:
            hits += column[some][:, None] == column[None, :]
        low, high = np.minimum(sizes[some][:, None], sizes), np.maximum(sizes[some][:, None], sizes)
        likely = (hits >= rules.least_matches) & (comp[some][:, None] != comp) & (100 * low >= rules.percent * high)
        for at in np.flatnonzero(likely.any(1)):
            x, near = some[at], np.flatnonzero(likely[at])
            both = ((sig[near] == sig[x]) * bit).sum(1, dtype=np.uint64) & mask[near] & mask[x]
            near = near[(both & (~both + np.uint64(1))) == own]  # the first coordinate that both lie in is this list's
            if len(near):
                met[x] = met[near] = True
                roots = np.unique(root[np.append(near, x)])
                root[np.isin(root, roots[1:])] = roots[0]
    out: list[tuple[int, np.ndarray]] = []
    for r in np.unique(root[met]):
        members = np.flatnonzero((root == r) & met)
        block = (np.cumsum(sizes[members]) - 1) // rules.unit_shingles
        kinds = np.unique(block)
        if len(kinds) < 2:
            out.append((hash((*ids, int(r))), members))
        else:
            out += [(hash((*ids, int(r), int(p), int(q))), members[(block == p) | (block == q)]) for p in kinds for q in kinds if p < q]
    chosen = np.concatenate([m for _, m in out]) if out else np.zeros(0, np.int64)
    name = np.repeat(np.array([u for u, _ in out], np.int64), np.array([len(m) for _, m in out], np.int64))
    return pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), *(pa.array(unit.column(c).to_numpy()[chosen], pa.int64()) for c in ("set", "comp"))], names=["unit", "set", "comp"])


def _sets_of(texts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of all texts on end, as numbers that count from 0, and where each begins."""
    keys, counts = [], []
    for _, _, data, offsets in chunks(texts):
        found, starts = _shingles(data, offsets, width)
        keys.append(found)
        counts.append(np.diff(starts))
    numbers = np.unique(np.concatenate(keys), return_inverse=True)[1]
    return numbers, np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _similar(x: int, near: np.ndarray, numbers: np.ndarray, starts: np.ndarray, mark: np.ndarray, rules: NearDuplicateRules) -> np.ndarray:
    """Which of the sets `near` are similar to x. mark: all false, one place for each number."""
    sizes = np.diff(starts)
    if not len(near):
        return np.zeros(0, bool)
    own = numbers[starts[x] : starts[x + 1]]
    mark[own] = True
    ends = np.cumsum(sizes[near])
    begins = ends - sizes[near]
    at = np.arange(ends[-1]) + np.repeat(starts[near] - begins, sizes[near])
    common = np.add.reduceat(mark[numbers[at]], begins, dtype=np.int64)
    mark[own] = False
    return 100 * common >= rules.percent * (sizes[near] + sizes[x] - common)


def _forest(comp: np.ndarray, numbers: np.ndarray, starts: np.ndarray, rules: NearDuplicateRules) -> list[tuple[int, int]]:
    """Links that join the components of a unit, none between members joined already."""
    sizes = np.diff(starts)
    root = comp.copy()
    mark = np.zeros(int(numbers.max(initial=0)) + 1, bool)
    links: list[tuple[int, int]] = []
    for x in np.flatnonzero(comp != np.bincount(comp).argmax()):
        near = np.flatnonzero((root != root[x]) & (100 * np.minimum(sizes, sizes[x]) >= rules.percent * np.maximum(sizes, sizes[x])) & (sizes > 0))
        for y in near[_similar(x, near, numbers, starts, mark, rules)]:
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                links.append((int(x), int(y)))
    return links


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: NearDuplicateRules | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, text_key, n_shingles, component_id, first_key (text key of the row that names the component)."""
    rules = rules or NearDuplicateRules()
    if not 1 <= rules.least_matches <= rules.coordinates <= 63:
        raise ValueError("1 <= least_matches <= coordinates <= 63")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(signatures(rows, rules))
    same = ["set", "check", "n_shingles"]
    # equal sets: the smallest id stands for all; aggregations combine on the map side
    rep_key = F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("rep_key")
    full = signed.where("n_shingles > 0")
    sets = stored(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), rep_key, F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")))
    posts = stored(postings(sets, rules))
    # rows that share an id
    ends = full.where("doc_id is not null").groupBy("doc_id").agg(F.min("set").alias("b"), F.max("set").alias("z")).where("b < z").select("doc_id", "b")
    edges = full.select("doc_id", F.col("set").alias("a")).join(ends, "doc_id").where("a <> b").select("a", "b").distinct()
    label = sets.select("set", F.col("set").alias("component")).limit(0)
    if rules.pivots:
        edges = stored(edges.union(_pivot_links(posts, sets, rows, rules)))
        label = connected_components(edges, "a", "b").select(F.col("node").alias("set"), "component")
    links = _unit_links(posts, label, sets, rows, rules)
    forget(posts)
    label = connected_components(edges.union(links), "a", "b").select(F.col("node").alias("set"), "component")
    named = sets.select("set", "check", "rep", "rep_key", "copies").join(label, "set", "left")
    of_component = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("id"), F.coalesce(F.min_by("rep_key", "rep"), F.min("rep_key")).alias("first_key"))
    linked = named.join(of_component, "component").select("set", "check", "id", "first_key")
    alone = named.where("component is null and copies > 1").select("set", "check", F.col("rep").alias("id"), F.col("rep_key").alias("first_key"))
    found = linked.union(alone).withColumn("grouped", F.lit(True))
    out = signed.select("doc_id", "text_key", "n_shingles", "set", "check").join(found, ["set", "check"], "left")
    of_row = lambda a, b: F.when(F.col("grouped") & (F.col("n_shingles") > 0), F.col(a)).otherwise(F.col(b))
    return out.select("doc_id", "text_key", "n_shingles", of_row("id", "doc_id").alias("component_id"), of_row("first_key", "text_key").alias("first_key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: NearDuplicateRules | None = None) -> DataFrame:
    """One row for each row of docs: its id, n_shingles, component_id, kept (the id is the component's)."""
    rows = classified(docs, id_col, text_col, rules)
    return rows.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: NearDuplicateRules | None = None) -> DataFrame:
    """docs with one row of each group left, with its columns; rows without words all stay, null ids count as ids do."""
    rows = classified(docs, id_col, text_col, rules)
    chosen = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    # of rows that repeat, id and text, one stays; only these are numbered
    chosen = stored(chosen.groupBy("doc_id", "text_key").agg(F.count_if(F.col("n_shingles") > 0).alias("n")))

    def of(rule: str) -> DataFrame:
        own = chosen.where(rule)
        return docs.join(own, docs[id_col].eqNullSafe(own["doc_id"]) & (text_key(docs[text_col]) == own["text_key"]), "left_semi")

    # the row goes along in a struct, so that no column of docs clashes
    turn = F.row_number().over(Window.partitionBy(id_col, text_key(F.col(text_col))).orderBy(F.lit(0)))
    repeated = of("n > 1").select(F.struct(*docs.columns).alias("row"), turn.alias("turn")).where("turn = 1").select("row.*")
    return of("n <= 1").union(repeated)
