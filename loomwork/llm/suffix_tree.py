"""Language-model scoring by a probabilistic suffix tree over words.

States are contexts of up to two preceding words.  A context becomes a state when its
next-word distribution diverges from the root's: the leave-one-out estimate of the
log-likelihood that its smoothed distribution gains over the root, summed over its
training occurrences, must exceed `least_gain` nats.  Each state's distribution is
smoothed towards the next shorter state's, (c(s, w) + beta * P_shorter(w)) / (n(s) + beta),
down to the root (c + 0.1) / (N + 0.1 * (V + 1)), and a text is scored in the longest
suffix state at every word.  All distributions sum to one.

Nothing is sampled: every n-gram of the training rows is counted.  Documents are cut into
blocks; each block sends its distinct n-grams, as sorted hash arrays, to buckets by the
hash of the context (one row for each block and bucket, not one for each n-gram).  A
bucket adds the counts, tests its contexts, and answers every block with the counts in
the block's own order.  Contexts of very frequent words (a share of 2**-HOT_BITS of all
words or more; at most 2**HOT_BITS words) are salted over SALTS buckets by the next word and
their tests added up, so no bucket gathers a whole frequent context.  Only the root's
frequent words (at most 2**ROOT_BITS) and the salted contexts are collected.

Contexts are known by 34 (one word) and 40 (two words) hash bits and the next word by 30
and 24, so a few in a million n-grams share a count; single words have 64 bits.

Defined results: words are lower-cased runs of other bytes than space and 0x09-0x0D,
and every text ends in one end token; a null text counts as empty and holds the end
only; rows that repeat are scored one by one and counted as often as they occur; with no
training rows every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.store import stored
from loomwork.llm.textarrays import buffer_of, chunks, mix, words_of

END = np.uint64(0x656E64206F662074)
HOT_BITS, SALTS, ROOT_BITS = 6, 16, 17
NEXT_BITS = (0, 30, 24)


@dataclass(frozen=True)
class SuffixTreeRules:
    beta: float = 1.0
    least_gain: float = 4.0
    block_bytes: int = 6 << 20
    bucket_keys: int = 1_000_000
    held_out: tuple[int, int] = (10, 0)  # crc32(doc_id as text) mod 10 = 0 is not learned from


class Tokens(NamedTuple):
    hash: np.ndarray  # of each token, the end of each text included
    first: np.ndarray
    train: np.ndarray  # of each token


class Root(NamedTuple):
    """Frequent words by hash, with the share of each; `floor` bounds the share of any other word."""

    words: np.ndarray
    shares: np.ndarray
    floor: float
    hot: np.ndarray


def tokens_of(texts: pa.Array, train: np.ndarray) -> Tokens:
    hashes, counts = [], []
    for _, _, data, offsets in chunks(texts):
        words = words_of(data, offsets)
        n = np.diff(words.first)
        out = np.full(len(words.hash) + len(n), END, np.uint64)
        out[np.arange(len(words.hash)) + np.repeat(np.arange(len(n)), n)] = words.hash
        hashes.append(out)
        counts.append(n + 1)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return Tokens(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(n)]), np.repeat(train, n))


def _is_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def context_hash(*words: np.ndarray) -> np.ndarray:
    out = np.zeros_like(words[0])
    for w in words:
        out = mix(out * np.uint64(3) + w)
    return out


def salted(context: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return mix(context + (salt + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _key(context: np.ndarray, word: np.ndarray, level: int) -> np.ndarray:
    mask = np.uint64((1 << NEXT_BITS[level]) - 1)
    return (context & ~mask) | (word & mask)


def keys_of(tokens: Tokens, level: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, n-gram keys, unsalted context where the context is hot or else 0)."""
    h = tokens.hash
    if level == 0:
        return np.arange(len(h)), h, np.zeros(len(h), np.uint64)
    inside = np.ones(len(h), bool)
    for k in range(level):
        at = tokens.first[:-1] + k
        inside[at[at < len(h)]] = False  # words of the next text are marked by that text anyway
    at = np.flatnonzero(inside)
    before = [h[at - k] for k in range(level, 0, -1)]
    context, is_hot = context_hash(*before), np.ones(len(at), bool)
    for w in before:
        is_hot &= _is_in(hot, w)
    spread = np.where(is_hot, salted(context, (h[at] >> np.uint64(40)) % np.uint64(SALTS)), context)
    return at, _key(spread, h[at], level), np.where(is_hot, context, np.uint64(0))


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    width = values.dtype.itemsize
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorting order, first of each distinct key in it, rank of each sorted key)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, int, pa.Table]]:
    """(block id, check sum of the ids and sizes, rows): the same blocks each time a partition is read."""
    part, held, size, k = TaskContext.get().partitionId(), [], 0, 0

    def block() -> tuple[int, int, pa.Table]:
        rows = pa.Table.from_batches(held)
        _, offsets = buffer_of(rows.column(1))
        check = int(np.bitwise_xor.reduce(mix(offsets.astype(np.uint64) + np.arange(len(offsets), dtype=np.uint64) * np.uint64(7919)))) >> 1
        return (part << 24) + k, check, rows

    for batch in batches:
        begin = 0
        _, offsets = buffer_of(batch.column(1))
        while begin < batch.num_rows:
            # whole texts until the block is full
            end = int(np.searchsorted(offsets, offsets[begin] + max(limit - size, 1), side="left"))
            end = min(max(end, begin + 1), batch.num_rows)
            held.append(batch.slice(begin, end - begin))
            size += int(offsets[end] - offsets[begin])
            begin = end
            if size >= limit:
                yield block()
                held, size, k = [], 0, k + 1
    if held:
        yield block()


def root_of(rows: DataFrame, rules: SuffixTreeRules) -> tuple[Root, int]:
    """The root's frequent words, and the number of tokens of all rows."""
    share = 2.0 ** -(ROOT_BITS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, block in _blocks(batches, rules.block_bytes):
            tokens = tokens_of(block.column(1), block.column(2).to_numpy(zero_copy_only=False))
            words, counts = np.unique(tokens.hash[tokens.train], return_counts=True)
            often = counts >= share * counts.sum()
            # word 0: tokens of the block, and of those learned from
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[0], words[often].view(np.int64)])), pa.array(np.concatenate([[len(tokens.hash)], counts[often]]), pa.int64()), pa.array(np.concatenate([[counts.sum()], np.zeros(often.sum())]), pa.float64())], names=["word", "n", "learned"])

    # a block lists at most 2**(ROOT_BITS + 1) words
    counts = rows.mapInArrow(run, "word long, n long, learned double").groupBy("word").agg(F.sum("n").alias("n"), F.sum("learned").alias("learned"))
    counts = stored(counts)
    total = counts.where("word = 0").first()
    if total is None:
        return Root(np.zeros(0, np.uint64), np.zeros(0), share, np.zeros(0, np.uint64)), 0
    learned = max(total["learned"], 1.0)
    best = counts.where("word <> 0").where(F.col("n") >= 2.0**-ROOT_BITS * learned).select("word", "n").toPandas()
    words, shares = best["word"].to_numpy(np.int64).view(np.uint64), best["n"].to_numpy(float) / learned
    order = np.argsort(words)
    words, shares = words[order], shares[order]
    return Root(words, shares, 2.0**-ROOT_BITS, words[shares >= 2.0**-HOT_BITS]), int(total["n"])


def _root_logs(root: Root, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Next-word bits of the frequent words, sorted, and the log share of each."""
    bits = root.words & np.uint64((1 << NEXT_BITS[level]) - 1)
    order = np.argsort(bits)
    return bits[order], np.log(root.shares[order])


def salted_contexts(root: Root, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Context bits of every salted hot context, sorted, and the unsalted context of each."""
    hot = root.hot
    words = np.meshgrid(*[hot] * level, indexing="ij")
    context = context_hash(*(w.ravel() for w in words)) if len(hot) else np.zeros(0, np.uint64)
    salts = np.arange(SALTS, dtype=np.uint64)
    bits = salted(np.repeat(context, SALTS), np.tile(salts, len(context))) >> np.uint64(NEXT_BITS[level])
    order = np.argsort(bits)
    return bits[order], np.repeat(context, SALTS)[order]


def requests(rows: DataFrame, root: Root, bits: int, rules: SuffixTreeRules) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, check, table in _blocks(batches, rules.block_bytes):
            tokens = tokens_of(table.column(1), table.column(2).to_numpy(zero_copy_only=False))
            edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            sizes, blobs = [], []
            for level in range(3):
                at, keys, _ = keys_of(tokens, level, root.hot)
                order, new, _ = _distinct(keys)
                counts = np.add.reduceat(tokens.train[at][order].astype(np.uint64), new, dtype=np.uint64) if len(new) else np.zeros(0, np.uint64)
                own = keys[order][new]
                del at, keys, order, new
                cut = np.concatenate([[0], np.searchsorted(own, edges), [len(own)]])
                sizes.append(np.diff(cut))
                blobs.append([(pack(np.diff(own[a:b], prepend=np.uint64(0))), pack(counts[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)])
            n, m = 1 << bits, (lambda x: pa.array(np.full(1 << bits, x)))
            columns = {"bucket": pa.array(np.arange(n, dtype=np.int32)), "block": m(block), "check": m(check), **{f"n{k}": pa.array(sizes[k], pa.int64()) for k in range(3)}}
            for k in range(3):
                columns[f"k{k}"] = pa.array([x[0] for x in blobs[k]], pa.binary())
                columns[f"c{k}"] = pa.array([x[1] for x in blobs[k]], pa.binary())
            del tokens, blobs, table
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, "bucket int, block long, check long, n0 long, n1 long, n2 long, k0 binary, c0 binary, k1 binary, c1 binary, k2 binary, c2 binary")


def _tested(keys: np.ndarray, counts: np.ndarray, level: int, root: Root, rules: SuffixTreeRules) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """(count, state size) of each distinct n-gram, 0 where its context is no state; partial tests of salted contexts."""
    shift = np.uint64(NEXT_BITS[level])
    context = keys >> shift
    new = np.ones(len(keys), bool)
    new[1:] = context[1:] != context[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return counts, counts, []
    words, logs = _root_logs(root, level)
    bits = keys & np.uint64((1 << NEXT_BITS[level]) - 1)
    log_root = np.full(len(keys), np.log(root.floor))
    if len(words):
        at = np.minimum(np.searchsorted(words, bits), len(words) - 1)
        log_root = np.where(words[at] == bits, logs[at], log_root)
    c = counts.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(c > 0, c * (np.log(c - 1 + rules.beta * np.exp(log_root)) - log_root), 0.0)
    n, gain = np.add.reduceat(c, first), np.add.reduceat(part, first)
    table, owner = salted_contexts(root, level)
    place = np.minimum(np.searchsorted(table, context[first]), max(len(table) - 1, 0))
    hot = table[place] == context[first] if len(table) else np.zeros(len(first), bool)
    partial = [(int(owner[p].view(np.int64)), int(m), float(g)) for p, m, g in zip(place[hot], n[hot], gain[hot], strict=True)]
    state = ~hot & (n > 0) & (gain - n * np.log(np.maximum(n - 1 + rules.beta, 1e-9)) > rules.least_gain)
    size = np.diff(np.append(first, len(keys)))
    known = np.repeat(state | hot, size)
    return np.where(known, counts, 0).astype(np.uint64), np.repeat(np.where(state, n, 0), size).astype(np.uint64), partial


def answers(asked: DataFrame, root: Root, rules: SuffixTreeRules) -> DataFrame:
    """For each block and bucket: counts of its words, and counts and state sizes of its n-grams, in its own order."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.num_rows
        out: dict[str, list] = {k: [] for k in ("a0", "a1", "s1", "a2", "s2")}
        distinct, total, partial = 0, 0, []
        for level in range(3):
            n = group.column(f"n{level}").to_numpy()
            keys = [np.cumsum(unpack(group.column(f"k{level}")[i].as_py(), n[i], np.uint64), dtype=np.uint64) for i in range(rows)]
            counts = np.concatenate([unpack(group.column(f"c{level}")[i].as_py(), n[i], np.uint64) for i in range(rows)])
            keys = np.concatenate(keys)
            order, new, rank = _distinct(keys)
            sums = np.add.reduceat(counts[order], new, dtype=np.uint64) if len(new) else np.zeros(0, np.uint64)
            cut = np.concatenate([[0], np.cumsum(n)])
            back = np.empty(len(keys), np.int64)
            back[order] = rank
            if level == 0:
                distinct, total = int((sums > 0).sum()), int(sums.sum(dtype=np.int64))
                each = {"a0": sums}
            else:
                c, s, more = _tested(keys[order][new], sums, level, root, rules)
                partial += [(level, *x) for x in more]
                each = {f"a{level}": c, f"s{level}": s}
            for name, values in each.items():
                own = values[back] if len(values) else np.zeros(0, np.uint64)
                out[name] = [pack(own[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        hot = [[{"level": p[0], "context": p[1], "n": p[2], "gain": p[3]} for p in partial]] + [[]] * (rows - 1)
        kind = pa.list_(pa.struct([("level", pa.int32()), ("context", pa.int64()), ("n", pa.int64()), ("gain", pa.float64())]))
        once = lambda x: pa.array([x] + [0] * (rows - 1), pa.int64())
        return pa.table({**{k: group.column(k) for k in ("bucket", "block", "check", "n0", "n1", "n2")}, **{k: pa.array(v, pa.binary()) for k, v in out.items()}, "distinct": once(distinct), "total": once(total), "hot": pa.array(hot, kind)})

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, block long, check long, n0 long, n1 long, n2 long, a0 binary, a1 binary, s1 binary, a2 binary, s2 binary, distinct long, total long, hot array<struct<level:int,context:long,n:long,gain:double>>")


def packed_documents(rows: DataFrame, rules: SuffixTreeRules) -> DataFrame:
    """(block, check, documents): the rows of each block as one compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, check, table in _blocks(batches, rules.block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([check]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "check", "documents"])

    return rows.mapInArrow(run, "block long, check long, documents binary")


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SuffixTreeRules | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_states (words scored in a state) for each row."""
    rules = rules or SuffixTreeRules()
    modulus, rest = rules.held_out
    train = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)) != rest, F.lit(True))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"))
    root, n_tokens = root_of(rows, rules)
    bits = max(3, int(np.ceil(np.log2(max(n_tokens, 1) * 1.6 / rules.bucket_keys + 1))))
    answered = stored(answers(requests(rows, root, bits, rules), root, rules))
    total, distinct = answered.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    # at most 2**HOT_BITS single and 2**(2 * HOT_BITS) double contexts
    tests = answered.select(F.explode("hot").alias("h")).groupBy("h.level", "h.context").agg(F.sum("h.n").alias("n"), F.sum("h.gain").alias("gain")).collect()
    states = {level: sorted((r["context"] % (1 << 64), r["n"]) for r in tests if r["level"] == level and r["gain"] - r["n"] * np.log(max(r["n"] - 1 + rules.beta, 1e-9)) > rules.least_gain) for level in (1, 2)}
    hot_states = {k: (np.array([x[0] for x in v], np.uint64), np.array([x[1] for x in v], np.int64)) for k, v in states.items()}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError(f"block {key[0]} was cut in another way the second time")
        if left.num_rows != 1 or set(right.column("check").to_pylist()) != set(left.column("check").to_pylist()):
            raise RuntimeError(f"block {key[0]} holds other rows than before")
        table = pa.ipc.open_stream(left.column("documents")[0].as_py()).read_all()
        trained = table.column("train").to_numpy(zero_copy_only=False)
        tokens = tokens_of(table.column("text"), trained)
        right = right.sort_by("bucket")

        def values(name: str, level: int) -> np.ndarray:
            return np.concatenate([unpack(right.column(name)[i].as_py(), right.column(f"n{level}")[i].as_py(), np.uint64) for i in range(right.num_rows)])

        p = known = None
        in_state = np.zeros(len(tokens.hash), bool)
        base = None
        for level in range(3):
            at, keys, hot = keys_of(tokens, level, root.hot)
            order, _, rank = _distinct(keys)
            back = np.empty(len(keys), np.int64)
            back[order] = rank
            c = values(f"a{level}", level)[back].astype(float) if len(keys) else np.zeros(0)
            if level == 0:
                known = c > 0
                p = (c + 0.1) / (total + 0.1 * (distinct + 1))
                base = np.log10(p)
                continue
            n = values(f"s{level}", level)[back].astype(float) if len(keys) else np.zeros(0)
            table_hot, size = hot_states[level]
            if len(table_hot):
                place = np.minimum(np.searchsorted(table_hot, hot), len(table_hot) - 1)
                n = np.where((hot != 0) & (table_hot[place] == hot), size[place], n)
            state = n > 0
            in_state[at[state]] = True
            p[at[state]] = (c[state] + rules.beta * p[at[state]]) / (n[state] + rules.beta)
        starts = tokens.first[:-1]
        add = lambda x, t: np.add.reduceat(x.astype(t), starts) if len(starts) else np.zeros(0, t)
        return pa.table({"doc_id": table.column("doc_id"), "held_out": pa.array(~trained), "n_tokens": pa.array(np.diff(tokens.first), pa.int64()), "n_known": pa.array(add(known, np.int64)), "train_tokens": pa.array(np.full(len(starts), total), pa.int64()), "base_score": pa.array(add(base, float)), "score": pa.array(add(np.log10(p), float)), "n_states": pa.array(add(in_state, np.int64))})

    packed = packed_documents(rows, rules).groupBy("block")
    replies = answered.drop("distinct", "total", "hot").groupBy("block")
    return packed.cogroup(replies).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_states long")
