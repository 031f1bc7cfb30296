"""Toxicity by a weighted finite-state pattern grammar.

Five transducers over word classes are composed into one machine.  The lexical one maps
words to classes with weights: a fixed seed lexicon, and insults (words and word
beginnings) learned from labelled rows by log odds; a word of no class is OTHER.  The
negation transducer rewrites an insult or a threat within `negation_reach` words after a
negation to MILD, the reporting one damps what follows a verb of speech, the threat one
turns a threat without a target before it to MILD, and the target one adds weight to a
clause that holds both a target and an offence.  Arcs have factors, which multiply when
machines are composed, and states have final weights, which add.  The composed machine
reads a clause's classes; the clause's weight is the sum of lexical weight times factor
over its arcs and the final weight of the state reached, if an offence was read.  A text's
clause weights (largest, sum, number) go through a logistic curve fitted on the same
labelled rows.

Labels come from at most `label_rows` rows (smallest id hashes); words of all texts are
scored whole.  Fitting sends a bounded lexicon and the features of at most `label_rows`
texts to the driver.

Defined results: null and empty texts match nothing and get the curve's value for no
match; without labels of both kinds the seed lexicon and a fixed curve are used; rows
that repeat get equal scores; a label that is null, or differs between rows of one id,
is the larger one; a row without an id is held out of learning only by having no label.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.textarrays import _prefix, chunks, hashes_of, segment_hash, text_of, words_of

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, MILD = range(7)
SYMBOLS = 7
SEED = {
    INSULT: "idiot moron loser scum trash clown stupid pathetic worthless disgusting dumb fool vermin idioten dummkopf abschaum imbécile crétin ordure idiota imbécil basura",
    THREAT: "kill hurt destroy crush beat töten zerstören tuer détruire matar destruir",
    TARGET: "you your he she they them those du dich ihr euch vous toi ils tú usted ellos",
    NEGATION: "not never no nicht kein nie pas jamais nunca",
    REPORT: "said says quoted reported called sagte sagt dit déclaré dijo dice",
}
SEED_WEIGHT = {INSULT: 2.0, THREAT: 1.5, TARGET: 0.0, NEGATION: 0.0, REPORT: 0.0}
#: What a damped offence still weighs, and what a target adds.
MILD_FACTOR, REPORTED_FACTOR, AIMED = 0.4, 0.7, 0.5
_LETTERS = np.ones(256, bool)
_LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = False
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?\n|()\"")] = True
BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityRules:
    label_rows: int = 20_000
    lexicon: int = 2_000
    least_docs: int = 5
    least_odds: float = 2.5
    threshold: float = 0.3
    negation_reach: int = 3


class Arcs(NamedTuple):
    """Sorted hashes of whole words and of beginnings, with class and weight."""

    words: np.ndarray
    word_class: np.ndarray
    word_weight: np.ndarray
    starts: dict[int, tuple[np.ndarray, np.ndarray]]


def arcs_of(learned: list[tuple[str, int, float]]) -> Arcs:
    """learned: (word or beginning, 0 or the bytes of the beginning, weight)."""
    words = {w: (kind, SEED_WEIGHT[kind]) for kind, line in SEED.items() for w in line.split()}
    words |= {w: (INSULT, x) for w, n, x in learned if not n}
    keys = hashes_of(list(words))
    order = np.argsort(keys)
    value = list(words.values())
    starts = {}
    for n in BEGINNINGS:
        own = [(w, x) for w, k, x in learned if k == n]
        if own:
            h = hashes_of([w for w, _ in own])
            o = np.argsort(h)
            starts[n] = (h[o], np.array([x for _, x in own])[o])
    return Arcs(keys[order], np.array([v[0] for v in value])[order], np.array([v[1] for v in value])[order], starts)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Machine(NamedTuple):
    """A letter transducer: step[state][symbol] is (symbol written, next state, factor); state 0 begins."""

    step: list[list[tuple[int, int, float]]]
    final: list[float]


def machine(states: int, arcs: dict[tuple[int, int], tuple[int, int, float]], final: dict[int, float] | None = None, moves: object = None) -> Machine:
    """Symbols without an arc are copied with factor 1; moves(state) is the state they lead to (default: the same)."""
    step = [[arcs.get((q, a), (a, moves(q) if moves else q, 1.0)) for a in range(SYMBOLS)] for q in range(states)]
    return Machine(step, [(final or {}).get(q, 0.0) for q in range(states)])


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that reads what `first` reads and writes what `second` writes on first's output."""
    number, todo, step, final = {(0, 0): 0}, [(0, 0)], [], []
    for p, q in todo:  # grows while new pairs of states are met
        row = []
        for a in range(SYMBOLS):
            b, p2, f = first.step[p][a]
            c, q2, g = second.step[q][b]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            row.append((c, number[p2, q2], f * g))
        step.append(row)
        final.append(first.final[p] + second.final[q])
    return Machine(step, final)


def negation_machine(reach: int) -> Machine:
    """State k: a negation lies within reach for k words more."""
    arcs = {(q, NEGATION): (NEGATION, reach, 1.0) for q in range(reach + 1)}
    arcs |= {(q, a): (MILD, q - 1, 1.0) for q in range(1, reach + 1) for a in (INSULT, THREAT)}
    return machine(reach + 1, arcs, moves=lambda q: max(q - 1, 0))


def threat_machine() -> Machine:
    """State 1: a target was read. A threat against nobody is mild."""
    return machine(2, {(0, TARGET): (TARGET, 1, 1.0), (0, THREAT): (MILD, 0, 1.0)})


def report_machine() -> Machine:
    """State 1: a verb of speech was read."""
    return machine(2, {(0, REPORT): (REPORT, 1, 1.0), **{(1, a): (a, 1, REPORTED_FACTOR) for a in (INSULT, THREAT, MILD)}})


def target_machine() -> Machine:
    """States: bit 0 a target, bit 1 an offence was read. Writes nothing new; mild offences count less."""
    arcs = {(q, TARGET): (TARGET, q | 1, 1.0) for q in range(4)}
    arcs |= {(q, a): (a, q | 2, 1.0) for q in range(4) for a in (INSULT, THREAT)}
    arcs |= {(q, MILD): (MILD, q, MILD_FACTOR) for q in range(4)}
    return machine(4, arcs, {3: AIMED})


@functools.cache
def grammar(reach: int) -> Machine:
    out = negation_machine(reach)
    for part in (threat_machine(), report_machine(), target_machine()):
        out = compose(out, part)
    return out


def clause_weights(kinds: list[int], weights: list[float], at: list[int], reach: int) -> float:
    """The weight that the composed machine gives a clause of these classes, lexical weights and word positions."""
    step, final = grammar(reach)
    state, total, offence, last = 0, 0.0, False, at[0] - 1
    for kind, weight, i in zip(kinds, weights, at, strict=True):
        for _ in range(min(i - last - 1, reach)):  # beyond reach further words change no state
            state = step[state][OTHER][1]
        _, state, factor = step[state][kind]
        if kind in (INSULT, THREAT):
            total += weight * factor
            offence = True
        last = i
    return total + final[state] if offence else 0.0


def score_clauses(data: np.ndarray, offsets: np.ndarray, arcs: Arcs, reach: int) -> np.ndarray:
    """(largest clause weight, sum, matched clauses) for each text."""
    out = np.zeros((len(offsets) - 1, 3))
    words = words_of(data, offsets, True, _LETTERS)
    if not len(words.hash):
        return out
    at, hit = _find(arcs.words, words.hash)
    kind = np.where(hit, arcs.word_class[at], 0)
    weight = np.where(hit, arcs.word_weight[at], 0.0)
    sums, inverse = _prefix(data, True)
    for n, (table, value) in arcs.starts.items():
        long = np.flatnonzero((words.end - words.start >= n) & (kind == 0))
        p, found = _find(table, segment_hash(sums, inverse, words.start[long], words.start[long] + n))
        kind[long[found]], weight[long[found]] = INSULT, value[p[found]]
    stops = np.concatenate([[0], np.cumsum(_STOPS[data])])
    text = text_of(words.first)
    clause = stops[words.start] + text  # grows at every stop and every text
    bad = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    if not len(bad):
        return out
    marked = np.flatnonzero((kind > 0) & np.isin(clause, np.unique(clause[bad])))
    cuts = np.flatnonzero(np.diff(clause[marked])) + 1
    for part in np.split(marked, cuts):
        x = clause_weights(kind[part].tolist(), weight[part].tolist(), part.tolist(), reach)
        if x > 0:
            row = out[text[part[0]]]
            row[0] = max(row[0], x)
            row[1] += x
            row[2] += 1
    return out


def _design(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), f[:, 0], np.log1p(f[:, 1]), np.log1p(f[:, 2])])


def fit_curve(f: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    if len(set(y.tolist())) < 2:
        return np.array([-3.0, 0.5, 0.5, 0.5])
    x, w = _design(f), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w * [0, 1, 1, 1]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-6, 1, 1, 1])
        w = w + np.linalg.solve(hessian, gradient)
    return w


def labelled_rows(docs: DataFrame, labels: DataFrame, rules: ToxicityRules) -> DataFrame:
    """(text, toxic) of at most label_rows labelled documents of the learning part. docs: (doc_id, text)."""
    own = labels.where("doc_id is not null and toxic is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    chosen = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.label_rows)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most label_rows ids


def learn(docs: DataFrame, labels: DataFrame, rules: ToxicityRules) -> tuple[Arcs, np.ndarray]:
    rows = labelled_rows(docs, labels, rules)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, toxic = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode().lower().translate(bytes(32 if _LETTERS[i] else i for i in range(256)))
                own = set()
                for w in set(raw.split(b" ")) - {b""}:
                    own.add((w.decode(), 0))
                    own.update((w[:n].decode(), n) for n in BEGINNINGS if len(w) >= n and (len(w) == n or w[n] & 0xC0 != 0x80))
                seen.update(own)
                if y:
                    toxic.update(own)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], names=["word", "n", "docs", "toxic"])

    totals = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    every, bad = int(totals[0]), int(totals[1])
    words = rows.mapInArrow(count, "word string, n int, docs long, toxic long").groupBy("word", "n").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("docs") - F.col("toxic") + 0.5) / (every - bad + 1.0))
    best = words.where(F.col("toxic") >= rules.least_docs).withColumn("odds", odds).where(F.col("odds") >= rules.least_odds).orderBy(F.col("odds").desc(), "word", "n").limit(rules.lexicon).collect()
    arcs = arcs_of([(r["word"], r["n"], min(float(r["odds"]), 8.0)) for r in best])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(0)):
                f = score_clauses(data, offsets, arcs, rules.negation_reach)
                yield pa.RecordBatch.from_arrays([*(pa.array(f[:, k]) for k in range(3)), batch.column(1).slice(first, last - first)], names=["a", "b", "c", "toxic"])

    # at most label_rows rows of four numbers
    seen = rows.mapInArrow(features, "a double, b double, c double, toxic int").toPandas()
    return arcs, fit_curve(seen[["a", "b", "c"]].to_numpy(float), (seen["toxic"] > 0).to_numpy(float))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ToxicityRules | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses (matched) for each row of docs. labels: (doc_id, toxic)."""
    rules = rules or ToxicityRules()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    arcs, curve = learn(rows, labels, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                f = score_clauses(data, offsets, arcs, rules.negation_reach)
                score = 1 / (1 + np.exp(-np.clip(_design(f) @ curve, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(score), pa.array((score >= rules.threshold).astype(np.int32)), pa.array(f[:, 2].astype(np.int64))], names=["doc_id", "score", "predicted", "n_clauses"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_clauses long")
    return scored.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "n_clauses")
