"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the n-grams that a text holds twice
or more; the characters of words inside them, and of repeated lines, are measured
as shares of the text's word characters.  Each text is judged alone in one pass
over Arrow batches: no shuffle, memory of one 1 MB chunk (or one longer text).

Defined results: a null text counts as empty; an empty or blank text has no words
and fails the base rule; repeated rows are judged one by one; columns other than
the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomwork.llm.textarrays import _SPACE, chunks, lines_of, sums_by_text, text_of, window_hash, words_of

BASE_WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Largest shares of word characters that a kept text may have inside repeats.

    ``coverage`` maps n-gram lengths (all at least ``min(coverage)``) to limits; ``line_chars``
    limits characters of lines equal to an earlier one; ``symbols`` limits symbol characters per word.
    """

    min_words: int = 20
    repeat_percent: int = 30
    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.45, 6: 0.40, 8: 0.35, 10: 0.32})
    line_chars: float = 0.30
    symbols: float = 0.10


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return out
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _covered(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Which words lie inside a window of n words that its text holds twice or more."""
    covered = np.zeros(len(hashes), bool)
    keys = window_hash(hashes, n)
    if not len(keys):
        return covered
    text = text_of(first)
    at = np.flatnonzero(text[: len(keys)] == text[n - 1 :])
    # the text is part of the key, so texts of a chunk are told apart
    keys = keys[at] + (text[at] + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    starts = at[_repeated(keys)]
    if len(starts):
        edges = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + n, -1)
        covered = np.cumsum(edges[:-1]) > 0
    return covered


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text of a chunk; cover_n: word characters inside repeated n-grams."""
    words, lines = words_of(data, offsets, lower=False), lines_of(data, offsets)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    chars = leads[words.end] - leads[words.start]
    out = {
        "n_words": np.diff(words.first),
        "word_chars": sums_by_text(chars, words.first),
        "n_chars": leads[offsets[1:]] - leads[offsets[:-1]],
        "n_symbols": sums_by_text(_SYMBOL[data].astype(np.int64), offsets),
    }
    filled = np.concatenate([[0], np.cumsum(~_SPACE[data])])
    line_chars = filled[lines.end] - filled[lines.start]
    at = np.flatnonzero(line_chars > 0)
    text = text_of(lines.first)
    keys = lines.hash[at] + (text[at] + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(keys, kind="stable")  # an equal line that comes later follows
    again = np.zeros(len(lines.hash), np.int64)
    again[at[order[1:][keys[order[1:]] == keys[order[:-1]]]]] = 1
    out["n_dup_lines"] = sums_by_text(again, lines.first)
    widths = leads[lines.end] - leads[lines.start]
    out["dup_line_chars"] = sums_by_text(again * widths, lines.first)
    base = _covered(words.hash, words.first, BASE_WINDOW)
    out["n_repeat_words"] = sums_by_text(base.astype(np.int64), words.first)
    for n in lengths:
        covered = base if n == BASE_WINDOW else _covered(words.hash, words.first, n)
        out[f"cover_{n}"] = sums_by_text(np.where(covered, chars, 0), words.first)
    return out


def verdicts(m: dict[str, np.ndarray], rules: RepetitionRules) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.repeat_percent * m["n_words"])
    chars = np.maximum(m["word_chars"], 1)
    bad = (m["dup_line_chars"] > rules.line_chars * np.maximum(m["n_chars"], 1)) | (m["n_symbols"] > rules.symbols * m["n_words"])
    for n, limit in rules.coverage.items():
        bad |= m[f"cover_{n}"] > limit * chars
    return failed, ~failed & ~bad


def _measured(texts: pa.Array, rules: RepetitionRules) -> dict[str, np.ndarray]:
    lengths = tuple(rules.coverage)
    parts = []
    for _, _, data, offsets in chunks(texts):
        m = measure(data, offsets, lengths)
        m["base_failed"], m["kept"] = verdicts(m, rules)
        parts.append(m)
    names = (*MEASURES, "dup_line_chars", *(f"cover_{n}" for n in lengths), "base_failed", "kept")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def repetition_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """One row for each row of docs: the id, the measures, base_failed and kept."""
    rules = rules or RepetitionRules()
    covers = [f"cover_{n}" for n in rules.coverage]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _measured(batch.column(1), rules)
            names = [*MEASURES, "dup_line_chars", *covers]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k], pa.int64()) for k in names), *(pa.array(m[k].astype(bool)) for k in ("base_failed", "kept"))], names=[id_col, *names, "base_failed", "kept"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(k, T.LongType()) for k in (*MEASURES, "dup_line_chars", *covers)), *(T.StructField(k, T.BooleanType()) for k in ("base_failed", "kept"))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def drop_repetitive(docs: DataFrame, text_col: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    rules = rules or RepetitionRules()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_measured(batch.column(at), rules)["kept"].astype(bool)))

    return docs.mapInArrow(run, docs.schema)
