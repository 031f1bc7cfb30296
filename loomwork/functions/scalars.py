"""Scalar expressions for manifests, reviews and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*cols: Column) -> Column:
    """The first column that is neither null nor empty; the last one as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def case(pairs: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    first, *rest = pairs
    out = reduce(lambda a, p: a.when(p[0], lit(p[1])), rest, F.when(first[0], lit(first[1])))
    return out.otherwise(lit(otherwise))


def score_bucket(score: Column, error: Column | None = None) -> Column:
    """high above 0.80, medium from 0.50, low above 0.20, else none; an error goes first."""
    out = [(score > 0.80, "high"), (score >= 0.50, "medium"), (score > 0.20, "low")]
    return case(([(error.isNotNull() & (error != ""), "error")] if error is not None else []) + out, "none")


def count_bin(n: Column, last: int = 4) -> Column:
    return F.when(n >= last, F.lit(f"{last}+")).otherwise(n.cast("string"))


def edge_bin(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bin [edge, next edge) of a value; 0 is below the first edge."""
    return sum(((value >= e).cast("int") for e in edges[1:]), (value >= edges[0]).cast("int"))


def ratio(a: Column, b: Column, none: float | None = 0.0) -> Column:
    """a / b; `none` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(none).cast("double"))


def f1_of(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def order_key(seed: str, key: Column) -> Column:
    """Hash order that any engine can repeat."""
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)


def pair_id(left: Column, right: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", left.cast("string"), right.cast("string")), 256), 1, 16)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_from_hex(h: Column) -> Column:
    """A 64-bit hash in 16 hex digits as a signed long."""
    return F.conv(h, 16, -10).cast("bigint")


def redacted(url: Column) -> Column:
    return F.regexp_replace(url, r"(?i)([?&](?:token|key|secret|password)=)[^&\s]+", "$1[REDACTED]")


def answer_word(text: Column) -> Column:
    """A leading YES, NO or UNCLEAR, bold or not; empty otherwise."""
    return F.regexp_extract(F.trim(text), r"^(?:\*\*)?(YES|NO|UNCLEAR)\b", 1)


def unsafe_path(path: Column) -> Column:
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")


def flags(pairs: dict[str, Column]) -> Column:
    """The sorted names of the conditions that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in pairs.items()])))
