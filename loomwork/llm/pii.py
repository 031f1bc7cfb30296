"""Personal data by boosted candidates, in DataFrame functions only.

Base patterns find emails, addresses, cards and phone numbers; these spans always stay.
High-recall generators propose further, overlapping spans (spelled-out emails, cards and
phone numbers in other formats, defanged addresses, secrets).  Every proposal has a few
small integer features of its format and context.  Boosted trees are trained on the
counts of each feature combination over half of all documents, by a hash of the id (a table bounded by the product
of the feature ranges, never rows), with the validated base spans and the proposals that
their format's validator accepts as positive examples and the others as negative ones.
A score is accepted for a kind if at least `precision` of the proposals of the other half
with just that score that cross no base span are positive (of all documents where the
other half has none), so neither base spans nor other formats decide over a format.  Of proposals that overlap, the base span and then the better
score wins.

Defined results: a null text counts as empty and has no spans; positions are code
points, end exclusive; an empty table gives no rows and trains no trees; rows that
repeat are judged one by one; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.boosting import boost, margin_column
from loomwork.store import stored

KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns. Possessive loops and a look behind keep them linear on long runs without changing any match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?:\.| \. ?| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\[?\.\]?[0-9]{1,3}+){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+])(?:\+|00|\()[0-9][\x20().0-9/-]{5,24}[0-9](?![0-9])",
    "secret": r"(?i)(?:token|password|passwd|secret|api[_-]?key)[\x20]{0,3}[=:][\x20]{0,3}[\x22']?[A-Za-z0-9+/_-]{8,}+={0,2}+",
}
#: What a text must hold for its patterns to be tried at all.
NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\]?\[?\.\]?[0-9]", "card": r"[0-9][\x20._/-]?[0-9][\x20._/-]?[0-9][\x20._/-]?[0-9]", "phone": r"\+[0-9]|00[0-9]|\([0-9]", "secret": r"[=:]"}
CONTEXT = r"(?i)card|visa|phone|tel|call|mail|contact|address|token|key|pass|secret|\bip\b"
FEATURES = ("kind", "digits", "luhn", "octets", "mixed", "plus", "spelled", "joined", "context", "formed")


@dataclass(frozen=True)
class PiiRules:
    precision: float = 0.95
    rounds: int = 20
    depth: int = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def in_runs(items: Column) -> Column:
    """An array (not empty) cut into about as many runs as a run has items, so that a fold over runs of folds stays far from quadratic."""

    def cut(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda i: F.slice(x, i * width + 1, width))

    return let(items, cut)


def found_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s, before, after>> of the leftmost non-overlapping matches; before holds up to 24 characters, back to the start of the match before, after the next one."""
    kind = "array<struct<start:int,end:int,s:string,before:string,after:string>>"
    empty = F.expr(f"cast(array() as {kind})")

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("s"), F.right(F.concat(x["last"], x["g"]), F.lit(24)).alias("before"), F.left(F.concat(x["gap"], x["next"]), F.lit(1)).alias("after")))).alias("out"))

    def shifted(a: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda x: F.struct((x["start"] + a["at"]).alias("start"), (x["end"] + a["at"]).alias("end"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after")))
        return F.struct((a["at"] + run["at"]).alias("at"), F.concat(a["out"], F.array(moved)).alias("out"))

    def zipped(matches: Column) -> Column:
        n, none = F.size(matches), F.array(F.lit(""))
        around = {"last": F.concat(none, F.slice(matches, F.lit(1), n - 1)), "next": F.concat(F.slice(matches, F.lit(2), n), none)}
        return let(F.split(text, pattern, -1), lambda gaps: F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("g"), F.slice(gaps, F.lit(2), n).alias("gap"), matches.alias("m"), *(c.alias(k) for k, c in around.items())))

    def placed(matches: Column) -> Column:
        runs = F.transform(in_runs(zipped(matches)), lambda run: F.aggregate(run, F.struct(F.lit(0).alias("at"), empty.alias("out")), step))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        return F.when(F.size(matches) > 0, F.aggregate(runs, start, shifted, lambda a: F.flatten(a["out"]))).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def in_reach(spans: Column) -> Column:
    """Spans, sorted by start (in each kind), in runs with the stretch of text each run covers."""
    runs = F.transform(in_runs(spans), lambda run: F.struct(F.array_min(F.transform(run, lambda s: s["start"])).alias("start"), F.array_max(F.transform(run, lambda s: s["end"])).alias("end"), run.alias("spans")))
    return F.when(F.size(spans) > 0, runs)


def meets(reach: Column, x: Column, test: Callable[[Column], Column]) -> Column:
    """Whether a span of `reach` that crosses x passes the test; runs elsewhere in the text are passed over."""
    return F.coalesce(F.exists(reach, lambda run: crosses(run, x) & F.exists(run["spans"], lambda s: crosses(s, x) & test(s))), F.lit(False))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    def step(a: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def octets_fit(s: Column) -> Column:
    trimmed = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(s, r"\."), lambda p: (F.length(trimmed(p)) <= 3) & (trimmed(p).try_cast("int") <= 255))


def is_card(s: Column) -> Column:
    return let(digits_of(s), lambda d: F.when(F.length(d).between(16, 19), passes_luhn(d)).otherwise(False))


VALID = {"email": lambda s: F.lit(True), "ip": octets_fit, "card": is_card, "phone": lambda s: F.length(digits_of(s)).between(8, 15)}


def issued(digits: Column) -> Column:
    """Whether a number has the length and the Luhn sum of a card; below 16 digits also an issuer's prefix."""

    def holds(d: Column) -> Column:
        prefix = d.rlike("^(?:4[0-9]{12}|3(?:0[0-5]|[689][0-9])[0-9]{11}|3[47][0-9]{13}|(?:1800|2131)[0-9]{11})$")
        return F.when(F.length(d).between(16, 19) | prefix, passes_luhn(d)).otherwise(False)

    return let(digits, holds)


def is_spelled_email(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:(?:\.| \. ?| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]+)*(?:\.| \. ?| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z]{2,24}$")


def is_phone_form(s: Column) -> Column:
    """+, 00 or a closed area code; 16 to 19 digits without separators are a card's format."""
    return s.rlike(r"^(?:\+|00[\x20().-]*[1-9]|\([0-9]{1,5}\))") & ~s.rlike("^[0-9]{16,}$")


def is_foreign_phone(s: Column) -> Column:
    return is_phone_form(s) & F.length(F.regexp_replace(digits_of(s), "^00", "")).between(8, 15)


#: Validators of the further formats.
ACCEPTED = {"email": is_spelled_email, "ip": lambda s: octets_fit(F.regexp_replace(s, r"\[\.\]", ".")), "card": lambda s: issued(digits_of(s)), "phone": is_foreign_phone}


def base_spans(text: Column) -> Column:
    """All base spans, by kind and then start, as array<struct<kind:int, start, end>>."""
    parts = []
    for k, kind in enumerate(BASE):
        some = F.when(text.rlike(NEEDS[kind]), found_spans(text, BASE[kind]))
        valid, number = VALID[kind], F.lit(k).alias("kind")
        good = F.filter(some, lambda x: valid(x["s"]))  # noqa: B023
        parts.append(F.coalesce(F.transform(good, lambda x: F.struct(number, x["start"].alias("start"), x["end"].alias("end"))), F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")))
    return F.concat(*parts)


def crosses(s: Column, x: Column) -> Column:
    return (s["start"] < x["end"]) & (x["start"] < s["end"])


def proposals(text: Column, reach: Column) -> Column:
    """Proposed spans with features, whether they cross no base span (fresh), and whether a validator accepts them (known: a base span, a mixed secret, or a fresh span of a valid format)."""
    parts = []
    for k, kind in enumerate(MORE):
        some = F.when(text.rlike(NEEDS[kind]), found_spans(text, MORE[kind]))

        def described(x: Column) -> Column:
            digits = digits_of(x["s"])
            n = F.length(digits)
            value = F.regexp_extract(x["s"], r"[A-Za-z0-9+/_-]++={0,2}+$", 0)
            mixed = (kind == "secret") & (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") if kind == "secret" else F.lit(False)
            joins = F.right(x["before"], F.lit(1)).rlike("[A-Za-z0-9]") | x["after"].rlike("[A-Za-z0-9]")
            features = {
                "digits": F.least(F.floor(n / 2), F.lit(10)),
                "luhn": issued(digits),
                "octets": octets_fit(F.regexp_replace(x["s"], r"[\[\]]", "")) if kind == "ip" else F.lit(False),
                "mixed": mixed,
                "plus": F.startswith(x["s"], F.lit("+")),
                "spelled": x["s"].rlike(r"[\x20()./-]" if kind == "phone" else r"[\[(](?:at|dot)[\])]| |[\[\]]"),
                "joined": joins,
                "formed": is_phone_form(x["s"]) if kind == "phone" else is_spelled_email(x["s"]) if kind == "email" else F.lit(True),
                "context": x["before"].rlike(CONTEXT) if kind != "secret" else F.lit(True),
            }
            fresh = ~meets(reach, x, lambda b: F.lit(True))
            known = meets(reach, x, lambda b: (b["kind"] == k) & (b["start"] == x["start"]) & (b["end"] == x["end"])) | (mixed if kind == "secret" else fresh & ~joins & ACCEPTED[kind](x["s"]))
            return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), known.alias("known"), fresh.alias("fresh"), *(features[f].cast("int").alias(f) for f in FEATURES[1:]))

        kinds = "array<struct<kind:int,start:int,end:int,known:boolean,fresh:boolean," + ",".join(f"{f}:int" for f in FEATURES[1:]) + ">>"
        parts.append(F.coalesce(F.transform(some, described), F.expr(f"cast(array() as {kinds})")))
    return F.concat(*parts)


def trained(found: DataFrame, rules: PiiRules) -> tuple[list, dict[int, list[tuple[float, float]]]]:
    """Trees and the accepted ranges of margins of each kind, from counts of feature combinations."""
    each = found.select(F.explode("more").alias("x"), F.col("held_out").cast("int").alias("held"))
    known, fresh, held = F.col("x.known").cast("int"), F.col("x.fresh").cast("int"), F.col("held")
    parts = {"n": 1 - held, "good": known * (1 - held), "n_fresh": fresh, "good_fresh": known * fresh, "n_held": fresh * held, "good_held": known * fresh * held}
    counts = each.groupBy(*(F.col(f"x.{f}").alias(f) for f in FEATURES)).agg(*(F.sum(part).alias(c) for c, part in parts.items()))
    # at most the product of the feature ranges
    rows = counts.orderBy(*FEATURES).collect()
    x = np.array([[r[f] or 0 for f in FEATURES] for r in rows], int).reshape(-1, len(FEATURES))
    n, good, n_fresh, good_fresh, n_held, good_held = (np.array([r[c] or 0 for r in rows], float) for c in parts)
    trees, margin = boost(x, list(FEATURES), good, n, rules.rounds, rules.depth)
    ranges: dict[int, list[tuple[float, float]]] = {k: [] for k in range(len(KINDS))}
    for k in ranges:
        before = False
        for level in np.unique(margin[(x[:, 0] == k) & (n_fresh > 0)]):
            own = (x[:, 0] == k) & (margin == level)
            seen, right = (n_held, good_held) if n_held[own].sum() else (n_fresh, good_fresh)
            if accepted := right[own].sum() >= rules.precision * seen[own].sum():
                ranges[k][-1:] = [(ranges[k][-1][0], float(level))] if before else [*ranges[k][-1:], (float(level), float(level))]
            before = accepted
    return trees, ranges


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: PiiRules | None = None) -> DataFrame:
    """doc_id, base (spans), added (spans), n_added for each row of docs; a span is (kind index, start, end)."""
    rules = rules or PiiRules()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    located = rows.withColumn("base", base_spans(F.col("text"))).withColumn("reach", in_reach(F.col("base")))
    found = stored(located.select("doc_id", "base", proposals(F.col("text"), F.col("reach")).alias("more"), (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(2)) == 1).alias("held_out")))
    trees, ranges = trained(found, rules)
    margin = lambda x: margin_column(trees, {f: x[f] for f in FEATURES})
    bounds = F.array(*(F.array(*(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in ranges[k] or [(1.0, 0.0)])) for k in range(len(KINDS))))
    fresh = F.filter("more", lambda x: x["fresh"])
    scored = F.transform(fresh, lambda x: F.struct((-margin(x)).alias("cost"), x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    scored = F.filter(scored, lambda x: F.exists(F.element_at(bounds, x["kind"] + 1), lambda b: (b["low"] <= -x["cost"]) & (-x["cost"] <= b["high"])))
    by_start = F.array_sort(F.transform("scored", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    out = found.withColumn("scored", F.array_sort(scored)).withColumn("reach", in_reach(by_start))
    rival = lambda x: meets(F.col("reach"), x, lambda s: s["kind"] != x["kind"])  # noqa: E731  spans of one kind never cross
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    span = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    alone = F.transform(F.filter("scored", lambda x: ~rival(x)), span)
    best = F.aggregate(F.filter("scored", rival), none, lambda a, x: F.when(F.exists(a, lambda s: crosses(s, x)), a).otherwise(F.concat(a, F.array(span(x)))))
    return out.select("doc_id", "base", F.concat(alone, best).alias("added"))


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: PiiRules | None = None) -> DataFrame:
    """doc_id, counts of the base spans, base_sha256, spans (base and added), n_added, n_spans (all)."""
    found = personal_data(docs, id_col, text_col, rules)
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
