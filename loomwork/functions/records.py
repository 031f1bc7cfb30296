"""Manifest records and reviews: taxonomies, digests, parsed answers and decision ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.scalars import case


def taxonomy_label(raw: Column, scientific: Column, named: list[str], generic: str, aliases: list[str] | None = None) -> Column:
    """The class if it is a named one, else the scientific name if that is, else the generic class; aliases of it come first."""
    return F.when(raw.isin(generic, *(aliases or [])), generic).when(raw.isin(named), raw).when(scientific.isin(named), scientific).otherwise(generic)


def pixel_hash(width: Column, height: Column, pixels: Column, separator: str = "") -> Column:
    """SHA-256 of '{width}x{height}', a separator and the pixel bytes."""
    return F.sha2(F.concat(F.encode(F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(separator)), "utf-8"), pixels.cast("binary")), 256)


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the row's compact JSON with keys in name order; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def source_stem(name: Column) -> Column:
    """A file name without the suffix that augmentation tools add (.rf. and what follows)."""
    return F.regexp_replace(name, r"\.rf\..*$", "")


def fenced_json(answer: Column, schema: str) -> Column:
    """The JSON object of an answer, with or without a code fence around it; null where it does not parse."""
    return F.from_json(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", ""), schema)


def hash_turn(seed: str, key: Column) -> Column:
    """Sort key: SHA-256 of the seed, a NUL and the key."""
    return F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), key.cast("string")), 256)


def masked(text: Column, secrets: list[str]) -> Column:
    """text without the given secret values and without the values of secret URL parameters."""
    for s in sorted((s for s in secrets if s), key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    return F.regexp_replace(text, r"(?i)([?&](?:token|key|secret|password)=)[^&\s]+", "$1[REDACTED]")


def flat_losses(losses: Column, prefix: str = "loss") -> Column:
    """array<struct<name, value>> of a map of arrays: prefix/key/index, by key."""
    keys = F.array_sort(F.map_keys(losses))
    of_key = lambda k: F.transform(F.element_at(losses, k), lambda v, i: F.struct(F.concat_ws("/", F.lit(prefix), k, i.cast("string")).alias("name"), v.cast("double").alias("value")))
    return F.flatten(F.transform(keys, of_key))


def review_priority(conflict: Column, uncertain: Column, count: Column, blind_count: Column, second: Column, bucket: Column, missed: Column, verdicts: Column) -> Column:
    """struct(rank, category) of a reviewed image; the first rule that holds. verdicts: array of box verdicts, the best box first."""
    none, top = count == 0, F.try_element_at(verdicts, F.lit(1))
    ladder = [
        (conflict, 1, "reference_conflict"),
        (uncertain | (count != blind_count), 1, "overlay_original_disagreement"),
        (none & (second == "YES"), 1, "high_model_disagreement"),
        (none & (second == "NO") & (bucket == "passed"), 1, "passed_likely_empty_three_pass"),
        (none & (second == "NO"), 2, "likely_empty_three_pass"),
        (missed, 1, "missed_object"),
        ((bucket == "passed") & (top == "remove"), 1, "passed_top_box_disputed"),
        (none & (second == "NO_RESULT"), 2, "empty_two_low_high_unresolved"),
        (F.array_contains(verdicts, "adjust"), 2, "box_adjustment"),
        (F.array_contains(verdicts, "remove"), 3, "remove_proposals"),
    ]
    return F.struct(case([(c, n) for c, n, _ in ladder], 3).alias("rank"), case([(c, k) for c, _, k in ladder], "verify_boxes").alias("category"))


def draft_eligible(reference: Column, uncertain: Column, count: Column, blind_count: Column, missed: Column, second: Column) -> Column:
    """struct(eligible, reason): whether suggested removals may be drafted from a review."""
    reason = case([(reference, "reference_boxes"), (uncertain, "blind_original_uncertain"), (~count.eqNullSafe(blind_count), "scene_count_disagreement"), (missed, "possible_missed_object"), ((count == 0) & ~second.eqNullSafe(F.lit("NO")), "empty_not_confirmed_by_high_pass")], "overlay_and_original_agree")
    return F.struct((reason == "overlay_and_original_agree").alias("eligible"), reason.alias("reason"))


def visual_match(same_pixels: Column, correlation: Column, error: Column, inliers: Column, ratio: Column) -> Column:
    """Whether two images show the same scene: equal pixels, close correlation and error, or enough matched points."""
    close = (correlation >= 0.97) & (error <= 0.07)
    points = (inliers >= 25) & (ratio >= 0.55)
    return F.coalesce(same_pixels, F.lit(False)) | F.coalesce(close, F.lit(False)) | F.coalesce(points, F.lit(False))


def reference_conflict(top_verdict: Column, best_overlap: Column) -> Column:
    """The best box was to be kept, yet no reference box overlaps it by a half."""
    return (top_verdict == "keep") & (F.coalesce(best_overlap, F.lit(0.0)) < 0.5)
