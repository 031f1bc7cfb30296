"""Review work on datasets: queues, samples, verdicts, leakage pairs and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.scalars import case
from loomwork.operators.components import connected_components
from loomwork.operators.merging import reused_ids
from loomwork.operators.relational import hamming_pairs, ranked


def without(df: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the ledger does not exclude."""
    return df.join(ledger.select(*keys).distinct(), keys, "left_anti")


def parted(df: DataFrame, ladder: list[tuple[Column, str]], otherwise: str = "kept") -> DataFrame:
    """df with outcome: the first rule that holds names why a row is skipped, so that both branches can be written."""
    return df.withColumn("outcome", case([(F.coalesce(c, F.lit(False)), name) for c, name in ladder], otherwise))


def usable_annotations(annotations: DataFrame, categories: DataFrame, least: float = 0.5) -> DataFrame:
    """annotations with outcome: unknown category, a side of at most `least`, or kept. annotations: (category_id, w, h, ...)."""
    c = categories.select(F.col("id").alias("__c")).distinct()
    joined = annotations.join(c, F.col("category_id") == F.col("__c"), "left")
    return parted(joined, [(F.col("__c").isNull(), "unknown_category"), (~((F.col("w") > least) & (F.col("h") > least)), "degenerate")]).drop("__c")


def full_match(manifest: DataFrame, predictions: DataFrame, key: str, equal: list[str]) -> DataFrame:
    """(key, problem): keys on one side only, twice on a side, or with differing fields; no rows for a 1:1 match."""
    m = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("mn"), *[F.min(c).alias(f"m_{c}") for c in equal])
    p = predictions.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("pn"), *[F.min(c).alias(f"p_{c}") for c in equal])
    both = m.join(p, F.col(key) == F.col("__k"), "full_outer")
    ladder = [(F.col("mn").isNull(), "unexpected"), (F.col("pn").isNull(), "missing"), ((F.col("mn") > 1) | (F.col("pn") > 1), "repeated"), *[(~F.col(f"m_{c}").eqNullSafe(F.col(f"p_{c}")), c) for c in equal]]
    return both.select(F.coalesce(key, "__k").alias(key), case([*ladder], "").alias("problem")).where("problem <> ''")


def leakage_pairs(images: DataFrame, distance: int = 4) -> DataFrame:
    """(left, right, distance, confirmed, reason, pair_id) of images in different splits that are near, share a group or pixels.

    images: (key, pos, split, group_id, phash, pixel_hash); left comes first by pos.  Near hashes and equal pixels or
    groups each meet by an equality; pairs found in several ways count once.
    """
    i = images.select("key", "pos", "split", F.nullif("group_id", F.lit("")).alias("group_id"), "phash", "pixel_hash")
    # hashes meet once each; only images of different splits are spelt out
    side = lambda x: i.select(*[F.col(c).alias(f"{x}_{c}") for c in i.columns])
    nodes = i.groupBy("phash").agg(F.min("pos").alias("id"))
    near = hamming_pairs(nodes, "id", "phash", distance).select("a", "b")
    near = near.union(near.select("b", "a")).union(nodes.select(F.col("id").alias("a"), F.col("id").alias("b")))
    by_hash = near.join(nodes.select(F.col("id").alias("a"), F.col("phash").alias("ha")), "a").join(nodes.select(F.col("id").alias("b"), F.col("phash").alias("hb")), "b").select("ha", "hb")
    ordered = (F.col("l_pos") < F.col("r_pos")) & (F.col("l_split") != F.col("r_split"))
    found = side("l").join(by_hash, F.col("l_phash") == F.col("ha")).join(side("r"), F.col("r_phash") == F.col("hb")).where(ordered).drop("ha", "hb")
    for c in ("pixel_hash", "group_id"):
        found = found.union(side("l").join(side("r"), F.col(f"l_{c}") == F.col(f"r_{c}")).where(ordered).select(found.columns))
    exact, group = F.col("l_pixel_hash").eqNullSafe(F.col("r_pixel_hash")) & F.col("l_pixel_hash").isNotNull(), F.coalesce(F.col("l_group_id") == F.col("r_group_id"), F.lit(False))
    reason = F.when(exact, "identical pixels").when(group, "group_id burst leak").otherwise("perceptual similarity")
    apart = F.bit_count(F.col("l_phash").bitwiseXOR(F.col("r_phash")))
    name = F.substring(F.sha2(F.concat_ws("|", F.concat_ws("/", "l_split", "l_key"), F.concat_ws("/", "r_split", "r_key")), 256), 1, 16)
    return found.distinct().select(F.col("l_key").alias("left"), F.col("r_key").alias("right"), apart.alias("distance"), (exact | group).alias("confirmed"), reason.alias("reason"), name.alias("pair_id"))


def similar_clusters(images: DataFrame, distance: int = 4) -> DataFrame:
    """(node, component) of images of one source or within the hash distance, single ones too. images: (pos, source, phash)."""
    first = images.where("source is not null").groupBy(F.col("source").alias("__s")).agg(F.min("pos").alias("hub"))
    stars = images.join(first, F.col("source") == F.col("__s")).select(F.col("hub").alias("src"), F.col("pos").alias("dst"))
    near = hamming_pairs(images, "pos", "phash", distance).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = connected_components(stars.union(near))
    return images.select(F.col("pos").alias("p")).join(found, F.col("p") == F.col("node"), "left").select(F.col("p").alias("node"), F.coalesce("component", "p").alias("component"))


def named_clusters(members: DataFrame, name: str, least: int = 2) -> DataFrame:
    """(component, size, first): clusters of at least `least` members, largest first, then by the first name."""
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min(name).alias("first")).where(F.col("size") >= least).orderBy(F.col("size").desc(), "first")


def active_pairs(pairs: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Pairs (left, right, ...) neither end of which is excluded."""
    out = pairs
    for end in ("left", "right"):
        out = out.join(excluded.select(F.col(key).alias(end)).distinct(), end, "left_anti")
    return out.select(*pairs.columns)


def reconciled_pairs(pairs: DataFrame, excluded: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Active pairs with their views: exact, related, risk (distance at most 2, not exact) and unresolved (classes differ, no resolution).

    pairs: (pair_id, left, right, distance, same_pixels, visual_match, cross_class); resolved: (pair_id).
    """
    same = F.coalesce("same_pixels", F.lit(False))
    r = resolved.select(F.col("pair_id").alias("__r")).distinct()
    act = active_pairs(pairs, excluded, key).join(r, F.col("pair_id") == F.col("__r"), "left")
    return act.select(*pairs.columns, same.alias("exact"), (F.coalesce("visual_match", F.lit(False)) & ~same).alias("related"), ((F.col("distance") <= 2) & ~same).alias("risk"), (F.coalesce("cross_class", F.lit(False)) & F.col("__r").isNull()).alias("unresolved"))


def kept_sample(rows: DataFrame, sample: DataFrame, key: str, label: str, turn: Column, want: int = 60) -> DataFrame:
    """(key, label, replacement): the sampled rows that are still there, filled up to min(want, rows) per label in the order of `turn`."""
    s = sample.select(F.col(key).alias("__s")).distinct()
    marked = rows.join(s, F.col(key) == F.col("__s"), "left").withColumn("replacement", F.col("__s").isNull())
    kept = marked.where(~F.col("replacement"))
    have = kept.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__have"))
    # at most `want` rows of a label are taken, so ranks beyond it need no order
    spare = ranked(marked.where("replacement").withColumn("__turn", turn), [label], [F.col("__turn"), F.col(key)]).where(F.col("rank") <= want)
    filled = spare.join(F.broadcast(have), F.col(label) == F.col("__l"), "left").where(F.col("rank") <= want - F.coalesce("__have", F.lit(0)))  # one row a label
    return kept.select(key, label, "replacement").union(filled.select(key, label, "replacement"))


def review_selection(rows: DataFrame, key: str, strata: list[str], mandatory: dict[str, Column], turn: Column, rate: float, minimum: int) -> DataFrame:
    """(key, reasons): rows with a mandatory reason, and min(n, max(ceil(n * rate), minimum)) sampled rows of each stratum."""
    must = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in mandatory.items()]))
    n = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in strata]).agg(F.greatest(F.ceil(F.count(F.lit(1)) * rate), F.lit(minimum)).alias("want"))
    on = F.lit(True)
    for c in strata:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = ranked(rows.withColumn("reasons", must).withColumn("__turn", turn), strata, [F.col("__turn"), F.col(key)]).join(F.broadcast(n), on)  # one row a stratum
    picked = F.when(F.col("rank") <= F.col("want"), F.array_append("reasons", F.lit("stratified_sample"))).otherwise(F.col("reasons"))
    return placed.select(key, F.array_sort(picked).alias("reasons")).where(F.size("reasons") > 0)


def applied_edits(edited: DataFrame, template: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """What a person's box table changes: (image_id, pos or ann_id, outcome) with reused, new and removed boxes.

    edited: (image_id, pos, label, x, y, w, h); template: (image_id, ann_id, label, x, y, w, h); corners are repaired before.
    """
    matched = reused_ids(edited, template, tolerance)
    used = matched.where("old_id is not null").select(F.col("old_id").alias("ann_id"))
    gone = template.join(used, "ann_id", "left_anti").select("image_id", F.lit(None).cast("long").alias("pos"), F.col("ann_id").cast("long").alias("ann_id"), F.lit("removed").alias("outcome"))
    return matched.select("image_id", F.col("pos").cast("long").alias("pos"), F.col("old_id").cast("long").alias("ann_id"), F.when(F.col("old_id").isNull(), "new").otherwise("reused").alias("outcome")).unionByName(gone)


def applied_verdicts(boxes: DataFrame, references: DataFrame, removed_images: DataFrame, edits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """boxes with action and kept: reference boxes, then image removal, then a box edit, then the verdict decide.

    boxes: (image_id, ann_id, ...); references, removed_images: (image_id); edits: (ann_id); verdicts: (ann_id, verdict).
    """
    flag = lambda df, key, name: df.select(F.col(key).alias(f"__{name}")).distinct().withColumn(name, F.lit(True))
    out = boxes
    for df, key, name in ((references, "image_id", "is_reference"), (removed_images, "image_id", "is_removed"), (edits, "ann_id", "is_edited")):
        out = out.join(flag(df, key, name), F.col(key) == F.col(f"__{name}"), "left").drop(f"__{name}")
    v = verdicts.groupBy(F.col("ann_id").alias("__v")).agg(F.max("verdict").alias("verdict"))
    out = out.join(v, F.col("ann_id") == F.col("__v"), "left").drop("__v")
    ladder = [(F.col("is_reference"), "reference"), (F.col("is_removed"), "image_removed"), (F.col("is_edited"), "edited"), (F.col("verdict") == "remove", "removed"), (F.col("verdict").isNotNull(), "kept")]
    out = out.withColumn("action", case([(F.coalesce(c, F.lit(False)), k) for c, k in ladder], "unreviewed"))
    return out.select(*boxes.columns, "action", (~F.col("action").isin("image_removed", "removed")).alias("kept"))


def with_review(queue: DataFrame, reviews: DataFrame, key: str, reason: str) -> DataFrame:
    """queue with the review as a struct; `reason` joins the reasons of rows that have one. queue: (key, reasons, ...)."""
    r = reviews.select(F.col(key).alias("__k"), F.struct(*[c for c in reviews.columns if c != key]).alias("review"))
    both = queue.join(r, F.col(key) == F.col("__k"), "left").drop("__k")
    return both.withColumn("reasons", F.when(F.col("review").isNotNull(), F.array_sort(F.array_union("reasons", F.array(F.lit(reason))))).otherwise(F.col("reasons")))


def draft_boxes(queue: DataFrame, model: DataFrame, references: DataFrame, source: str) -> DataFrame:
    """(image_id, basis, box columns): reference boxes for images of one source, model boxes for the others. queue: (image_id, source)."""
    of = lambda rows, boxes, basis: rows.select("image_id").join(boxes, "image_id").withColumn("basis", F.lit(basis))
    return of(queue.where(F.col("source") != source), model, "model").unionByName(of(queue.where(F.col("source") == source), references, "reference"))


def label_corrections(promoted: DataFrame, label: str, reviewed: str) -> DataFrame:
    """Rows whose source label is not among the reviewed ones ('a|b')."""
    return promoted.where(~F.array_contains(F.split(reviewed, r"\|"), F.col(label)))


def relabelled(source: DataFrame, current: DataFrame, overrides: DataFrame, key: str, label: str) -> DataFrame:
    """(key, was, now, documented): labels that changed, and whether an override says so."""
    c = current.select(F.col(key).alias("__k"), F.col(label).alias("now"))
    o = overrides.select(F.col(key).alias("__o"), F.col(label).alias("__to")).distinct()
    changed = source.select(key, F.col(label).alias("was")).join(c, F.col(key) == F.col("__k")).where("was <> now")
    return changed.join(o, (F.col(key) == F.col("__o")) & (F.col("now") == F.col("__to")), "left").select(key, "was", "now", F.col("__o").isNotNull().alias("documented"))


def scene_stats(images: DataFrame, boxes: DataFrame, tiny: float = 0.0025) -> DataFrame:
    """(image_id, boxes, max_area, tiny): boxes of each image, none too. images: (image_id, width, height); boxes: (image_id, w, h)."""
    b = images.select("image_id", "width", "height").join(boxes.select(F.col("image_id").alias("__i"), "w", "h"), F.col("image_id") == F.col("__i"), "left")
    area = F.coalesce(F.max(F.col("w") * F.col("h") / (F.col("width") * F.col("height"))), F.lit(0.0))
    out = b.groupBy("image_id").agg(F.count("__i").alias("boxes"), area.alias("area"))
    return out.select("image_id", "boxes", F.round("area", 6).alias("max_area"), (F.col("area") < tiny).alias("tiny"))


def before_and_after(rows: DataFrame, excluded: DataFrame, key: str, label: str) -> DataFrame:
    """(label, before, after, removed) with an exclusion ledger."""
    e = excluded.select(F.col(key).alias("__e")).distinct()
    marked = rows.join(e, F.col(key) == F.col("__e"), "left")
    out = marked.groupBy(label).agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("__e").isNull()).alias("after"))
    return out.withColumn("removed", F.col("before") - F.col("after"))


def neighbour_labels(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, neighbour_label, n, share): the labels around each label. neighbours: (query, neighbour); labels: (vec_id, label)."""
    side = lambda k, name: labels.select(F.col("vec_id").alias(k), F.col("label").alias(name))
    counts = neighbours.join(side("query", "label"), "query").join(side("neighbour", "neighbour_label"), "neighbour").groupBy("label", "neighbour_label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(F.col("label").alias("__l")).agg(F.sum("n").alias("__n"))
    return counts.join(total, F.col("label") == F.col("__l")).select("label", "neighbour_label", "n", (F.col("n") / F.col("__n")).alias("share"))


def worst_and_first(errors: DataFrame, key: str, count: str, worst: int, first: int) -> DataFrame:
    """(key, picked): the rows with most errors, and the first others by key."""
    top = errors.orderBy(F.col(count).desc(), key).limit(worst).select(key)
    rest = errors.join(F.broadcast(top), key, "left_anti").orderBy(key).limit(first).select(key)  # at most `worst` rows
    return top.withColumn("picked", F.lit("error")).union(rest.withColumn("picked", F.lit("first")))
