"""Registered queries of detections, reviews, gates and splits over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import detections as dt
from loomwork.functions import records as rc
from loomwork.functions import scalars as sc
from loomwork.operators import coco, gates, merging, reviews, splits
from loomwork.operators import detection as det
from loomwork.operators import embeddings as emb
from loomwork.queries import _MATRIX, BOX, _box, _pairs, _t, query

# --- detections

_RAW = f"(SELECT image_id, ann_id, x - 20 AS x1, y - 10 AS y1, x - 20 + w AS x2, y - 10 + h AS y2, score * 1.02 AS score, CASE WHEN label = 11 THEN 1 ELSE 0 END AS class_id FROM {BOX})"
_CHECKED = f"""c AS (SELECT *, least(greatest(x1, 0), 500) AS a1, least(greatest(y1, 0), 400) AS b1, least(greatest(x2, 0), 500) AS a2, least(greatest(y2, 0), 400) AS b2 FROM {_RAW}),
k AS (SELECT *, CASE WHEN NOT (score BETWEEN 0 AND 1) THEN 'invalid_model_detection' WHEN class_id <> 0 THEN 'unexpected_model_class' WHEN a2 <= a1 OR b2 <= b1 THEN 'invalid_model_detection' END AS bad,
  a1 <> x1 OR b1 <> y1 OR a2 <> x2 OR b2 <> y2 OR a2 - a1 < 8 OR b2 - b1 < 8 OR a1 <= 1 OR b1 <= 1 OR a2 >= 499 OR b2 >= 399 AS poor FROM c),
i AS (SELECT image_id, count(*) FILTER (bad IS NULL) AS n, count(bad) AS rejected, max(score) FILTER (bad IS NULL) AS top, bool_or(bad = 'invalid_model_detection') AS inv, bool_or(bad = 'unexpected_model_class') AS cls, coalesce(bool_or(poor) FILTER (bad IS NULL), false) AS poor,
  string_agg(CAST(CAST(round(a1 + 2 * b1 + 3 * a2 + 4 * b2) AS BIGINT) AS VARCHAR), ',' ORDER BY score DESC, a1, b1, a2, b2) FILTER (bad IS NULL) AS boxes FROM k GROUP BY 1)"""


def _images(spark: SparkSession, sf: str) -> DataFrame:
    raw = _box(spark, sf).selectExpr("image_id", "struct(x - 20 AS x1, y - 10 AS y1, x - 20 + w AS x2, y - 10 + h AS y2, score * 1.02 AS score, CASE WHEN label = 11 THEN 1 ELSE 0 END AS class_id) AS d")
    # one row an image, as a detector gives them
    return raw.groupBy("image_id").agg(F.collect_list("d").alias("d"))


@query(f"""WITH {_CHECKED} SELECT image_id, n, rejected, coalesce(boxes, '') AS boxes,
concat_ws('|', CASE WHEN inv THEN 'invalid_model_detection' END, CASE WHEN rejected > 0 THEN 'invalid_model_detection_review' END, CASE WHEN n > 1 THEN 'multiple_detections' END, CASE WHEN n = 0 THEN 'no_detection_review' END, CASE WHEN poor THEN 'possible_poor_localization' END, CASE WHEN n > 0 THEN 'species_label_provisional_per_box' END, CASE WHEN cls THEN 'unexpected_model_class' END) AS flags,
CASE WHEN rejected > 0 OR top IS NULL THEN 'recheck_needed' WHEN top > 0.8 THEN 'passed' WHEN top >= 0.5 THEN 'probably_passed' ELSE 'recheck_needed' END AS bucket,
CASE WHEN rejected > 0 THEN 'invalid_model_detection' WHEN top IS NULL THEN 'no_detection_above_floor' WHEN top > 0.8 THEN 'score_above_0.80' WHEN top >= 0.5 THEN 'score_0.50_to_0.80' WHEN top > 0.2 THEN 'score_above_0.20_below_0.50' ELSE 'score_at_or_below_0.20' END AS reason FROM i""")
def p5_p16_p17_sanitised(spark: SparkSession, sf: str) -> DataFrame:
    i = _images(spark, sf).withColumn("c", dt.sanitised(F.col("d"), F.lit(500.0), F.lit(400.0)))
    kept = F.col("c.detections")
    b = dt.bucket_of(F.try_element_at(kept, F.lit(1))["score"], rejected=F.col("c.rejected"))
    total = lambda x: F.round(x["xyxy"][0] + 2 * x["xyxy"][1] + 3 * x["xyxy"][2] + 4 * x["xyxy"][3]).cast("long").cast("string")
    out = i.select("image_id", F.size(kept).cast("long").alias("n"), F.col("c.rejected").cast("long").alias("rejected"), F.array_join(F.transform(kept, total), ",").alias("boxes"), F.array_join(dt.review_flags(F.col("c")), "|").alias("flags"), b.alias("b"))
    return out.select("image_id", "n", "rejected", "boxes", "flags", "b.bucket", "b.reason")


@query(f"""WITH a AS (SELECT image_id, score, w * h / 200000 AS area, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, w * h / 200000 DESC) AS k FROM {BOX}),
g AS (SELECT image_id, count(*) FILTER (score >= 0.2) AS m, count(*) FILTER (score >= 0.05) AS s, max(area) FILTER (k = 1) AS top, coalesce(min(area) FILTER (score >= 0.2), 9) AS low FROM a GROUP BY 1)
SELECT image_id, concat_ws('|', CASE WHEN low < 0.001 THEN 'any_0.20_below_0.1pct' END, CASE WHEN low < 0.005 THEN 'any_0.20_below_0.5pct' END, CASE WHEN low < 0.01 THEN 'any_0.20_below_1pct' END, CASE WHEN s > 3 THEN 'more_than_three_0.05' END, CASE WHEN m > 3 THEN 'more_than_three_0.20' END,
CASE WHEN low < 0.005 OR m > 3 THEN 'small_or_many_priority' END, CASE WHEN low < 0.01 OR m > 3 THEN 'small_or_many_watchlist' END, CASE WHEN top < 0.001 THEN 'top_below_0.1pct' END, CASE WHEN top < 0.005 THEN 'top_below_0.5pct' END, CASE WHEN top < 0.01 THEN 'top_below_1pct' END, CASE WHEN m = 0 THEN 'zero_0.20_boxes' END) AS flags FROM g""")
def p7_p8_f7_volume_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), (-F.col("w") * F.col("h")).alias("a"), "score", (F.col("w") * F.col("h") / 200000).alias("area"))))
    return _box(spark, sf).groupBy("image_id").agg(d.alias("d")).select("image_id", F.array_join(sc.flags(dt.volume_flags(F.col("d"), F.lit(None).cast("string"))), "|").alias("flags"))


@query(f"""WITH b AS (SELECT ann_id, label, x - 0.04 AS x, y, w, h, CASE WHEN pos < 9 THEN pos ELSE 1 END AS o FROM {BOX}),
c AS (SELECT *, greatest(x, 0) AS l, greatest(y, 0) AS t FROM b WHERE x >= -0.05 AND y >= -0.05 AND x + w <= 600 + 0.05 AND y + h <= 500 + 0.05),
d AS (SELECT *, l + least(w, 600 - l) AS r, t + least(h, 500 - t) AS u FROM c),
e AS (SELECT ann_id, o, CASE o WHEN 2 THEN 600 - r WHEN 3 THEN 600 - r WHEN 5 THEN t WHEN 6 THEN 500 - u WHEN 7 THEN 500 - u WHEN 8 THEN t ELSE l END AS x1, CASE o WHEN 2 THEN 600 - l WHEN 3 THEN 600 - l WHEN 5 THEN u WHEN 6 THEN 500 - t WHEN 7 THEN 500 - t WHEN 8 THEN u ELSE r END AS x2,
  CASE o WHEN 3 THEN 500 - u WHEN 4 THEN 500 - u WHEN 5 THEN l WHEN 6 THEN l WHEN 7 THEN 600 - r WHEN 8 THEN l ELSE t END AS y1, CASE o WHEN 3 THEN 500 - t WHEN 4 THEN 500 - t WHEN 5 THEN r WHEN 6 THEN r WHEN 7 THEN 600 - l WHEN 8 THEN r ELSE u END AS y2 FROM d),
f AS (SELECT ann_id, x1 * 300 / CASE WHEN o IN (5, 6, 7, 8) THEN 500 ELSE 600 END AS a, x2 * 300 / CASE WHEN o IN (5, 6, 7, 8) THEN 500 ELSE 600 END AS b, y1 * 250 / CASE WHEN o IN (5, 6, 7, 8) THEN 600 ELSE 500 END AS c, y2 * 250 / CASE WHEN o IN (5, 6, 7, 8) THEN 600 ELSE 500 END AS d FROM e)
SELECT ann_id, round(a, 3) AS x, round(c, 3) AS y, round(b - a, 3) AS w, round(d - c, 3) AS h FROM f WHERE b - a > 0.5 AND d - c > 0.5""")
def p13_transformed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).selectExpr("ann_id", "x - 0.04 AS x", "y", "w", "h", "CASE WHEN pos < 9 THEN pos ELSE 1 END AS o")
    out = dt.transformed_box(tuple(F.col(c) for c in "xywh"), F.lit(600.0), F.lit(500.0), F.col("o"), F.lit(300), F.lit(250))
    return b.select("ann_id", out.alias("t")).where("t is not null").select("ann_id", *[F.round(F.col("t")[k], 3).alias(c) for k, c in enumerate("xywh")])


@query(f"""WITH b AS (SELECT ann_id, label, greatest(x - 30, 0) AS x, greatest(y - 30, 0) AS y, w, h FROM {BOX}), c AS (SELECT ann_id, label, x, y, round(least(w, 400 - x), 2) AS w, round(least(h, 300 - y), 2) AS h FROM b)
SELECT ann_id, CASE WHEN label = 11 THEN 'unknown_category' WHEN NOT (w > 0.5 AND h > 0.5) THEN 'degenerate' ELSE 'kept' END AS outcome, round(w * h, 2) AS area FROM c""")
def p15_f6_candidates(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).selectExpr("ann_id", "label AS category_id", "x - 30 AS x", "y - 30 AS y", "w", "h")
    box = dt.candidate_box(tuple(F.col(c) for c in "xywh"), F.lit(400.0), F.lit(300.0), float("-inf"))
    b = b.select("ann_id", "category_id", box.alias("b")).select("ann_id", "category_id", "b.w", "b.h", "b.area")
    return reviews.usable_annotations(b, spark.range(1, 11)).select("ann_id", "outcome", "area")


@query(f"""SELECT ann_id, CASE WHEN pos = 5 THEN 'fields' WHEN pos = 6 THEN 'number' WHEN pos = 7 OR label = 11 THEN 'class' WHEN x / 500 + w / 1000 > 1 OR y / 400 + h / 800 > 1 OR x / 500 - w / 1000 < 0 OR y / 400 - h / 800 < 0 THEN 'geometry' END AS problem FROM {BOX}""")
def p11_yolo_lines(spark: SparkSession, sf: str) -> DataFrame:
    values = [F.when(F.col("pos") == 7, F.lit("0.5")).otherwise(F.col("label").cast("string")), F.when(F.col("pos") == 6, F.lit("?")).otherwise((F.col("x") / 500).cast("string")), F.col("y") / 400, F.col("w") / 500, F.col("h") / 400]
    line = F.concat_ws(" ", *[v.cast("string") for v in values], F.when(F.col("pos") == 5, F.lit("1")))
    return _box(spark, sf).select("ann_id", dt.yolo_line_problem(line).alias("problem"))


@query(f"SELECT ann_id, least(x, w) AS x1, greatest(x, w) AS x2, x > w OR y > h AS reversed, (greatest(x, w) - least(x, w)) * (greatest(y, h) - least(y, h)) AS area, (least(x, w) + (greatest(x, w) - least(x, w)) / 2) AS cx FROM {BOX}")
def p9_p18_p30_corners(spark: SparkSession, sf: str) -> DataFrame:
    c = _box(spark, sf).select("ann_id", dt.repaired_corners(*(F.col(c) for c in "xywh")).alias("c"))
    g = dt.geometry(F.col("c.x1"), F.col("c.y1"), F.col("c.x2") - F.col("c.x1"), F.col("c.y2") - F.col("c.y1"), F.lit(500.0), F.lit(400.0))
    return c.select("ann_id", "c.x1", "c.x2", "c.reversed", g["area"].alias("area"), g["cx"].alias("cx"))


@query(f"SELECT image_id, count(*) AS n, CAST(floor(sum(score) * 1000 + 0.5) AS BIGINT) AS total FROM (SELECT image_id, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC) AS k FROM {BOX} WHERE score >= 0.05) WHERE k <= 3 GROUP BY 1")
def p35_f5_best_predictions(spark: SparkSession, sf: str) -> DataFrame:
    best = dt.best_predictions(F.collect_list(F.struct("score", "ann_id")), 0.05, 3)
    i = _box(spark, sf).groupBy("image_id").agg(best.alias("d")).where(F.size("d") > 0)
    return i.select("image_id", F.size("d").cast("long").alias("n"), F.floor(F.aggregate("d", F.lit(0.0), lambda a, x: a + x["score"]) * 1000 + 0.5).cast("long").alias("total"))


# --- records


@query("SELECT doc_id, CASE WHEN lang = 'xx' OR lang = 'other' THEN 'other' WHEN lang IN ('en', 'de') THEN lang WHEN source IN ('src1', 'src2') THEN source ELSE 'other' END AS label FROM documents")
def p1_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", rc.taxonomy_label(F.col("lang"), F.col("source"), ["en", "de", "src1", "src2"], "other", ["xx"]).alias("label"))


@query("""SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR) || 'x' || CAST(c_nationkey AS VARCHAR) || ':' || c_name) AS pixels, sha256('{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment || '"}') AS digest, sha256('7' || chr(0) || CAST(c_custkey AS VARCHAR)) AS turn FROM customer""")
def p22_p24_p25_digests(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select("c_custkey", rc.pixel_hash(F.col("c_custkey"), F.col("c_nationkey"), F.col("c_name"), ":").alias("pixels"), rc.row_digest(["c_mktsegment", "c_custkey"]).alias("digest"), rc.hash_turn("7", F.col("c_custkey")).alias("turn"))


@query(r"""SELECT page_id, regexp_replace(url || '.rf.' || CAST(page_id AS VARCHAR) || '.jpg', '\.rf\..*$', '') AS stem, regexp_replace(replace(url || '?key=abc&u=s3cret', 's3cret', '[REDACTED]'), '([?&]key=)[^&\s]+', '\1[REDACTED]') AS safe, CASE WHEN page_id % 3 = 2 THEN NULL ELSE page_id END AS n FROM pages""")
def p26_p27_p28_answers(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.concat(F.lit('{"n": '), F.col("page_id").cast("string"), F.lit("}"))
    answer = F.when(F.col("page_id") % 3 == 0, plain).when(F.col("page_id") % 3 == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).otherwise("no answer")
    p = _t(spark, sf, "pages")
    stem = rc.source_stem(F.concat("url", F.lit(".rf."), F.col("page_id").cast("string"), F.lit(".jpg")))
    return p.select("page_id", stem.alias("stem"), rc.masked(F.concat("url", F.lit("?key=abc&u=s3cret")), ["s3cret"]).alias("safe"), rc.fenced_json(answer, "n long")["n"].alias("n"))


@query("SELECT c_custkey, unnest(['loss/box/0', 'loss/box/1', 'loss/cls/0']) AS name, unnest([c_acctbal, c_acctbal * 2, CAST(c_nationkey AS DOUBLE)]) AS value FROM customer")
def p29_flat_losses(spark: SparkSession, sf: str) -> DataFrame:
    losses = F.create_map(F.lit("cls"), F.array(F.col("c_nationkey").cast("double")), F.lit("box"), F.array(F.col("c_acctbal").cast("double"), F.col("c_acctbal").cast("double") * 2))
    return _t(spark, sf, "customer").select("c_custkey", F.explode(rc.flat_losses(losses)).alias("x")).select("c_custkey", "x.name", "x.value")


_REVIEW = "(SELECT o_orderkey AS id, o_orderkey % 19 = 0 AS conflict, o_orderkey % 13 = 0 AS uncertain, o_orderkey % 3 AS n, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_orderkey % 3 END AS blind, CASE o_orderkey % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'NO_RESULT' ELSE '' END AS second, CASE WHEN o_orderkey % 5 = 0 THEN 'passed' ELSE 'other' END AS bucket, o_orderkey % 11 = 0 AS missed, CASE o_orderkey % 6 WHEN 0 THEN 'keep' WHEN 1 THEN 'remove' ELSE 'adjust' END AS v1, CASE WHEN o_orderkey % 8 < 4 THEN 'keep' ELSE 'remove' END AS v2 FROM orders)"


@query(f"""WITH r AS (SELECT id, n, blind, second, uncertain, missed, CASE WHEN conflict THEN '1:reference_conflict' WHEN uncertain OR n <> blind THEN '1:overlay_original_disagreement' WHEN n = 0 AND second = 'YES' THEN '1:high_model_disagreement' WHEN n = 0 AND second = 'NO' AND bucket = 'passed' THEN '1:passed_likely_empty_three_pass'
WHEN n = 0 AND second = 'NO' THEN '2:likely_empty_three_pass' WHEN missed THEN '1:missed_object' WHEN bucket = 'passed' AND v1 = 'remove' THEN '1:passed_top_box_disputed' WHEN n = 0 AND second = 'NO_RESULT' THEN '2:empty_two_low_high_unresolved' WHEN v1 = 'adjust' OR v2 = 'adjust' THEN '2:box_adjustment' WHEN v1 = 'remove' OR v2 = 'remove' THEN '3:remove_proposals' ELSE '3:verify_boxes' END AS p FROM {_REVIEW})
SELECT id, CAST(substr(p, 1, 1) AS INTEGER) AS rank, substr(p, 3) AS category, CASE WHEN id % 17 = 0 THEN 'reference_boxes' WHEN uncertain THEN 'blind_original_uncertain' WHEN n <> blind THEN 'scene_count_disagreement' WHEN missed THEN 'possible_missed_object' WHEN n = 0 AND second <> 'NO' THEN 'empty_not_confirmed_by_high_pass' ELSE 'overlay_and_original_agree' END AS reason FROM r""")
def p33_p34_ladders(spark: SparkSession, sf: str) -> DataFrame:
    _t(spark, sf, "orders").createOrReplaceTempView("loomwork_orders")
    r = spark.sql(f"SELECT * FROM {_REVIEW.replace('FROM orders', 'FROM loomwork_orders')}")
    c = F.col
    rank = rc.review_priority(c("conflict"), c("uncertain"), c("n"), c("blind"), c("second"), c("bucket"), c("missed"), F.array("v1", "v2"))
    draft = rc.draft_eligible(c("id") % 17 == 0, c("uncertain"), c("n"), c("blind"), c("missed"), c("second"))
    return r.select("id", rank["rank"].alias("rank"), rank["category"].alias("category"), draft["reason"].alias("reason"))


@query("SELECT o_orderkey, o_orderkey % 9 = 0 OR (o_orderkey % 4 >= 2 AND o_orderkey % 5 = 0) OR o_orderkey % 6 = 0 AS matched, o_orderkey % 2 = 0 AND o_orderkey % 10 < 5 AS conflict FROM orders")
def r8_r13_rules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    match = rc.visual_match(k % 9 == 0, F.when(k % 4 >= 2, 0.98).otherwise(0.5), F.when(k % 5 == 0, 0.05).otherwise(0.2), F.when(k % 6 == 0, 30).otherwise(3), F.lit(0.6))
    return _t(spark, sf, "orders").select("o_orderkey", match.alias("matched"), rc.reference_conflict(F.when(k % 2 == 0, "keep").otherwise("remove"), (k % 10) / 10).alias("conflict"))


# --- filters, joins, orders


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' OR o_orderkey % 50 = 0 THEN 'overlap' WHEN o_orderkey % 9 = 0 THEN 'animation' WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) THEN 'missing' ELSE 'kept' END AS outcome FROM orders) GROUP BY 1""")
def f1_f2_f3_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    on_disk = _t(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("f"))
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(on_disk, F.col("o_custkey") == F.col("f"), "left")
    ladder: list[tuple[Column, str]] = [((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_orderkey") % 50 == 0), "overlap"), (F.col("o_orderkey") % 9 == 0, "animation"), (F.col("f").isNull(), "missing")]
    return reviews.parted(o, ladder).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT ann_id FROM {BOX} WHERE image_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) AND ann_id NOT IN (SELECT ann_id FROM {BOX} WHERE pos = 2)")
def f4_f8_excluded(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).select("image_id", "ann_id", "pos")
    images = _t(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("image_id"))
    return reviews.without(reviews.without(b, images, ["image_id"]), b.where("pos = 2"), ["ann_id"]).select("ann_id")


@query("""WITH m AS (SELECT o_orderkey AS k, o_custkey % 7 AS v FROM orders WHERE o_orderkey % 10 <> 0), p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 12 = 0 THEN 0 ELSE o_custkey % 7 END AS v FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(m.k, p.k) AS k, CASE WHEN m.k IS NULL THEN 'unexpected' WHEN p.k IS NULL THEN 'missing' ELSE 'v' END AS problem FROM m FULL JOIN p ON m.k = p.k WHERE m.k IS NULL OR p.k IS NULL OR m.v <> p.v""")
def j4_j23_full_match(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey % 7 AS v")
    return reviews.full_match(o.where("k % 10 <> 0"), o.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 12 == 0, 0).otherwise(F.col("v"))), "k", ["v"])


@query("SELECT o_orderkey, o_custkey % 5 AS was, o_orderkey % 5 AS now, o_orderkey % 3 = 0 AS documented FROM orders WHERE o_custkey % 5 <> o_orderkey % 5")
def j10_relabelled(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    was, now = o.selectExpr("o_orderkey", "o_custkey % 5 AS label"), o.selectExpr("o_orderkey", "o_orderkey % 5 AS label")
    return reviews.relabelled(was, now, now.where("o_orderkey % 3 = 0"), "o_orderkey", "label")


@query("SELECT o_orderkey, count(l.l_orderkey) AS boxes, CAST(coalesce(max(l_quantity), 0) AS BIGINT) AS top FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 4 <> 0) l ON l_orderkey = o_orderkey GROUP BY 1")
def j5_j9_images_and_boxes(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(100.0).alias("width"), F.lit(10.0).alias("height"))
    b = _t(spark, sf, "lineitem").where("l_linenumber <= 3 AND l_orderkey % 4 <> 0").selectExpr("l_orderkey AS image_id", "CAST(l_quantity AS DOUBLE) AS w", "10.0D AS h")
    out = reviews.scene_stats(o, b)
    return out.select(F.col("image_id").alias("o_orderkey"), "boxes", F.round(F.col("max_area") * 100).cast("long").alias("top"))


@query("""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END AS s, CASE WHEN c_custkey % 9 = 0 THEN c_nationkey END AS g, xor((c_custkey % 50) * 72057594037, CAST(1 AS BIGINT) << CAST(c_custkey % 40 AS INTEGER)) AS h, c_custkey // 6 AS p FROM customer),
j AS (SELECT a.k AS l, b.k AS r, bit_count(xor(a.h, b.h)) AS d, a.p = b.p AS e, coalesce(a.g = b.g, false) AS g FROM c a JOIN c b ON a.k < b.k AND a.s <> b.s WHERE bit_count(xor(a.h, b.h)) <= 4 OR a.p = b.p OR a.g = b.g)
SELECT l AS "left", r AS "right", CAST(d AS INTEGER) AS distance, e OR g AS confirmed, CASE WHEN e THEN 'identical pixels' WHEN g THEN 'group_id burst leak' ELSE 'perceptual similarity' END AS reason FROM j""")
def j11_j14_u6_leakage(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").selectExpr("c_custkey AS key", "c_custkey AS pos", "CASE c_custkey % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END AS split", "CASE WHEN c_custkey % 9 = 0 THEN CAST(c_nationkey AS STRING) END AS group_id", "((c_custkey % 50) * 72057594037) ^ shiftleft(1L, CAST(c_custkey % 40 AS INT)) AS phash", "floor(c_custkey / 6) AS pixel_hash")
    return reviews.leakage_pairs(c).select("left", "right", F.col("distance").cast("int").alias("distance"), "confirmed", "reason")


@query("SELECT user_id, event_id, CAST(event_id % 9 AS BIGINT) AS epoch, coalesce(n, 0) AS n FROM events LEFT JOIN (SELECT event_id % 4 AS e, count(*) AS n FROM events GROUP BY 1) r ON r.e = events.event_id % 9")
def j25_resources(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 9).alias("epoch"))
    r = e.groupBy((F.col("event_id") % 4).alias("epoch")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(r, "epoch", "left").select("user_id", "event_id", F.col("epoch").cast("long").alias("epoch"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT ann_id FROM {BOX} ORDER BY CASE WHEN score > 0.8 THEN 0 WHEN score >= 0.5 THEN 1 ELSE 2 END, w * h < 400 DESC, label, ann_id LIMIT 500")
def o1_o2_o3_o6_queue(spark: SparkSession, sf: str) -> DataFrame:
    rank = sc.case([(F.col("score") > 0.8, 0), (F.col("score") >= 0.5, 1)], 2)
    return _box(spark, sf).orderBy(rank, (F.col("w") * F.col("h") < 400).desc(), "label", "ann_id").select("ann_id").limit(500)


@query(f"""WITH e AS (SELECT image_id, count(*) FILTER (pos % 2 = 0) AS errors FROM {BOX} GROUP BY 1), t AS (SELECT image_id FROM e ORDER BY errors DESC, image_id LIMIT 16)
SELECT image_id, 'error' AS picked FROM t UNION ALL (SELECT image_id, 'first' FROM e WHERE image_id NOT IN (SELECT image_id FROM t) ORDER BY image_id LIMIT 8)""")
def o4_errors_and_first(spark: SparkSession, sf: str) -> DataFrame:
    e = _box(spark, sf).groupBy("image_id").agg(F.count_if(F.col("pos") % 2 == 0).alias("errors"))
    return reviews.worst_and_first(e, "image_id", "errors", 16, 8)


@query("SELECT doc_id AS id, 'documents' AS origin FROM documents UNION ALL SELECT page_id, 'pages' FROM pages UNION ALL SELECT vec_id, 'embeddings' FROM embeddings UNION ALL SELECT event_id, 'events' FROM events")
def u1_four_sources(spark: SparkSession, sf: str) -> DataFrame:
    parts = [_t(spark, sf, t).select(F.col(k).cast("long").alias("id"), F.lit(t).alias("origin")) for t, k in (("documents", "doc_id"), ("pages", "page_id"), ("embeddings", "vec_id"), ("events", "event_id"))]
    return gates.report(parts)


# --- aggregations


@query(_MATRIX + """, r AS (SELECT truth AS label, sum(CASE WHEN pred = truth THEN n ELSE 0 END) AS tp, sum(n) AS support FROM m WHERE truth > 0 GROUP BY 1), p AS (SELECT pred AS label, sum(n) AS k FROM m WHERE pred > 0 GROUP BY 1),
x AS (SELECT CASE WHEN k > 0 THEN tp / CAST(k AS DOUBLE) ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS r FROM r JOIN p USING (label))
SELECT round(avg(p), 9) AS precision, round(avg(r), 9) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 9) AS f1 FROM x""")
def a17_a18_macro(spark: SparkSession, sf: str) -> DataFrame:
    report = det.class_report(det.confusion(_pairs(spark, sf), list(range(1, 12))))
    return report.agg(*[F.round(F.avg(c), 9).alias(c) for c in ("precision", "recall", "f1")])


@query()
def a14_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).selectExpr("image_id", "pos", "label", "x AS x1", "y AS y1", "x + w AS x2", "y + h AS y2", "score")
    p = b.selectExpr("image_id", "pos", "label", "x1 + pos AS x1", "y1 + 2 AS y1", "x2 + pos AS x2", "y2 + 2 AS y2", "score")
    return det.at_thresholds(b.drop("score"), p, [0.20, 0.45, 0.50, 0.80])


@query()
def a19_w8_coco_summary(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).select("image_id", "ann_id", "pos", "label", *"xywh", "score")
    found = b.where("pos % 4 <> 0").withColumn("x", F.col("x") + F.col("pos") * 3)
    return coco.coco_summary(coco.coco_table(b.drop("score"), found))


@query("""WITH v AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, label, d, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 1e-8) AS v FROM v),
s AS (SELECT a.vec_id AS q, a.label AS label, b.label AS other, b.vec_id AS nb, sum(a.v * b.v) AS s FROM u a JOIN u b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY ALL),
k AS (SELECT label, other, count(*) AS n FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, nb) <= 5) GROUP BY 1, 2)
SELECT label, other AS neighbour_label, n, round(n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE), 9) AS share FROM k""")
def a25_neighbour_labels(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "embeddings")
    near = emb.nearest_neighbours(v, v.where("vec_id % 20 = 0"))
    return reviews.neighbour_labels(near, v).withColumn("share", F.round("share", 9))


@query(f"WITH k AS (SELECT label, image_id, count(*) AS n FROM {BOX} GROUP BY 1, 2) SELECT label, max(n) AS largest, count(*) AS images FROM k GROUP BY 1")
def a30_a42_largest_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _box(spark, sf).groupBy("label", "image_id").count().groupBy("label").agg(F.max("count").alias("largest"), F.count(F.lit(1)).alias("images"))


@query(f"""SELECT o_orderkey AS image_id, count(b.ann_id) AS boxes, round(coalesce(max(w * h / 1000000), 0), 6) AS max_area, coalesce(max(w * h / 1000000), 0) < 0.0025 AS tiny FROM orders LEFT JOIN (SELECT * FROM {BOX} WHERE pos <> 1) b ON b.image_id = o_orderkey GROUP BY 1""")
def a32_m11_scene_stats(spark: SparkSession, sf: str) -> DataFrame:
    images = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"))
    return reviews.scene_stats(images, _box(spark, sf).where("pos <> 1").select("image_id", "w", "h"))


@query(f"SELECT label, count(*) AS before, count(*) FILTER (image_id % 7 <> 0) AS after, count(*) FILTER (image_id % 7 = 0) AS removed FROM {BOX} GROUP BY 1")
def a34_before_and_after(spark: SparkSession, sf: str) -> DataFrame:
    out = _t(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("image_id"))
    return reviews.before_and_after(_box(spark, sf), out, "image_id", "label")


@query(f"SELECT CAST(ceil(count(DISTINCT image_id) / 16.0) * 16 AS BIGINT) AS epoch_length FROM {BOX} WHERE split = 'train'")
def a35_epoch_length(spark: SparkSession, sf: str) -> DataFrame:
    n = _box(spark, sf).where("split = 'train'").agg(F.count_distinct("image_id").alias("n"))
    return n.select((F.ceil(F.col("n") / 16) * 16).cast("long").alias("epoch_length"))


@query(f"SELECT count(*) FILTER (n <> blind) AS disagreements, count(*) FILTER (n = blind AND NOT uncertain) AS agreed, count(*) FILTER (n = 0 AND blind = 0 AND second = 'NO') AS empty FROM {_REVIEW}")
def a37_consensus(spark: SparkSession, sf: str) -> DataFrame:
    _t(spark, sf, "orders").createOrReplaceTempView("loomwork_orders")
    r = spark.sql(f"SELECT * FROM {_REVIEW.replace('FROM orders', 'FROM loomwork_orders')}")
    n, blind = F.col("n"), F.col("blind")
    return r.agg(F.count_if(n != blind).alias("disagreements"), F.count_if((n == blind) & ~F.col("uncertain")).alias("agreed"), F.count_if((n == 0) & (blind == 0) & (F.col("second") == "NO")).alias("empty"))


@query("""SELECT event_type AS model, count(*) AS n, round(avg(value), 6) AS latency, round(avg(value) FILTER (user_id % 2 = 0), 6) AS ap_even, round(avg(value) FILTER (user_id % 2 = 1), 6) AS ap_odd FROM events GROUP BY 1""")
def a38_model_records(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select(F.col("event_type").alias("model"), "value", F.when(F.col("user_id") % 2 == 0, "ap_even").otherwise("ap_odd").alias("label"))
    totals = e.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("latency"))
    per_label = e.groupBy("model").pivot("label", ["ap_even", "ap_odd"]).agg(F.round(F.avg("value"), 6))
    return totals.join(per_label, "model")


# --- deduplication, merging, splits


@query()
def g4_similar_clusters(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").selectExpr("c_custkey AS pos", "floor(c_custkey / 3) AS source", "((c_custkey % 50) * 72057594037) ^ shiftleft(1L, CAST(c_custkey % 60 AS INT)) AS phash")
    return reviews.similar_clusters(c, 2)


@query()
def g5_merged_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).selectExpr("image_id", "ann_id", "label % 2 AS label", "x AS x1", "y AS y1", "x + w AS x2", "y + h AS y2", "score", "array('model') AS flags", "pos = 5 AS adjusted")
    out = merging.merged_boxes(b, [F.col("ann_id")], 0.30, F.col("adjusted"))
    return out.select("image_id", "ann_id", "x1", "y1", "x2", "y2", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query()
def g6_merged_detections(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).selectExpr("image_id", "ann_id", "label % 2 AS label", "x AS x1", "y AS y1", "x + w AS x2", "y + h AS y2", "score", "CASE WHEN pos > 3 THEN array('edge') ELSE array('tiny', concat('p', pos)) END AS flags")
    out = merging.merged_boxes(b, [F.col("score").desc()], 0.30)
    return out.select("image_id", "ann_id", "score", "x1", "x2", F.array_join("flags", "|").alias("flags"), F.size("members").alias("n"))


@query()
def x2_stratified_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = _t(spark, sf, "orders").groupBy("o_orderpriority", F.col("o_custkey").alias("gid")).agg(F.count(F.lit(1)).alias("size"))
    return splits.stratified_fill(g, "o_orderpriority", "gid", "size")


@query()
def x3_x5_component_splits(spark: SparkSession, sf: str) -> DataFrame:
    m = _t(spark, sf, "orders").selectExpr("o_orderkey AS key", "CAST(floor(o_orderkey / 5) AS BIGINT) AS component", "o_custkey % 3 AS label", "CASE WHEN o_custkey % 40 = 0 THEN 'valid' ELSE 'train' END AS split")
    return splits.move_log(splits.component_splits(m, "component", "label", "split"), "key", "split")


# --- gates


@query("""SELECT 'images_match' AS gate, CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'corrupt' ELSE 'size' END AS detail FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 13 = 0
UNION ALL SELECT 'one_label', CAST(o_custkey AS VARCHAR), CAST(count(DISTINCT o_orderpriority) AS VARCHAR) FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1
UNION ALL SELECT 'counts_equal', CAST(k AS VARCHAR), CAST(n AS VARCHAR) FROM (SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) WHERE n <> 10
UNION ALL SELECT 'derivative', CAST(doc_id AS VARCHAR), 'violated' FROM (SELECT source || CASE WHEN doc_id % 6 = 0 THEN '/x-Rendered.jpg' ELSE '/x.jpg' END AS path, * FROM documents) WHERE doc_id % 6 = 0
UNION ALL SELECT 'decided', CAST(o_orderkey AS VARCHAR), 'violated' FROM orders WHERE o_orderkey % 500 = 0""")
def v3_v5_v11_v12_v19_v20_gates(spark: SparkSession, sf: str) -> DataFrame:
    o, k = _t(spark, sf, "orders"), F.col("path")
    expected = o.select(F.col("o_orderkey").alias("path"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    probed = expected.where(k % 10 != 0).select("path", F.when(k % 13 == 0, 11).otherwise(10).alias("width"), F.lit(20).alias("height"), F.when(k % 7 == 0, "bad").otherwise("").alias("error"))
    stated = _t(spark, sf, "customer").select("c_custkey", F.lit(10).alias("n"))
    d = _t(spark, sf, "documents").select(F.concat("source", F.when(F.col("doc_id") % 6 == 0, "/x-Rendered.jpg").otherwise("/x.jpg")).alias("path"), "doc_id")
    derived = gates.no_derivatives(d, "path").join(d, F.col("key") == F.col("path")).select("gate", F.col("doc_id").cast("string").alias("key"), "detail").distinct()
    return gates.report([
        gates.images_match(expected, probed), gates.one_label(o, "o_custkey", "o_orderpriority"), gates.counts_equal(stated, o.join(stated.select(F.col("c_custkey").alias("x")), F.col("o_custkey") == F.col("x"), "left_semi").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey"),
        derived, gates.undecided(o, "o_orderkey", F.when(F.col("o_orderkey") % 500 == 0, "kept").otherwise(" ")),
    ])


@query("""SELECT 'category_schema' AS gate, s || ':' || CAST(i AS VARCHAR) AS key, 'missing' AS detail FROM (SELECT unnest(['train', 'valid', 'test']) AS s) a, (SELECT unnest(range(0, 27)) AS i) b WHERE i >= 25 OR (s = 'test' AND i = 3)
UNION ALL SELECT 'category_schema', '4', 'names' UNION ALL SELECT 'fingerprint', 'rows', CAST(count(*) AS VARCHAR) FROM nation UNION ALL SELECT 'qa', 'no_unresolved_pairs', 'violated'""")
def v4_v8_v9_v17_gates(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    names = gates.report([n.select(F.lit(s).alias("split"), F.col("n_nationkey").alias("id"), F.when((F.col("n_nationkey") == 4) & (F.lit(s) == "test"), "x").otherwise(F.col("n_name")).alias("name")) for s in ("train", "valid", "test")])
    schema = gates.category_schema(names.where("NOT (split = 'test' AND id = 3)"), list(range(27)), ["train", "valid", "test"])
    stated = spark.createDataFrame([("7", "same")], "rows string, seed string")
    actual = n.agg(F.count(F.lit(1)).cast("string").alias("rows"), F.lit("same").alias("seed"))
    checks = n.agg((F.count(F.lit(1)) == 25).alias("all_classes"), (F.count(F.lit(1)) == 0).alias("no_unresolved_pairs"))
    return gates.report([schema, gates.same_value(stated, actual, ["rows", "seed"]), gates.all_checks(checks)])


@query(f"""WITH p AS (SELECT * FROM {BOX} WHERE image_id % 9 <> 0) SELECT 'no_entry' AS gate, CAST(o_orderkey AS VARCHAR) AS key, 'missing' AS detail FROM orders WHERE o_orderkey NOT IN (SELECT image_id FROM p)
UNION ALL SELECT 'unknown_image', CAST(image_id AS VARCHAR), 'missing' FROM (SELECT DISTINCT image_id FROM p) WHERE image_id NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'too_many', CAST(image_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM p GROUP BY image_id HAVING count(*) > 6
UNION ALL SELECT 'unknown_label', CAST(ann_id AS VARCHAR), CAST(label AS VARCHAR) FROM p WHERE label = 11 OR pos = 6 UNION ALL SELECT 'invalid_box', CAST(ann_id AS VARCHAR), 'violated' FROM p WHERE score * 1.01 > 1 OR pos = 4""")
def v16_predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = _box(spark, sf).where("image_id % 9 <> 0").selectExpr("image_id", "ann_id", "label", "concat('c', CASE WHEN pos = 6 THEN 0 ELSE label END) AS name", "x AS x1", "y AS y1", "CASE WHEN pos = 4 THEN CAST('NaN' AS DOUBLE) ELSE x + w END AS x2", "y + h AS y2", "score * 1.01 AS score")
    labels = spark.range(1, 11).select(F.col("id").alias("label"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"))
    return gates.predictions_valid(p, _t(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id")), labels, 6)


@query("""WITH l AS (SELECT l_orderkey AS k, l_suppkey % 3 AS p, l_returnflag AS a, CASE WHEN l_linenumber = 1 THEN ' ' ELSE 'r' END AS r FROM lineitem WHERE l_orderkey % 20 = 1), o AS (SELECT o_orderkey AS k, o_custkey % 3 AS p FROM orders WHERE o_orderkey % 3 <> 0)
SELECT 'unknown' AS gate, CAST(k AS VARCHAR) AS key, 'missing' AS detail FROM l WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT 'detached', CAST(l.k AS VARCHAR), CAST(l.p AS VARCHAR) FROM l JOIN o ON l.k = o.k WHERE l.p <> o.p
UNION ALL SELECT 'undocumented', CAST(k AS VARCHAR), 'violated' FROM l WHERE r = ' ' UNION ALL SELECT 'conflict', CAST(k AS VARCHAR), CAST(count(DISTINCT a) AS VARCHAR) FROM l GROUP BY k HAVING count(DISTINCT a) > 1""")
def v18_ledger(spark: SparkSession, sf: str) -> DataFrame:
    ledger = _t(spark, sf, "lineitem").where("l_orderkey % 20 = 1").selectExpr("l_orderkey AS k", "l_suppkey % 3 AS p", "l_returnflag AS action", "CASE WHEN l_linenumber = 1 THEN ' ' ELSE 'r' END AS reason", "'e' AS evidence")
    return gates.ledger_valid(ledger, _t(spark, sf, "orders").where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS k", "o_custkey % 3 AS p"), "k", "p")


@query("""SELECT 'parity' AS gate, CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 10 = 0 THEN 'one side' ELSE 'c_acctbal' END AS detail FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 7 = 0""")
def a40_m14_parity(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    now = c.where("c_custkey % 10 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 7 == 0, 1e-3).otherwise(0.0))
    return gates.within(c, now, ["c_custkey"], ["c_acctbal"], 1e-6)


# --- reviews


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderpriority AS c FROM orders WHERE o_orderkey % 9 <> 0), s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 80 = 0), kept AS (SELECT r.k, c FROM r WHERE k IN (SELECT k FROM s)), h AS (SELECT c, count(*) AS n FROM kept GROUP BY 1),
f AS (SELECT r.k, r.c, row_number() OVER (PARTITION BY r.c ORDER BY sha256('fp|' || CAST(r.k AS VARCHAR)), r.k) AS rank FROM r WHERE k NOT IN (SELECT k FROM s))
SELECT k, c, false AS replacement FROM kept UNION ALL SELECT f.k, f.c, true FROM f LEFT JOIN h ON h.c = f.c WHERE rank <= 60 - coalesce(h.n, 0)""")
def q3_q4_kept_sample(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("c"))
    turn = F.sha2(F.concat(F.lit("fp|"), F.col("k").cast("string")), 256)
    return reviews.kept_sample(o.where("k % 9 <> 0"), o.where("k % 80 = 0"), "k", "c", turn, 60)


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderpriority AS c, o_orderkey % 97 = 0 AS a, o_totalprice > 400000 AS b, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('9' || chr(0) || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS i FROM orders)
SELECT k, concat_ws('|', CASE WHEN b THEN 'dear' END, CASE WHEN a THEN 'odd' END, CASE WHEN i <= greatest(ceil(n * 0.02), 30) THEN 'stratified_sample' END) AS reasons FROM r WHERE a OR b OR i <= greatest(ceil(n * 0.02), 30)""")
def q1_review_selection(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", "o_totalprice")
    out = reviews.review_selection(o, "k", ["o_orderpriority"], {"odd": F.col("k") % 97 == 0, "dear": F.col("o_totalprice") > 400000}, rc.hash_turn("9", F.col("k")), 0.02, 30)
    return out.select("k", F.array_join("reasons", "|").alias("reasons"))


@query(f"""WITH o AS (SELECT * FROM {BOX} WHERE pos <> 2), n AS (SELECT image_id, pos, ann_id, label, x, w FROM {BOX} WHERE pos <> 3)
SELECT image_id, pos, CASE WHEN pos % 5 = 0 THEN NULL WHEN pos = 2 THEN NULL ELSE ann_id END AS ann_id, CASE WHEN pos % 5 = 0 OR pos = 2 THEN 'new' ELSE 'reused' END AS outcome FROM n UNION ALL SELECT image_id, NULL, ann_id, 'removed' FROM o WHERE pos = 3 OR pos % 5 = 0""")
def r1_j17_applied_edits(spark: SparkSession, sf: str) -> DataFrame:
    # label by position, so that only a box's own template is near
    b = _box(spark, sf).select("image_id", "ann_id", "pos", F.col("ann_id").alias("label"), *"xywh")
    edited = b.where("pos <> 3").withColumn("x", F.col("x") + F.when(F.col("pos") % 5 == 0, 7.0).otherwise(0.00004)).drop("ann_id")
    return reviews.applied_edits(edited, b.where("pos <> 2").drop("pos")).select("image_id", "pos", "ann_id", "outcome")


@query(f"""WITH a AS (SELECT ann_id, CASE WHEN image_id % 11 = 0 THEN 'reference' WHEN image_id % 7 = 0 THEN 'image_removed' WHEN ann_id % 5 = 0 THEN 'edited' WHEN ann_id % 3 = 0 THEN 'removed' WHEN ann_id % 3 = 1 THEN 'kept' ELSE 'unreviewed' END AS action FROM {BOX}) SELECT ann_id, action, action NOT IN ('image_removed', 'removed') AS kept FROM a""")
def r2_applied_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).select("image_id", "ann_id")
    verdict = F.when(F.col("ann_id") % 3 == 0, "remove").otherwise("keep").alias("verdict")
    return reviews.applied_verdicts(b, b.where("image_id % 11 = 0"), b.where("image_id % 7 = 0"), b.where("ann_id % 5 = 0"), b.where("ann_id % 3 < 2").select("ann_id", verdict)).select("ann_id", "action", "kept")


@query("""WITH p AS (SELECT o_orderkey AS id, o_custkey AS l, o_custkey + 1 + o_orderkey % 5 AS r, o_orderkey % 5 AS d, o_orderkey % 4 = 0 AS same, o_orderkey % 3 = 0 AS vis, o_orderkey % 6 = 0 AS x FROM orders)
SELECT id, same AS exact, vis AND NOT same AS related, d <= 2 AND NOT same AS risk, x AND id % 12 <> 0 AS unresolved FROM p WHERE l % 10 <> 0 AND r % 10 <> 0""")
def r7_f9_f10_active_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "orders").selectExpr("o_orderkey AS pair_id", "o_custkey AS left", "o_custkey + 1 + o_orderkey % 5 AS right", "o_orderkey % 5 AS distance", "o_orderkey % 4 = 0 AS same_pixels", "o_orderkey % 3 = 0 AS visual_match", "o_orderkey % 6 = 0 AS cross_class")
    excluded = p.select(F.explode(F.array("left", "right")).alias("k")).where("k % 10 = 0")
    return reviews.reconciled_pairs(p, excluded, p.where("pair_id % 12 = 0"), "k").select(F.col("pair_id").alias("id"), "exact", "related", "risk", "unresolved")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'queue|triage' ELSE 'queue' END AS reasons, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS reviewer FROM orders")
def r10_with_review(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", F.array(F.lit("queue")).alias("reasons"))
    r = _t(spark, sf, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_custkey").alias("reviewer"))
    return reviews.with_review(o, r, "o_orderkey", "triage").select("o_orderkey", F.array_join("reasons", "|").alias("reasons"), "review.reviewer")


@query(f"SELECT ann_id, CASE WHEN image_id % 3 = 0 THEN 'reference' ELSE 'model' END AS basis FROM {BOX} JOIN orders ON o_orderkey = image_id WHERE (image_id % 3 = 0 AND pos % 2 = 0) OR (image_id % 3 <> 0 AND pos % 2 = 1)")
def r11_r5_draft_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).select("image_id", "ann_id", "pos")
    q = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.when(F.col("o_orderkey") % 3 == 0, "camera").otherwise("other").alias("source"))
    return reviews.draft_boxes(q, b.where("pos % 2 = 1"), b.where("pos % 2 = 0"), "camera").select("ann_id", "basis")


@query("SELECT o_orderkey FROM orders WHERE NOT ((o_orderkey % 2 = 0 AND o_orderpriority = '1-URGENT') OR o_orderpriority = '2-HIGH')")
def r6_label_corrections(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").withColumn("reviewed", F.when(F.col("o_orderkey") % 2 == 0, "1-URGENT|2-HIGH").otherwise("2-HIGH"))
    return reviews.label_corrections(o, "o_orderpriority", "reviewed").select("o_orderkey")
