"""Registered queries over the driver's tables and their SQL.

Images are orders, boxes are line items (BOX), vectors are embeddings; 64-bit
hashes are taken from md5, which both engines have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import boxes as bx
from loomwork.functions import scalars as sc
from loomwork.operators import detection as det
from loomwork.operators import embeddings as emb
from loomwork.operators import gates
from loomwork.operators import relational as rel
from loomwork.operators import splits
from loomwork.operators.components import connected_components

FLAGSHIP = "a6_bucket_audit"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_BOX = (
    "l_orderkey AS image_id", "l_orderkey * 10 + l_linenumber AS ann_id", "CAST(l_linenumber AS BIGINT) AS pos", "CAST(l_suppkey % 11 + 1 AS BIGINT) AS label",
    "CAST((l_partkey * 7) % 500 AS DOUBLE) AS x", "CAST((l_suppkey * 13) % 400 AS DOUBLE) AS y", "CAST(l_quantity * 4 AS DOUBLE) AS w", "CAST(l_quantity * 2 + l_linenumber * 10 AS DOUBLE) AS h",
    "CAST((l_partkey * l_linenumber * 37) % 1000 AS DOUBLE) / 1000 AS score", "CASE l_orderkey % 10 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END AS split",
)
BOX = f"(SELECT {', '.join(_BOX)} FROM lineitem)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _box(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").selectExpr(*_BOX)


def _md5_long(c: Column) -> Column:
    return sc.hash_from_hex(F.substring(F.md5(c.cast("string")), 1, 16))


# --- aggregations


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a1_a2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"SELECT label, count(*) FILTER (split='train') AS train, count(*) FILTER (split='valid') AS valid, count(*) FILTER (split='test') AS test, count(*) AS total FROM {BOX} GROUP BY label")
def a3_class_by_split(spark: SparkSession, sf: str) -> DataFrame:
    out = _box(spark, sf).groupBy("label").pivot("split", ["train", "valid", "test"]).count().na.fill(0)
    return out.withColumn("total", F.col("train") + F.col("valid") + F.col("test"))


@query(f"SELECT split, count(DISTINCT image_id) AS images, count(*) AS boxes FROM {BOX} GROUP BY split")
def a4_split_summary(spark: SparkSession, sf: str) -> DataFrame:
    # one row an image first, so the distinct count is a plain one
    return _box(spark, sf).groupBy("split", "image_id").count().groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.sum("count").alias("boxes"))


@query(f"SELECT split, label, count(DISTINCT image_id) AS images, count(*) AS boxes FROM {BOX} GROUP BY split, label")
def a5_images_and_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _box(spark, sf).groupBy("split", "label").agg(F.count_distinct("image_id").alias("images"), F.count(F.lit(1)).alias("boxes"))


_BUCKET = "CASE WHEN score > 0.80 THEN 'high' WHEN score >= 0.50 THEN 'medium' WHEN score > 0.20 THEN 'low' ELSE 'none' END"


@query(f"""SELECT {_BUCKET} AS bucket, split, count(*) AS n, count(*) FILTER (w * h < 400) AS tiny, count(*) FILTER (x = 0 OR y = 0) AS edge, CAST(sum(CAST(w AS BIGINT)) AS BIGINT) AS width
FROM {BOX} GROUP BY GROUPING SETS ((bucket), (bucket, split))""")
def a6_bucket_audit(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).withColumn("bucket", sc.score_bucket(F.col("score")))
    sets = b.groupingSets([["bucket"], ["bucket", "split"]], "bucket", "split")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("w") * F.col("h") < 400).alias("tiny"), F.count_if((F.col("x") == 0) | (F.col("y") == 0)).alias("edge"), F.sum(F.col("w").cast("long")).alias("width"))


@query(f"SELECT label, CAST(round(quantile_cont(w, 0.1) * 1000) AS BIGINT) AS p10, CAST(round(quantile_cont(w, 0.5) * 1000) AS BIGINT) AS p50, CAST(round(quantile_cont(w, 0.9) * 1000) AS BIGINT) AS p90 FROM {BOX} GROUP BY label")
def a7_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = _box(spark, sf).groupBy("label").agg(F.percentile("w", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    return p.select("label", *[F.round(F.col("p")[k] * 1000).cast("long").alias(n) for k, n in enumerate(("p10", "p50", "p90"))])


@query(f"""WITH b AS (SELECT CASE WHEN f < 0.01 THEN 0 WHEN f < 0.05 THEN 1 WHEN f < 0.1 THEN 2 WHEN f < 0.9 THEN 3 ELSE 4 END AS bin FROM (SELECT w * h / 100000 AS f FROM {BOX}))
SELECT CAST(g.bin AS INTEGER) AS bin, count(b.bin) AS n FROM (SELECT unnest(range(0, 5)) AS bin) g LEFT JOIN b ON b.bin = g.bin GROUP BY 1""")
def a8_area_histogram(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).select(sc.edge_bin(F.col("w") * F.col("h") / 100000, [0.01, 0.05, 0.1, 0.9]).alias("bin")).groupBy("bin").count()
    return spark.range(5).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(b), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))


@query(f"""WITH b AS (SELECT score, label <= 7 AS correct FROM {BOX}), g AS (SELECT unnest(range(0, 101)) AS step),
c AS (SELECT CAST(step AS INTEGER) AS step, (SELECT count(*) FROM b WHERE correct AND floor(score * 100 + 1e-9) >= step) AS tp, (SELECT count(*) FROM b WHERE NOT correct AND floor(score * 100 + 1e-9) >= step) AS fp, (SELECT count(*) FROM b) AS n FROM g),
m AS (SELECT step, tp, fp, n - tp AS fn, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS p, tp / CAST(n AS DOUBLE) AS r FROM c)
SELECT step, tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m""")
def a12_a13_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).select("score", (F.col("label") <= 7).alias("correct"))
    return det.confidence_curve(b, b.count())


_PAIRS = f"(SELECT label AS truth_label, CASE WHEN pos = 3 THEN NULL ELSE CAST((label + pos - 1) % 11 + 1 AS BIGINT) END AS pred_label FROM {BOX})"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _box(spark, sf).selectExpr("label AS truth_label", "CASE WHEN pos = 3 THEN NULL ELSE (label + pos - 1) % 11 + 1 END AS pred_label")


_MATRIX = f"""WITH g AS (SELECT a.v AS truth, b.v AS pred FROM (SELECT unnest(range(0, 12)) AS v) a, (SELECT unnest(range(0, 12)) AS v) b),
c AS (SELECT coalesce(truth_label, 0) AS truth, coalesce(pred_label, 0) AS pred, count(*) AS n FROM {_PAIRS} GROUP BY 1, 2),
m AS (SELECT g.truth, g.pred, coalesce(n, 0) AS n, CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY g.truth) > 0 THEN coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.truth) AS DOUBLE) ELSE 0 END AS share FROM g LEFT JOIN c ON g.truth = c.truth AND g.pred = c.pred)"""


@query(_MATRIX + " SELECT CAST(truth AS BIGINT) AS truth, CAST(pred AS BIGINT) AS pred, CAST(n AS BIGINT) AS n, CAST(share AS DOUBLE) AS share FROM m")
def a15_a16_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return det.confusion(_pairs(spark, sf), list(range(1, 12)))


@query(_MATRIX + """, r AS (SELECT truth AS label, sum(CASE WHEN pred = truth THEN n ELSE 0 END) AS tp, sum(n) AS support FROM m WHERE truth > 0 GROUP BY 1),
p AS (SELECT pred AS label, sum(n) AS k FROM m WHERE pred > 0 GROUP BY 1),
x AS (SELECT label, tp, k - tp AS fp, support - tp AS fn, support, CASE WHEN k > 0 THEN tp / CAST(k AS DOUBLE) ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS r FROM r JOIN p USING (label))
SELECT CAST(label AS BIGINT) AS label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(support AS BIGINT) AS support, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM x""")
def a17_class_report(spark: SparkSession, sf: str) -> DataFrame:
    report = det.class_report(det.confusion(_pairs(spark, sf), list(range(1, 12))))
    return report.select("label", "tp", "fp", "fn", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query()
def a10_a9_greedy_matching(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).selectExpr("image_id", "pos", "label", "x AS x1", "y AS y1", "x + w AS x2", "y + h AS y2", "score")
    p = b.selectExpr("image_id", "pos", "label % 10 + 1 AS label", "x1 + pos AS x1", "y1 + 2 AS y1", "x2 + pos AS x2", "y2 + 2 AS y2", "score").where("score >= 0.2")
    return det.micro_metrics(det.match_boxes(b.drop("score"), p))


@query(f"""WITH i AS (SELECT image_id, max(score) AS score, bool_or(label = 3) AS present FROM {BOX} GROUP BY 1),
s AS (SELECT score, count(*) FILTER (present) AS p, count(*) FILTER (NOT present) AS q FROM i GROUP BY 1),
c AS (SELECT *, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT CAST(sum(p * (below + q / 2.0)) AS DOUBLE) / CAST(sum(p) * sum(q) AS DOUBLE) AS auc FROM c""")
def a41_presence_auc(spark: SparkSession, sf: str) -> DataFrame:
    return det.presence_auc(_box(spark, sf).groupBy("image_id").agg(F.max("score").alias("score"), F.bool_or(F.col("label") == 3).alias("present")))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(1000 / avg(value), 6) AS per_second FROM events GROUP BY 1")
def a20_latency(spark: SparkSession, sf: str) -> DataFrame:
    m = F.avg("value")
    return _t(spark, sf, "events").groupBy("event_type").agg(F.round(m, 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(1000 / m, 6).alias("per_second"))


@query("SELECT sha256(string_agg(CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus || chr(10), '' ORDER BY o_orderkey)) AS fingerprint, count(*) AS n FROM orders")
def a26_a28_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of sorted lines is one string by its definition; operators compare per-group digests instead."""
    lines = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_orderstatus"), F.lit("\n")).alias("line"))
    return lines.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), ""), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


@query(f"WITH c AS (SELECT label, count(*) AS n FROM {BOX} WHERE split = 'valid' GROUP BY 1) SELECT CAST(g.label AS BIGINT) AS label, coalesce(n, 0) AS n, greatest(0, 600 - coalesce(n, 0)) AS shortfall FROM (SELECT unnest(range(1, 13)) AS label) g LEFT JOIN c ON c.label = g.label")
def a31_shortfall(spark: SparkSession, sf: str) -> DataFrame:
    c = _box(spark, sf).where("split = 'valid'").groupBy("label").count()
    out = spark.range(1, 13).withColumnRenamed("id", "label").join(F.broadcast(c), "label", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    return out.select("label", "n", F.greatest(F.lit(0), 600 - F.col("n")).alias("shortfall"))


@query(f"""WITH k AS (SELECT label, count(DISTINCT image_id) AS n FROM {BOX} GROUP BY 1), w AS (SELECT label, least(1 / sqrt(n), 1.5 * min(1 / sqrt(n)) OVER ()) AS weight FROM k),
i AS (SELECT DISTINCT image_id, label FROM {BOX}) SELECT image_id, round(avg(weight) * 1e6) / 1e6 AS weight FROM i JOIN w USING (label) GROUP BY 1""")
def a35_image_weights(spark: SparkSession, sf: str) -> DataFrame:
    i = _box(spark, sf).select("image_id", "label").distinct()
    k = i.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("raw", 1 / F.sqrt("n"))
    w = k.withColumn("weight", F.least("raw", 1.5 * F.min("raw").over(Window.partitionBy(F.lit(0))))).select("label", "weight")
    return i.join(F.broadcast(w), "label").groupBy("image_id").agg((F.round(F.avg("weight") * 1e6) / 1e6).alias("weight"))


@query(f"SELECT image_id, count(*) FILTER (pos % 2 = 0) AS errors FROM {BOX} GROUP BY 1 ORDER BY errors DESC, image_id LIMIT 16")
def a36_o4_worst_images(spark: SparkSession, sf: str) -> DataFrame:
    return _box(spark, sf).groupBy("image_id").agg(F.count_if(F.col("pos") % 2 == 0).alias("errors")).orderBy(F.col("errors").desc(), "image_id").limit(16)


@query("SELECT o_orderpriority, arg_max(o_orderkey, o_totalprice) AS leader, arg_min(o_orderkey, o_totalprice) AS last FROM orders GROUP BY 1")
def a39_leaders(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", "o_totalprice").alias("leader"), F.min_by("o_orderkey", "o_totalprice").alias("last"))


# --- embeddings

_CENTROID = """m AS (SELECT label, d, avg(v) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, d, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-8) AS m FROM m)"""


@query(f"WITH {_CENTROID} SELECT a.label AS a, b.label AS b, CAST(round(sum(a.m * b.m) * 100000) AS BIGINT) AS cosine FROM c a JOIN c b ON a.d = b.d GROUP BY 1, 2")
def a21_a22_centroid_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return emb.similarity_matrix(emb.centroids(_t(spark, sf, "embeddings"))).select("a", "b", F.round(F.col("cosine") * 100000).cast("long").alias("cosine"))


_MARGIN = f"""WITH {_CENTROID}, v AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
s AS (SELECT v.vec_id, v.label, c.label AS other, sum(v.v * c.m) / greatest(sqrt(sum(v.v * v.v)), 1e-8) AS s FROM v JOIN c ON v.d = c.d GROUP BY 1, 2, 3),
g AS (SELECT vec_id, label, max(s) FILTER (other = label) AS own, max(s) FILTER (other <> label) AS rival FROM s GROUP BY 1, 2)"""


@query(f"{_MARGIN} SELECT label, count(*) AS n, count(*) FILTER (own < rival) AS outliers FROM g GROUP BY 1")
def a23_w5_outlier_rate(spark: SparkSession, sf: str) -> DataFrame:
    return emb.margins(_t(spark, sf, "embeddings")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("margin") < 0).alias("outliers"))


@query(f"{_MARGIN} SELECT vec_id FROM g QUALIFY row_number() OVER (ORDER BY own - rival, vec_id) <= greatest(1, CAST(round(0.01 * (SELECT count(*) FROM g)) AS BIGINT))")
def w6_lowest_margins(spark: SparkSession, sf: str) -> DataFrame:
    m = emb.margins(_t(spark, sf, "embeddings"))
    n = m.count()
    return m.orderBy("margin", "vec_id").limit(max(1, round(0.01 * n))).select("vec_id")


@query("""WITH v AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, d, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 1e-8) AS v FROM v),
s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, sum(a.v * b.v) AS s FROM u a JOIN u b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query, neighbour, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def j22_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "embeddings")
    return emb.nearest_neighbours(v, v.where("vec_id % 20 = 0")).select("query", "neighbour", "rank")


@query("SELECT k AS cluster, label AS dominant, n, CAST(total AS BIGINT) AS total FROM (SELECT vec_id % 7 AS k, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY vec_id % 7) AS total FROM embeddings GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, label) = 1")
def a24_cluster_purity(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "embeddings").groupBy((F.col("vec_id") % 7).alias("cluster"), "label").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("cluster")))
    return rel.ranked(c, ["cluster"], [F.col("n").desc(), F.col("label")]).where("rank = 1").select("cluster", F.col("label").alias("dominant"), "n", "total")


# --- projections


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'germanic' WHEN source IN ('src1', 'src2') THEN 'romance_main' ELSE 'generic' END AS class,
coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'none') AS credit, source || ':' || CAST(doc_id AS VARCHAR) AS image_id FROM documents""")
def p1_p2_p3_manifest_fields(spark: SparkSession, sf: str) -> DataFrame:
    label = sc.case([(F.col("lang").isin("en", "de"), "germanic"), (F.col("source").isin("src1", "src2"), "romance_main")], "generic")
    credit = sc.first_filled(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.col("source"), F.lit("none"))
    return _t(spark, sf, "documents").select("doc_id", label.alias("class"), credit.alias("credit"), F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("image_id"))


@query(f"""SELECT ann_id, {_BUCKET} AS bucket, CASE WHEN pos >= 4 THEN '4+' ELSE CAST(pos AS VARCHAR) END AS bin,
concat_ws('|', CASE WHEN x = 0 OR y = 0 THEN 'edge' END, CASE WHEN w * h < 400 THEN 'tiny' END) AS flags FROM {BOX}""")
def p4_p6_flags(spark: SparkSession, sf: str) -> DataFrame:
    f = sc.flags({"tiny": F.col("w") * F.col("h") < 400, "edge": (F.col("x") == 0) | (F.col("y") == 0)})
    return _box(spark, sf).select("ann_id", sc.score_bucket(F.col("score")).alias("bucket"), sc.count_bin(F.col("pos")).alias("bin"), F.array_join(f, "|").alias("flags"))


@query(f"""SELECT ann_id, (x + w / 2) / 800 AS cx, (y + h / 2) / 700 AS cy, w / 800 AS nw, h / 700 AS nh, x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 600 + 1e-6 AND y + h <= 500 + 1e-6 AS inside FROM {BOX}""")
def p9_p10_v6_yolo(spark: SparkSession, sf: str) -> DataFrame:
    b = tuple(F.col(c) for c in "xywh")
    cx, cy, w, h = bx.to_yolo(b, F.lit(800), F.lit(700))
    return _box(spark, sf).select("ann_id", cx.alias("cx"), cy.alias("cy"), w.alias("nw"), h.alias("nh"), bx.inside(b, F.lit(600.0), F.lit(500.0)).alias("inside"))


@query(f"""SELECT ann_id, CASE pos WHEN 2 THEN 800 - x WHEN 3 THEN 800 - x WHEN 5 THEN y WHEN 6 THEN 700 - y WHEN 7 THEN 700 - y ELSE x END AS px,
CASE pos WHEN 3 THEN 700 - y WHEN 4 THEN 700 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 800 - x ELSE y END AS py, least(w, 300 - x) AS cw FROM {BOX}""")
def p12_p15_orient(spark: SparkSession, sf: str) -> DataFrame:
    px, py = bx.oriented_point(F.col("x"), F.col("y"), F.lit(800.0), F.lit(700.0), F.col("pos"))
    return _box(spark, sf).select("ann_id", px.alias("px"), py.alias("py"), bx.clamp(tuple(F.col(c) for c in "xywh"), F.lit(300.0), F.lit(500.0))[2].alias("cw"))


@query(f"SELECT ann_id, least(1.0, 120 / greatest(w, h)) AS scale, CAST(greatest(1, round_even(w * least(1.0, 120 / greatest(w, h)), 0)) AS INTEGER) AS sw FROM {BOX}")
def p14_resize(spark: SparkSession, sf: str) -> DataFrame:
    scale, w, _ = bx.fit_long_side(F.col("w"), F.col("h"), 120)
    return _box(spark, sf).select("ann_id", scale.alias("scale"), w.alias("sw"))


@query("""SELECT user_id, min(substr(sha256('7:' || CAST(event_id AS VARCHAR)), 1, 12)) AS first_key, substr(sha256(CAST(min(event_id) AS VARCHAR) || '|' || CAST(max(event_id) AS VARCHAR)), 1, 16) AS pair FROM events GROUP BY 1""")
def p23_p25_hash_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").groupBy("user_id").agg(F.min(F.substring(sc.order_key("7", F.col("event_id")), 1, 12)).alias("first_key"), sc.pair_id(F.min("event_id"), F.max("event_id")).alias("pair"))


@query(r"""SELECT page_id, regexp_extract(url, '([0-9]+)', 1) AS digits, regexp_replace(url || '?a=1&token=' || CAST(page_id AS VARCHAR) || '&b=2', '([?&]token=)[^&\s]+', '\1[REDACTED]') AS safe,
regexp_extract(CASE page_id % 3 WHEN 0 THEN '**YES** it is' WHEN 1 THEN 'NO.' ELSE 'maybe YES' END, '^(\*\*)?(YES|NO|UNCLEAR)\b', 2) AS answer, list_contains(string_split(url, '/'), '..') OR starts_with(url, '/') AS unsafe FROM pages""")
def p26_p27_p28_p31_text(spark: SparkSession, sf: str) -> DataFrame:
    said = sc.case([(F.col("page_id") % 3 == 0, "**YES** it is"), (F.col("page_id") % 3 == 1, "NO.")], "maybe YES")
    url = F.concat(F.col("url"), F.lit("?a=1&token="), F.col("page_id").cast("string"), F.lit("&b=2"))
    return _t(spark, sf, "pages").select("page_id", F.regexp_extract("url", "([0-9]+)", 1).alias("digits"), sc.redacted(url).alias("safe"), sc.answer_word(said).alias("answer"), sc.unsafe_path(F.col("url")).alias("unsafe"))


# --- joins


@query("SELECT o_orderkey, c_name, CASE WHEN c_custkey IS NULL THEN 'unmatched' WHEN c_nationkey % 5 = o_custkey % 5 THEN 'match' ELSE 'mismatch' END AS status FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) c ON o_custkey = c_custkey")
def j1_j2_lookup_status(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").where("c_custkey % 4 <> 0").select("c_custkey", "c_name", "c_nationkey")
    status = sc.case([(F.col("c_custkey").isNull(), "unmatched"), (F.col("c_nationkey") % 5 == F.col("o_custkey") % 5, "match")], "mismatch")
    return _t(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", status.alias("status"))


@query("SELECT coalesce(o.k, c.k) AS o_custkey, CASE WHEN c.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0) c ON o.k = c.k WHERE o.k IS NULL OR c.k IS NULL")
def j3_j24_u2_u4_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return rel.set_difference(_t(spark, sf, "orders").where("o_custkey % 3 <> 0"), c, "o_custkey")


@query("""SELECT 'orphan' AS gate, CAST(o_orderkey AS VARCHAR) AS key, 'missing' AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)
UNION ALL SELECT 'childless', CAST(c_custkey AS VARCHAR), 'missing' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'unique', CAST(o_custkey AS VARCHAR), CAST(count(*) AS VARCHAR) FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'price', CAST(o_orderkey AS VARCHAR), 'violated' FROM orders WHERE o_totalprice >= 300000
UNION ALL SELECT 'splits', CAST(o_orderpriority AS VARCHAR), CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders GROUP BY o_orderpriority HAVING count(DISTINCT o_orderstatus) <> 2""")
def v1_v10_j6_j7_integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer")
    orphan = o.join(c.where("c_custkey % 7 <> 0").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("orphan").alias("gate"), F.col("o_orderkey").cast("string").alias("key"), F.lit("missing").alias("detail"))
    return gates.report([orphan, gates.childless(c, "c_custkey", o, "o_custkey"), gates.unique_key(o, "o_custkey", "unique"), gates.holds(o, "o_orderkey", F.col("o_totalprice") < 300000, "price"), gates.every_group_has(o, "o_orderpriority", "o_orderstatus", 2, "splits")])


@query()
def j11_j12_hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", (_md5_long(F.col("c_custkey") % 50).bitwiseXOR(F.expr("shiftleft(1L, CAST(c_custkey % 60 AS INT))"))).alias("h"))
    return rel.hamming_pairs(c, "c_custkey", "h", 4)


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def j15_d4_v14_spanning_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rel.spanning(_t(spark, sf, "orders"), "o_custkey", "o_orderstatus")


_IOU = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"


@query(f"SELECT a.ann_id AS a, b.ann_id AS b, round({_IOU} / (a.w * a.h + b.w * b.h - {_IOU}), 9) AS iou FROM {BOX} a JOIN {BOX} b ON a.image_id = b.image_id AND a.ann_id < b.ann_id WHERE {_IOU} / (a.w * a.h + b.w * b.h - {_IOU}) > 0.3")
def j18_p19_overlapping_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf)
    a = b.select("image_id", F.col("ann_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xywh"])
    o = b.select("image_id", F.col("ann_id").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    score = bx.iou(bx.corners(*[F.col(f"a{c}") for c in "xywh"]), bx.corners(*[F.col(f"b{c}") for c in "xywh"]))
    return a.join(o, "image_id").where("a < b").withColumn("iou", score).where("iou > 0.3").select("a", "b", F.round("iou", 9).alias("iou"))


@query(f"SELECT a.ann_id AS a, min(b.ann_id) AS b FROM {BOX} a JOIN {BOX} b ON a.image_id = b.image_id AND a.ann_id <> b.ann_id AND abs(a.x - b.x) < 10 AND abs(a.w - b.w) < 40 GROUP BY 1")
def j17_near_equal_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf)
    o = b.select("image_id", F.col("ann_id").alias("b"), F.col("x").alias("bx"), F.col("w").alias("bw"))
    return b.join(o, "image_id").where("ann_id <> b AND abs(x - bx) < 10 AND abs(w - bw) < 40").groupBy(F.col("ann_id").alias("a")).agg(F.min("b").alias("b"))


@query("""SELECT o_orderkey, coalesce(m.v, r.v, o_orderstatus) AS status, CASE WHEN m.v IS NOT NULL THEN 'manual' WHEN r.v IS NOT NULL THEN 'review' ELSE 'detector' END AS origin
FROM orders o LEFT JOIN (SELECT o_orderkey AS k, 'M' AS v FROM orders WHERE o_orderkey % 11 = 0) m ON k = o_orderkey LEFT JOIN (SELECT o_orderkey AS k2, 'R' AS v FROM orders WHERE o_orderkey % 3 = 0) r ON k2 = o_orderkey""")
def j19_r2_precedence(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    m = o.where("o_orderkey % 11 = 0").select("o_orderkey", F.lit("M").alias("m"))
    r = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("R").alias("r"))
    origin = sc.case([(F.col("m").isNotNull(), "manual"), (F.col("r").isNotNull(), "review")], "detector")
    return o.join(m, "o_orderkey", "left").join(r, "o_orderkey", "left").select("o_orderkey", F.coalesce("m", "r", "o_orderstatus").alias("status"), origin.alias("origin"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 4 <> 0) a FULL JOIN (SELECT c_custkey AS k, -1.0 AS v FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k")
def j26_combine_first(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    left = c.where("k % 4 <> 0").select("k", F.when(F.col("k") % 3 != 0, F.col("c_acctbal")).alias("v"))
    return rel.combine_first(left, c.where("k % 2 = 0").select("k", F.lit(-1.0).alias("v")), ["k"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j20_r12_resume(spark: SparkSession, sf: str) -> DataFrame:
    done = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, sf, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


# --- deduplication, graph, splits, windows, samples


@query("SELECT l_orderkey, l_linenumber, first_value(l_linenumber) OVER w AS winner FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC, l_linenumber) QUALIFY row_number() OVER w > 1")
def d1_d2_d3_dedup_audit(spark: SparkSession, sf: str) -> DataFrame:
    _, removed = rel.keep_best(_t(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity"), ["l_orderkey", "l_returnflag"], [F.col("l_quantity").desc(), F.col("l_linenumber")], "l_linenumber")
    return removed.select("l_orderkey", "l_linenumber", "winner")


_EDGES = "(SELECT c_custkey AS a, c_custkey + 1 + c_nationkey AS b FROM customer)"
#: Smallest labels travel along the edges until none changes; the keyed table holds one row a node.
_COMP = f"""WITH RECURSIVE e AS (SELECT a, b FROM {_EDGES} UNION SELECT b, a FROM {_EDGES}),
k(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(c.component) FROM k c JOIN e ON e.a = c.node JOIN recurring.k r ON r.node = e.b WHERE c.component < r.component GROUP BY e.b)"""


def _components(spark: SparkSession, sf: str) -> DataFrame:
    return connected_components(_t(spark, sf, "customer").selectExpr("c_custkey AS src", "c_custkey + 1 + c_nationkey AS dst"))


@query(f"{_COMP} SELECT node, component FROM k")
def g1_g2_g3_components(spark: SparkSession, sf: str) -> DataFrame:
    return _components(spark, sf)


@query(f"{_COMP} SELECT substr(sha256(string_agg(CAST(node AS VARCHAR), '' ORDER BY node)), 1, 16) AS component_id, count(*) AS n FROM k GROUP BY component")
def a29_component_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of a component's sorted members is one string by its definition."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), "")
    return _components(spark, sf).groupBy("component").agg(F.substring(F.sha2(members, 256), 1, 16).alias("component_id"), F.count(F.lit(1)).alias("n")).drop("component")


@query("SELECT user_id, island, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, CAST(sum(j) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 50 THEN 0 ELSE 1 END AS j FROM events)) GROUP BY 1, 2")
def g7_w1_bursts(spark: SparkSession, sf: str) -> DataFrame:
    return rel.islands(_t(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", 50).groupBy("user_id", "island").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT o_custkey AS gid, count(*) AS size FROM orders GROUP BY 1), t AS (SELECT floor(sum(size) * 0.15) AS v FROM g),
s AS (SELECT gid, size, coalesce(sum(size) OVER (ORDER BY sha256('split:' || CAST(gid AS VARCHAR)), gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WHERE size < 20),
e AS (SELECT coalesce(max(before + size), 0) AS taken FROM s, t WHERE before < v)
SELECT gid, size, CASE WHEN before < v THEN 'valid' WHEN before - taken < v THEN 'test' ELSE 'train' END AS split FROM s, t, e
UNION ALL SELECT gid, size, 'train' FROM g WHERE size >= 20""")
def x1_w4_group_splits(spark: SparkSession, sf: str) -> DataFrame:
    g = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("gid")).agg(F.count(F.lit(1)).alias("size"))
    return splits.fill_splits(g, "gid", "size", 0.15, 0.15, 20, "split")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) OVER (PARTITION BY l_returnflag) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY sha256('s:' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)), l_orderkey * 10 + l_linenumber) AS k FROM lineitem)
SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS id FROM r WHERE k <= greatest(ceil(n * 0.01), 25)""")
def q1_w3_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    b = _t(spark, sf, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return rel.stratified_sample(b, ["l_returnflag"], "id", 0.01, 25, "s").select("l_returnflag", "id")


@query("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY event_type) // 20) AS step FROM events) SELECT event_type, event_id FROM r WHERE k % step = 0 AND k / step < 20")
def q2_systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rel.systematic_sample(_t(spark, sf, "events").select("event_type", "event_id"), ["event_type"], [F.col("event_id")], 20).select("event_type", "event_id")


@query(f"SELECT image_id, label, ann_id FROM {BOX} QUALIFY row_number() OVER (PARTITION BY label ORDER BY image_id, ann_id) <= 2")
def q6_o5_per_class_subset(spark: SparkSession, sf: str) -> DataFrame:
    return rel.ranked(_box(spark, sf).select("image_id", "label", "ann_id"), ["label"], [F.col("image_id"), F.col("ann_id")]).where("rank <= 2").drop("rank")


@query(f"SELECT ann_id, CAST(row_number() OVER (PARTITION BY split ORDER BY image_id, ann_id, x, y, w) AS INTEGER) AS dense_id, 'B' || CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ann_id, x, y, w) AS VARCHAR) AS name FROM {BOX}")
def w2_w7_numbering(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("B"), F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("score").desc(), "ann_id", "x", "y", "w")).cast("string"))
    named = _box(spark, sf).withColumn("name", name)
    return rel.numbered(named, ["split"], ["image_id", "ann_id", "x", "y", "w"], "dense_id").select("ann_id", F.col("dense_id").cast("int").alias("dense_id"), "name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS state FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def u1_u7_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"))
    return rel.upsert(c, c.where("c_custkey % 4 = 0").withColumn("state", F.lit("new")), "c_custkey")


@query("SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey INTERSECT SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def u3_intersect(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    by = lambda t, k: n.join(_t(spark, sf, t).select(k), F.col("n_nationkey") == F.col(k), "left_semi").select("n_name")
    return by("customer", "c_nationkey").intersect(by("supplier", "s_nationkey"))


def queries() -> dict[str, Query]:
    from loomwork import more_queries  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
