"""Detection evaluation: greedy matching, threshold sweeps and confusion."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.scalars import f1_of, ratio
from loomwork.operators.relational import running_sum


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(2)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(1)
    union = area(a)[:, None] + area(b)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def match_boxes(truth: DataFrame, predicted: DataFrame, iou: float = 0.5, tie_highest: bool = True) -> DataFrame:
    """One row for each prediction and each unmatched truth.

    truth: (image_id, pos, label, x1, y1, x2, y2); predicted: with score.  Within an image the
    predictions go by falling score, then position, and take the free truth box of the largest
    overlap of at least `iou`, whatever its label; of equal overlaps the last box
    (tie_highest) or the first.  Returns (image_id, pred_pos, score, pred_label, truth_pos, truth_label, overlap).
    """
    box = ["x1", "y1", "x2", "y2"]

    def one_image(image: int, left: np.ndarray, right: np.ndarray) -> list[tuple]:
        """left: rows of (pos, label, box); right: rows of (pos, label, box, score)."""
        left = left[np.argsort(left[:, 0], kind="stable")]
        right = right[np.lexsort((right[:, 0], -right[:, 6]))]
        over = _overlaps(right[:, 2:6], left[:, 2:6])
        free, out = np.ones(len(left), bool), []
        for i, row in enumerate(right):
            own = np.where(free, over[i], -1.0)
            j = (len(own) - 1 - int(np.argmax(own[::-1])) if tie_highest else int(np.argmax(own))) if len(own) else -1
            mine = (image, int(row[0]), float(row[6]), int(row[1]))
            if j >= 0 and own[j] >= iou:
                free[j] = False
                out.append((*mine, int(left[j, 0]), int(left[j, 1]), float(own[j])))
            else:
                out.append((*mine, None, None, None))
        return out + [(image, None, None, None, int(left[j, 0]), int(left[j, 1]), None) for j in np.flatnonzero(free)]

    names = ["image_id", "pred_pos", "score", "pred_label", "truth_pos", "truth_label", "overlap"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # a side without rows comes without columns
        left, right = left.reindex(columns=["image_id", "pos", "label", *box]), right.reindex(columns=["image_id", "pos", "label", *box, "score"])
        parts = []
        for df in (left, right):
            df = df.sort_values("image_id", kind="stable")
            ids, starts = np.unique(df["image_id"].to_numpy(np.int64), return_index=True)
            values = df.drop(columns="image_id").to_numpy(float)
            parts.append(dict(zip(ids.tolist(), np.split(values, starts[1:]), strict=True)) if len(ids) else {})
        out = [row for k in sorted({*parts[0], *parts[1]}) for row in one_image(k, parts[0].get(k, np.zeros((0, 6))), parts[1].get(k, np.zeros((0, 7))))]
        return pd.DataFrame(out, columns=names).astype({"pred_pos": "Int64", "pred_label": "Int64", "truth_pos": "Int64", "truth_label": "Int64"})

    # many images a call: runs of about 20,000 boxes, whole images each
    runs = max(8, truth.count() // 20_000)
    own = lambda df: df.withColumn("run", F.pmod(F.xxhash64("image_id"), F.lit(runs))).groupBy("run")
    # fresh columns: both sides may come from one table, and cogroup mixes up columns that they share
    predicted = predicted.select(*[F.col(c).alias(c) for c in ["image_id", "pos", "label", *box, "score"]])
    return own(truth).cogroup(own(predicted)).applyInPandas(run, "image_id long, pred_pos long, score double, pred_label long, truth_pos long, truth_label long, overlap double")


def micro_metrics(matches: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, mean_iou; a wrong label is a false positive and a false negative."""
    right = F.col("pred_label").isNotNull() & F.col("truth_label").isNotNull() & (F.col("pred_label") == F.col("truth_label"))
    sums = matches.agg(F.count_if(right).alias("tp"), F.count_if(F.col("pred_label").isNotNull() & ~F.coalesce(right, F.lit(False))).alias("fp"), F.count_if(F.col("truth_label").isNotNull() & ~F.coalesce(right, F.lit(False))).alias("fn"), F.avg("overlap").alias("mean_iou"))
    p, r, f = f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"), F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"))


def at_thresholds(truth: DataFrame, predicted: DataFrame, thresholds: list[float], iou: float = 0.5) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1, mean_iou: matching at each least score, ties to the first truth; null where undefined."""
    parts = []
    for t in thresholds:
        m = micro_metrics(match_boxes(truth, predicted.where(F.col("score") >= t), iou, tie_highest=False))
        none = lambda c, n: F.when(n > 0, F.col(c)).alias(c)
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        parts.append(m.select(F.lit(t).alias("threshold"), "tp", "fp", "fn", none("precision", tp + fp), none("recall", tp + fn), none("f1", 2 * tp + fp + fn), none("mean_iou", tp)))
    return reduce(DataFrame.unionByName, parts)


def confidence_curve(scored: DataFrame, positives: int, steps: int = 100) -> DataFrame:
    """(step, tp, fp, fn, precision, recall, f1) at thresholds 0, 1/steps, ... 1. scored: (score, correct).

    Scores are counted by the highest step they reach, so the sweep adds up steps + 1 rows.
    """
    reach = F.least(F.floor(F.col("score") * steps + 1e-9).cast("int"), F.lit(steps))
    hist = scored.groupBy(reach.alias("step")).agg(F.count_if("correct").alias("t"), F.count_if(~F.col("correct")).alias("f"))
    grid = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(F.broadcast(hist), "step", "left").select("step", F.sum(F.coalesce("t", F.lit(0))).over(down).alias("tp"), F.sum(F.coalesce("f", F.lit(0))).over(down).alias("fp"))
    out = out.withColumn("fn", F.lit(positives) - F.col("tp"))
    p, r, f = f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("step", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The step of the largest f1; of equal ones the highest."""
    return curve.agg(F.max(F.struct("f1", "step")).alias("m")).select("m.step", "m.f1")


def confusion(pairs: DataFrame, labels: list[int]) -> DataFrame:
    """(truth, pred, n, share of the truth's row) on the full grid; label 0 stands for background."""
    grid = pairs.sparkSession.createDataFrame([(a, b) for a in [0, *labels] for b in [0, *labels]], "truth long, pred long")
    counts = pairs.groupBy(F.coalesce("truth_label", F.lit(0)).alias("truth"), F.coalesce("pred_label", F.lit(0)).alias("pred")).agg(F.count(F.lit(1)).alias("k"))
    out = grid.join(counts, ["truth", "pred"], "left").withColumn("n", F.coalesce("k", F.lit(0)))
    return out.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("truth")))).select("truth", "pred", "n", "share")


def class_report(matrix: DataFrame) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 from a confusion grid."""
    row = matrix.where("truth > 0").groupBy(F.col("truth").alias("label")).agg(F.sum(F.when(F.col("pred") == F.col("truth"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("support"))
    column = matrix.where("pred > 0").groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    out = row.join(column, "label").withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))
    p, r, f = f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("label", "tp", "fp", "fn", "support", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def presence_auc(images: DataFrame) -> DataFrame:
    """AUC by rank sums of (score, present); null where only one class occurs. Ties count a half."""
    by_score = images.groupBy("score").agg(F.count_if("present").alias("p"), F.count_if(~F.col("present")).alias("q"))
    placed = running_sum(by_score, [], ["score"], F.col("q"), "below")
    sums = placed.agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums.select(ratio(F.col("u"), F.col("p") * F.col("q"), None).alias("auc"))
