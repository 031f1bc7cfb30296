"""Average precision and recall over overlap thresholds and area ranges, by label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.store import stored

#: Overlap thresholds 0.50, 0.55, ... 0.95; area ranges in pixels; detections counted for each image.
STEPS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
MOST = (1, 10, 100)
#: Area a and step t are bit a * len(STEPS) + t of a mark.
BITS = len(AREAS) * len(STEPS)
#: Rows of a task, boxes and pairs matched in one go, and marks of one stored chunk; sizes only, no result depends on them.
TASK, BOXES, PAIRS, CHUNK = 500_000, 200_000, 2_000_000, 1 << 14


def _near(truth: np.ndarray, found: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(detection, truth, overlap) of every pair that reaches the least step; detection i meets the truths begin[i] to end[i]."""
    size, own = truth[:, 2] * truth[:, 3], found[:, 2] * found[:, 3]
    many = end - begin
    cuts = np.flatnonzero(np.diff(np.cumsum(many) // PAIRS, prepend=0))
    parts = []
    for a, b in zip([0, *cuts], [*cuts, len(many)], strict=True):
        d = np.repeat(np.arange(a, b), many[a:b])
        g = np.arange(len(d)) + np.repeat(begin[a:b] - np.cumsum(many[a:b]) + many[a:b], many[a:b])
        both = np.ones(len(d))
        for k in (0, 1):
            high = np.minimum(found[d, k] + found[d, k + 2], truth[g, k] + truth[g, k + 2])
            both *= np.clip(high - np.maximum(found[d, k], truth[g, k]), 0, None)
        union = own[d] + size[g] - both
        overlap = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        keep = np.flatnonzero(overlap >= STEPS[0])
        parts.append((d[keep], g[keep], overlap[keep]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _matched(truth: np.ndarray, found: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hits, counted) of each detection as bits; many images at once.

    truth, found: rows of x, y, w, h, truths in their order and detections best first (place 0, 1, ...) within an image.
    The detections of one place, each of another image, choose together: of the free truths that reach the step one
    inside the area range first, then the largest overlap, then the last.  A truth outside the range is ignored with
    the detection that takes it, and so is an unmatched detection outside the range.
    """
    size, own = truth[:, 2] * truth[:, 3], found[:, 2] * found[:, 3]
    hits, ignored = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    d, g, o = _near(truth, found, begin, end)
    for a, (least, most) in enumerate(AREAS.values()):
        out = (size < least) | (size > most)
        order = np.lexsort((-g, -o, out[g], d, place[d]))
        ds, gs, os = d[order], g[order], o[order]
        cuts = np.flatnonzero(np.diff(place[ds], prepend=-1))
        free = np.ones((len(STEPS), len(truth)), bool)
        for lo, hi in zip(cuts, np.append(cuts, len(ds))[1:], strict=True):
            for t, step in enumerate(STEPS):
                fit = lo + np.flatnonzero((os[lo:hi] >= step) & free[t, gs[lo:hi]])
                best = fit[np.diff(ds[fit], prepend=-1) != 0]
                free[t, gs[best]] = False
                hits[ds[best]] |= 1 << (a * len(STEPS) + t)
                best = best[out[gs[best]]]
                ignored[ds[best]] |= 1 << (a * len(STEPS) + t)
        whole = ((1 << len(STEPS)) - 1) << (a * len(STEPS))
        ignored |= np.where((own < least) | (own > most), ~hits & whole, 0)
    return hits & ~ignored, ~ignored & ((1 << BITS) - 1)


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it; nulls are equal."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _tasks(df: DataFrame, rows: int) -> int:
    """Partitions for so many rows."""
    return max(1 + rows // TASK, min(df.sparkSession.sparkContext.defaultParallelism, 1 + rows // (TASK // 25)))


def _marks(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(label, image_id, place, order, hits, counted) of at most 100 detections for each image and label; bits over areas and steps."""
    box = [F.col(c).cast("double").alias(c) for c in "xywh"]
    score = F.col("score").cast("double")
    none = F.lit(None).cast("double")
    both = truth.select("image_id", "label", F.lit(False).alias("found"), none.alias("order"), "pos", *box).unionByName(found.select("image_id", "label", F.lit(True).alias("found"), (-score).alias("order"), "pos", *box))
    dealt = both.repartition(_tasks(both, both.count()), "image_id", "label").sortWithinPartitions("image_id", "label", "found", F.col("order").asc_nulls_last(), "pos", *"xywh").drop("pos")

    def matched(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        number = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(table)))
        is_found = table["found"].to_numpy()
        boxes = np.stack([table[c].to_numpy() for c in "xywh"], 1)
        own = number[~is_found]
        at = np.flatnonzero(is_found)
        place = np.arange(len(at)) - np.searchsorted(number[at], number[at])
        at, place = at[place < MOST[-1]], place[place < MOST[-1]]
        with np.errstate(invalid="ignore", over="ignore"):
            hits, counted = _matched(boxes[~is_found], boxes[at], np.searchsorted(own, number[at]), np.searchsorted(own, number[at], "right"), place)
        out = table.select(["label", "image_id", "order"]).take(pa.array(at))
        for name, values in (("place", place.astype(np.int32)), ("hits", hits), ("counted", counted)):
            out = out.append_column(name, pa.array(values))
        return out.select(["label", "image_id", "place", "order", "hits", "counted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, BOXES
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= enough:
                table = pa.Table.from_batches(held).combine_chunks()
                starts = _starts(table["image_id"].combine_chunks(), table["label"].combine_chunks())
                yield from matched(table.slice(0, starts[-1]), starts[:-1]).to_batches() if len(starts) > 1 else []
                # the last group may go on; one larger than a batch is not looked at again at each further batch
                held, rows = table.slice(starts[-1]).to_batches(), len(table) - starts[-1]
                enough = max(BOXES, 2 * rows)
        if rows:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from matched(table, _starts(table["image_id"].combine_chunks(), table["label"].combine_chunks())).to_batches()

    kinds = dict(both.dtypes)
    return dealt.mapInArrow(run, f"label {kinds['label']}, image_id {kinds['image_id']}, place int, order double, hits long, counted long")


def _bits(values: np.ndarray) -> np.ndarray:
    """(rows, BITS) of 0 and 1."""
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(len(values), 8), axis=1, bitorder="little")[:, :BITS]


_SUMS = ["n", "tp", *[f"h{m}" for m in MOST]]


def _chunks(marks: DataFrame) -> DataFrame:
    """The marks in order as runs of at most CHUNK of one label: label, part, seq (their order), sums by bit, packed bits."""
    order = ["label", F.col("order").asc_nulls_last(), "image_id", "place"]
    dealt = marks.repartitionByRange(_tasks(marks, marks.count()), *order).sortWithinPartitions(*order).select("label", "place", "hits", "counted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0

        def chunk(rows: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            hits, counted, place = (rows[c].to_numpy() for c in ("hits", "counted", "place"))
            hit = _bits(hits)
            sums = [_bits(counted), hit, *[hit[place < m] for m in MOST]]
            one = [pa.array([s.sum(0, dtype=np.int64)], pa.list_(pa.int64())) for s in sums]
            seq += 1
            packed = [pa.array([v.astype("<i8").tobytes()], pa.binary()) for v in (hits, counted)]
            return pa.RecordBatch.from_arrays([rows["label"].slice(0, 1).combine_chunks(), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), *one, *packed], names=["label", "part", "seq", *_SUMS, "hits", "counted"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*([] if held is None else held.to_batches()), batch]).combine_chunks()
            starts = [*_starts(table["label"].combine_chunks()), len(table)]
            cuts = [c for a, b in zip(starts, starts[1:], strict=False) for c in range(a, b, CHUNK)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield chunk(table.slice(a, b - a))
            held = table.slice(cuts[-1])
        if held is not None:
            yield chunk(held)

    sums = ", ".join(f"{c} array<long>" for c in _SUMS)
    return dealt.mapInArrow(run, f"label {dict(marks.dtypes)['label']}, part int, seq long, {sums}, hits binary, counted binary")


def _lists(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return np.array(batch[name].to_pylist()).reshape(batch.num_rows, -1)


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("part", "ascending"), ("seq", "ascending")])


def _begins(chunks: DataFrame) -> DataFrame:
    """(part, seq, n0, tp0): sums over the chunks of the label before; a label has one row for each CHUNK of marks."""

    def run(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        before = [pa.array((np.cumsum(v, 0) - v).tolist(), pa.list_(pa.int64())) for v in (_lists(table, "n"), _lists(table, "tp"))]
        return pa.table([table["part"], table["seq"], *before], names=["part", "seq", "n0", "tp0"])

    return chunks.select("label", "part", "seq", "n", "tp").groupBy("label").applyInArrow(run, "part int, seq long, n0 array<long>, tp0 array<long>")


def _points(chunks: DataFrame) -> DataFrame:
    """For each chunk the best precision by bit, and for each recall k / 100 first reached in it (bit, k, best precision from there on in it).

    chunks: also n0, tp0, positives (by area).  Recall k / 100 is reached by the first hit number tp with 100 tp >= k positives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, points = [], []
            for i in range(batch.num_rows):
                hits, counted = (np.frombuffer(batch[c][i].as_py(), "<i8") for c in ("hits", "counted"))
                n0, tp0, positives = (np.array(batch[c][i].as_py()) for c in ("n0", "tp0", "positives"))
                hit = _bits(hits)
                tp, n = tp0 + np.cumsum(hit, 0, dtype=np.int64), n0 + np.cumsum(_bits(counted), 0, dtype=np.int64)
                p = np.where(hit, tp / np.maximum(n, 1), 0.0)
                later = np.maximum.accumulate(p[::-1], 0)[::-1]
                tops.append(later[0].tolist())
                own = []
                for c in range(BITS):
                    total = int(positives[c // len(STEPS)])
                    need = np.maximum(1, -(-np.arange(101) * total // 100))
                    k = np.flatnonzero((need > tp0[c]) & (need <= tp[-1, c])) if total else []
                    own += [{"bit": c, "k": int(x), "p": float(y)} for x, y in zip(k, later[np.searchsorted(tp[:, c], need[k]), c], strict=True)] if len(k) else []
                points.append(own)
            kind = pa.list_(pa.struct([("bit", pa.int32()), ("k", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("label", "part", "seq")), pa.array(tops, pa.list_(pa.float64())), pa.array(points, kind)], names=["label", "part", "seq", "top", "points"])

    return chunks.mapInArrow(run, f"label {dict(chunks.dtypes)['label']}, part int, seq long, top array<double>, points array<struct<bit:int,k:int,p:double>>")


def _areas_under(points: DataFrame) -> DataFrame:
    """(label, ap): the precision at 101 recalls, where a later chunk may hold the best, by bit."""

    def run(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        ap, later = np.zeros(BITS), np.zeros(BITS)
        for top, own in zip(reversed(table["top"].to_pylist()), reversed(table["points"].to_pylist()), strict=True):
            for x in own:
                ap[x["bit"]] += max(x["p"], later[x["bit"]])
            later = np.maximum(later, top)
        return pa.table([table["label"].slice(0, 1), pa.array([(ap / 101).tolist()], pa.list_(pa.float64()))], names=["label", "ap"])

    return points.groupBy("label").applyInArrow(run, f"label {dict(points.dtypes)['label']}, ap array<double>")


def coco_table(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(label, area, step, positives, ap, ar1, ar10, ar100) for every label, area range and overlap threshold; null without
    positives.  truth: (image_id, pos, label, x, y, w, h); found: also score.

    Precision is interpolated at 101 recalls.  Detections are ordered by falling score (null last), image and place, dealt
    in ranges of that order and packed in chunks with the bits of all areas and thresholds; only the sums of chunks are
    ordered by one task a label, so none orders the detections of a whole label or of one score.
    """
    size = F.nanvl(F.col("w").cast("double") * F.col("h").cast("double"), F.lit(None).cast("double"))
    inside = [F.coalesce(~((size < least) | (size > most)), F.lit(True)).cast("long").alias(f"v{a}") for a, (least, most) in enumerate(AREAS.values())]
    each = truth.select("label", *inside).unionByName(found.select("label", *[F.lit(0).cast("long").alias(f"v{a}") for a in range(len(AREAS))]))
    labels = stored(each.groupBy("label").agg(*[F.sum(f"v{a}").alias(f"v{a}") for a in range(len(AREAS))]).select("label", F.array(*[f"v{a}" for a in range(len(AREAS))]).alias("positives")))
    chunks = stored(_chunks(stored(_marks(truth, found)).where("counted <> 0")))
    own = lambda df: df.withColumnRenamed("label", "__label")
    on = F.col("label").eqNullSafe(F.col("__label"))
    ready = chunks.select("label", "part", "seq", "hits", "counted").join(stored(_begins(chunks)), ["part", "seq"]).join(own(labels), on).drop("__label")
    area_under = _areas_under(stored(_points(ready)))
    by_bit = [F.sum(F.col(f"h{m}")[b]) for m in MOST for b in range(BITS)]
    recall = chunks.groupBy("label").agg(F.array(*by_bit).alias("h"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit")
    out = labels.join(own(area_under), on, "left").drop("__label").join(own(recall), on, "left").drop("__label").select("label", "positives", "ap", "h", grid)
    area, step = F.floor(F.col("bit") / len(STEPS)).cast("int"), F.col("bit") % len(STEPS)
    out = out.select("label", F.element_at(F.array(*map(F.lit, AREAS)), area + 1).alias("area"), F.element_at(F.array(*map(F.lit, STEPS)), step + 1).alias("step"), F.element_at("positives", area + 1).alias("positives"), F.element_at("ap", F.col("bit") + 1).alias("ap"), *[F.element_at("h", F.col("bit") + 1 + i * BITS).alias(f"h{m}") for i, m in enumerate(MOST)])
    known = lambda c: F.when(F.col("positives") > 0, F.coalesce(c, F.lit(0.0)))
    return out.select("label", "area", "step", "positives", known(F.col("ap")).alias("ap"), *[known(F.col(f"h{m}") / F.col("positives")).alias(f"ar{m}") for m in MOST])


def coco_summary(table: DataFrame) -> DataFrame:
    """The twelve numbers from coco_table, means over labels with positives; null where there are none."""
    mean = lambda value, area, step=None: F.avg(F.when((F.col("area") == area) & (F.lit(True) if step is None else F.col("step") == step), F.col(value)))
    numbers = {
        "mAP_50_95": mean("ap", "all"), "AP50": mean("ap", "all", 0.5), "AP75": mean("ap", "all", 0.75), "AP_small": mean("ap", "small"), "AP_medium": mean("ap", "medium"), "AP_large": mean("ap", "large"),
        "AR1": mean("ar1", "all"), "AR10": mean("ar10", "all"), "AR100": mean("ar100", "all"), "AR_small": mean("ar100", "small"), "AR_medium": mean("ar100", "medium"), "AR_large": mean("ar100", "large"),
    }
    return table.agg(*[c.alias(k) for k, c in numbers.items()])


def label_precision(table: DataFrame) -> DataFrame:
    """(label, ap50, ap50_95) from coco_table."""
    every = table.where("area = 'all'")
    return every.groupBy("label").agg(F.avg(F.when(F.col("step") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))
