"""Assigning groups to train, valid and test, without one task that orders all groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.scalars import order_key


def sums_before(rows: DataFrame, keys: list[str], key: Column, tie: str, value: Column, name: str = "before") -> DataFrame:
    """rows with the sum of `value` over the rows before them in the order of a hash key (hex) within keys.

    Rows are summed within the 4096 runs of the key's first three digits and over the runs,
    so no task sorts a whole group.
    """
    runs = rows.withColumn("__key", key).withColumn("__run", F.substring("__key", 1, 3)).withColumn("__value", value.cast("long"))
    totals = runs.groupBy(*keys, "__run").agg(F.sum("__value").alias("__k"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__run").alias("__r"), F.coalesce(F.sum("__k").over(over), F.lit(0)).alias("__begin"))
    inside = Window.partitionBy(*keys, "__run").orderBy("__key", tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("__within", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    on = F.col("__run") == F.col("__r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return placed.join(begins, on).select(*rows.columns, (F.col("__begin") + F.col("__within")).alias(name))


def fill_splits(groups: DataFrame, id_col: str, size: str, valid: float, test: float, large: int, seed: str) -> DataFrame:
    """groups with split: groups of `large` rows or more train; the others, in hash order, fill valid until its target
    is reached, then test, counted from where valid ended, then train."""
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    v, t = int(total * valid), int(total * test)
    small = sums_before(groups.where(F.col(size) < large), [], order_key(seed, F.col(id_col)), id_col, F.col(size))
    taken = small.where(F.col("before") < v).agg(F.coalesce(F.max(F.col("before") + F.col(size)), F.lit(0))).first()[0]
    split = F.when(F.col("before") < v, "valid").when(F.col("before") - taken < t, "test").otherwise("train")
    return small.withColumn("split", split).select(*groups.columns, "split").unionByName(groups.where(F.col(size) >= large).withColumn("split", F.lit("train")))


def stratified_fill(groups: DataFrame, stratum: str, id_col: str, size: str, valid: float = 0.15, test: float = 0.15, large: int = 5, seed: str = "split") -> DataFrame:
    """groups with split, per stratum: groups of `large` or more train; each other one, in hash order, goes where more
    is still needed (valid on a tie), else to train.

    Each choice depends on all before it in its stratum, so a stratum is read in order by one
    task as a stream that holds two numbers; strata run side by side.
    """
    total = groups.groupBy(F.col(stratum).alias("__s")).agg(F.sum(size).alias("__n"))
    target = lambda share: F.bround(F.col("__n") * share, 0).cast("long")
    small = groups.where(F.col(size) < large).join(total, F.col(stratum).eqNullSafe(F.col("__s"))).select(*groups.columns, target(valid).alias("__v"), target(test).alias("__t"), order_key(seed, F.col(id_col)).alias("__key"))
    at = {c: i for i, c in enumerate(groups.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, need = (), [0, 0]
        for batch in batches:
            out = []
            for s, k, v, t in zip(*(batch.column(c).to_pylist() for c in (stratum, size, "__v", "__t")), strict=True):
                if (s,) != last:
                    last, need = (s,), [v, t]
                side = 0 if need[0] >= need[1] and need[0] > 0 else 1 if need[1] > 0 else None
                if side is not None:
                    need[side] -= k
                out.append("train" if side is None else ("valid", "test")[side])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at.values()), pa.array(out, pa.string())], names=[*at, "split"])

    ordered = small.repartition(stratum).sortWithinPartitions(stratum, "__key", id_col)
    schema = groups.withColumn("split", F.lit("")).schema
    return ordered.mapInArrow(run, schema).unionByName(groups.where(F.col(size) >= large).withColumn("split", F.lit("train")))


def component_splits(members: DataFrame, component: str, label: str, origin: str, most: int = 4, share: float = 0.15, seed: str = "split") -> DataFrame:
    """members with assigned: a component of one origin and at most `most` members keeps it, others train; then whole
    train components of one label fill valid and test up to `share` of the label's members, best fit first.

    Which sizes are taken depends only on how many components of each label and size there
    are (labels x most numbers, on the driver); the components are then taken in hash order.
    """
    parts = members.groupBy(component).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(origin).alias("origins"), F.min(origin).alias("first"), F.count_distinct(label).alias("labels"), F.min(label).alias("label"))
    movable = (F.col("origins") == 1) & (F.col("n") <= most)
    parts = parts.withColumn("assigned", F.when(movable, F.col("first")).otherwise("train")).withColumn("free", movable & (F.col("first") == "train") & (F.col("labels") == 1))
    counts = members.join(parts.select(F.col(component).alias("__c"), "assigned"), F.col(component) == F.col("__c")).groupBy(label).agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("assigned") == s).alias(s) for s in ("valid", "test")]).collect()
    stock = {(r["label"], r["n"]): r["k"] for r in parts.where("free").groupBy("label", "n").agg(F.count(F.lit(1)).alias("k")).collect()}
    taken: list[tuple[object, int, int, int]] = []
    for r in counts:
        got = {}
        for split in ("valid", "test"):
            lacking = round(share * r["all"]) - r[split]
            while lacking > 0:
                fits = [n for n in range(1, most + 1) if n <= lacking + 1 and stock.get((r[label], n), 0) > 0]
                if not fits:
                    break
                n = min(fits, key=lambda n: (abs(lacking - n), n))
                times = max(1, min((lacking - most) // n, stock[r[label], n]))  # far from the target the same size stays the best
                stock[r[label], n] -= times
                got[split, n] = got.get((split, n), 0) + times
                lacking -= n * times
        taken += [(r[label], n, got.get(("valid", n), 0), got.get(("test", n), 0)) for n in range(1, most + 1)]
    spark = members.sparkSession
    kind = dict(members.dtypes)[label]
    quota = spark.createDataFrame(taken, f"__label {kind}, __n long, to_valid long, to_test long")  # labels x most rows
    free = sums_before(parts.where("free"), ["label", "n"], order_key(seed, F.col(component)), component, F.lit(1))
    moved = free.join(F.broadcast(quota), F.col("label").eqNullSafe(F.col("__label")) & (F.col("n") == F.col("__n"))).select(F.col(component).alias("__m"), F.when(F.col("before") < F.col("to_valid"), "valid").when(F.col("before") < F.col("to_valid") + F.col("to_test"), "test").alias("moved")).where("moved is not null")
    place = parts.join(moved, F.col(component) == F.col("__m"), "left").select(F.col(component).alias("__c"), F.coalesce("moved", "assigned").alias("assigned"), F.col("moved").isNotNull().alias("rebalanced"))
    return members.join(place, F.col(component) == F.col("__c")).drop("__c")


def move_log(assigned: DataFrame, key: str, origin: str, to: str = "assigned") -> DataFrame:
    """(key, from, to, reason) of members that left their origin; assigned: what component_splits gives."""
    reason = F.when(F.col("rebalanced"), "class-stratified rebalance").otherwise("group or perceptual-risk split isolation")
    return assigned.where(F.col(origin) != F.col(to)).select(key, F.col(origin).alias("from"), F.col(to).alias("to"), reason.alias("reason"))
