"""Deduplication, sampling, splitting, set operations and reconciliation of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.scalars import order_key
from loomwork.store import stored


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df with rank: 1, 2, ... within the keys."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_best(df: DataFrame, keys: list[str], order: list[Column], id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows ranked first, removed rows with the id of their winner)."""
    both = ranked(df, keys, order).withColumn("winner", F.first(id_col).over(Window.partitionBy(*keys).orderBy(*order)))
    return both.where("rank = 1").drop("rank", "winner"), both.where("rank > 1").drop("rank")


def spanning(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys found in more than one split: (key, splits)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def islands(df: DataFrame, keys: list[str], value: str, gap: int) -> DataFrame:
    """df with island: numbered from 1 within the keys, a new one where value grows by more than gap."""
    w = Window.partitionBy(*keys).orderBy(value)
    jump = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("jump", jump).withColumn("island", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("jump")


def running_sum(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """df with the sum of `value` over the rows before it within the keys.

    Rows are dealt in ranges of (keys, order); sums are taken within a range and over the
    ranges, so a large key is shared by many tasks.  The ranges are written to the shared
    folder, as they are read twice and must not be drawn anew.
    """
    dealt = stored(df.repartitionByRange(*keys, *order).withColumns({"__range": F.spark_partition_id(), "__value": value}))
    totals = dealt.groupBy(*keys, "__range").agg(F.sum("__value").alias("__k"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r"), F.coalesce(F.sum("__k").over(over), F.lit(0)).alias("__begin"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("__range") == F.col("__r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = dealt.withColumn("__within", F.coalesce(F.sum("__value").over(inside), F.lit(0))).join(begins, on)
    return out.select(*df.columns, (F.col("__begin") + F.col("__within")).alias(name))


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with a dense number from 1 within the keys; the order must be total."""
    return running_sum(df, keys, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def _sizes(df: DataFrame, strata: list[str]) -> tuple[DataFrame, Column]:
    """(strata, __n), and the condition that joins them; one row a stratum."""
    n = df.groupBy(*[F.col(c).alias(f"__{c}") for c in strata]).agg(F.count(F.lit(1)).alias("__n"))
    on = F.lit(True)
    for c in strata:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return n, on


def stratified_sample(df: DataFrame, strata: list[str], id_col: str, rate: float, minimum: int, seed: str) -> DataFrame:
    """min(n, max(ceil(n * rate), minimum)) rows of each stratum in hash order."""
    n, on = _sizes(df, strata)
    placed = numbered(df.withColumn("__key", order_key(seed, F.col(id_col))), strata, ["__key", id_col])
    return placed.join(n, on).where(F.col("rank") <= F.greatest(F.ceil(F.col("__n") * rate), F.lit(minimum))).select(*df.columns, "rank")


def systematic_sample(df: DataFrame, strata: list[str], order: list[Column | str], k: int) -> DataFrame:
    """Every (n // k)-th row of each stratum, at most k."""
    n, on = _sizes(df, strata)
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / k))
    at = F.col("rank") - 1
    return numbered(df, strata, order).join(n, on).where((at % step == 0) & (at / step < k)).select(*df.columns, "rank")


def upsert(ledger: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """Rows of news replace rows of ledger with the same key."""
    return ledger.join(news.select(key), key, "left_anti").unionByName(news)


def combine_first(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A full join that prefers left's values and fills its nulls from right."""
    values = [c for c in left.columns if c not in keys]
    r = right.select(*keys, *[F.col(c).alias(f"__{c}") for c in values if c in right.columns])
    out = left.join(r, keys, "full_outer")
    return out.select(*keys, *[F.coalesce(c, f"__{c}").alias(c) if c in right.columns else F.col(c) for c in values])


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys on one side only."""
    both = left.select(key).distinct().withColumn("l", F.lit(True)).join(right.select(key).distinct().withColumn("r", F.lit(True)), key, "full_outer")
    return both.where("l is null or r is null").select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def hamming_pairs(df: DataFrame, id_col: str, hash_col: str, distance: int, extra: list[str] | None = None) -> DataFrame:
    """(a, b, distance) with a < b whose 64-bit hashes differ in at most `distance` bits.

    By the pigeonhole principle two such hashes agree in one of distance + 1 blocks; pairs
    meet under block values and are then verified.  Equal hashes are collapsed first and
    linked to their smallest id, so large groups of equal hashes make no pairs.
    """
    blocks = distance + 1
    edge = [64 * k // blocks for k in range(blocks + 1)]
    reps = df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"))
    parts = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("h", edge[k]).bitwiseAND(F.lit((1 << (edge[k + 1] - edge[k])) - 1)).alias("v")) for k in range(blocks)]
    posts = reps.select("id", "h", F.explode(F.array(*parts)).alias("p")).select("id", "h", "p.k", "p.v")
    other = posts.select(F.col("id").alias("b"), F.col("h").alias("hb"), "k", "v")
    near = posts.withColumnRenamed("id", "a").join(other, ["k", "v"]).where("a < b").withColumn("distance", F.bit_count(F.col("h").bitwiseXOR(F.col("hb")))).where(F.col("distance") <= distance).select("a", "b", "distance").distinct()
    same = df.select(F.col(id_col).alias("b"), F.col(hash_col).alias("h")).join(reps.withColumnRenamed("id", "a"), "h").where("a < b").select("a", "b", F.lit(0).alias("distance"))
    return near.unionByName(same)
