"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source token shares p are raised to an exponent e and normalised.  e is bisected in
[0, 1] for the mix closest to the given one that reaches a target entropy, and then
lowered no further than the repetition limit allows: no source may be read more than
`repeats` times.  The weights are realised as budgeted block permutations: a source's
documents are hashed into blocks, the blocks and the documents within them are
permuted by a hash, and a source is read in whole passes of that order, then as much
of one more pass as its budget covers.

Defined results: a null source is the source '' ; a null or empty text counts one
token (so it can be placed); an empty table gives no rows; rows that repeat are
placed one by one, ties in the order of their hash, id and size; other columns are kept
whatever their names (a struct carries them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.store import stored


@dataclass(frozen=True)
class MixRules:
    entropy: float = 0.98  # of the largest possible entropy, log(sources)
    repeats: float = 2.0
    budget: float = 1.0  # tokens of the mix as a share of the tokens read
    block_rows: int = 2000
    most_blocks: int = 65_536  # of one source
    steps: int = 50
    seed: str = "mix"


def token_count(text: Column) -> Column:
    """Words of a text, at least 1; the separators are space and 0x09-0x0D."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.greatest(F.size(words), F.lit(1)).cast("long")


def temperature_weights(sizes: DataFrame, rules: MixRules) -> DataFrame:
    """(source, tokens, exponent, weight, quota) from (source, tokens): one array, bisected by a fold."""
    one = sizes.agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("s")).withColumn("total", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    share = lambda x: x["tokens"].cast("double") / F.col("total")
    norm = lambda e: F.aggregate("s", F.lit(0.0), lambda a, x: a + F.pow(share(x), e))

    def entropy(e: Column) -> Column:
        # log z - e * sum(p^e log p) / z
        z = norm(e)
        return F.log(z) - e * F.aggregate("s", F.lit(0.0), lambda a, x: a + F.pow(share(x), e) * F.log(share(x))) / z

    def repeats(e: Column) -> Column:
        z = norm(e)
        return F.aggregate("s", F.lit(0.0), lambda a, x: F.greatest(a, F.pow(share(x), e) / z * rules.budget / share(x)))

    def bisect(above: object) -> Column:
        """The exponent where `above` turns from true (at 0) to false (at 1)."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(a: Column, _: Column) -> Column:
            mid = (a["lo"] + a["hi"]) / 2
            return F.when(above(mid), F.struct(mid.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rules.steps)), start, step, lambda a: (a["lo"] + a["hi"]) / 2)

    target = rules.entropy * F.log(F.size("s").cast("double"))
    one = one.withColumn("by_entropy", F.when(entropy(F.lit(1.0)) >= target, F.lit(1.0)).otherwise(bisect(lambda e: entropy(e) >= target)))
    one = one.withColumn("by_repeats", F.when(repeats(F.lit(0.0)) <= rules.repeats, F.lit(0.0)).otherwise(bisect(lambda e: repeats(e) > rules.repeats)))
    one = one.withColumn("exponent", F.greatest("by_entropy", "by_repeats")).withColumn("z", norm(F.col("exponent")))
    each = one.where("total > 0").select("exponent", "z", "total", F.explode("s").alias("x"))
    weight = F.pow(F.col("x.tokens").cast("double") / F.col("total"), F.col("exponent")) / F.col("z")
    each = each.select(F.col("x.source").alias("source"), F.col("x.tokens").alias("tokens"), "exponent", weight.alias("weight"), (weight * F.col("total") * rules.budget).alias("share"))
    return each.withColumn("quota", F.floor("share").cast("long")).drop("share")


def _placed(rows: DataFrame, sizes: DataFrame, rules: MixRules) -> DataFrame:
    """rows with mix_weight, mix_start and mix_copies. rows and sizes: (mix_source, mix_tokens, mix_turn, mix_id) of all rows; rows may carry more."""
    stats = stored(sizes.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    weights = temperature_weights(stats.select(F.col("mix_source").alias("source"), "tokens"), rules)
    # one row for each source; beyond the broadcast threshold Spark joins by a shuffle on its own
    plan = stored(weights.join(stats.select(F.col("mix_source").alias("source"), "n"), "source").select(F.col("source").alias("mix_source"), F.col("weight").alias("mix_weight"), F.col("quota").alias("mix_quota"), F.col("tokens").alias("mix_all"), F.least(F.lit(rules.most_blocks), F.ceil(F.col("n") / rules.block_rows)).cast("long").alias("mix_blocks")))
    block = F.pmod(F.xxhash64("mix_turn"), F.col("mix_blocks")).alias("mix_block")
    sums = sizes.join(plan.select("mix_source", "mix_blocks"), "mix_source").groupBy("mix_source", block).agg(F.sum("mix_tokens").alias("k"))
    before = Window.partitionBy("mix_source").orderBy(F.xxhash64(F.lit(rules.seed), "mix_source", "mix_block"), "mix_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("mix_source", "mix_block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("mix_begin"))
    inside = Window.partitionBy("mix_source", "mix_block").orderBy("mix_turn", "mix_id", "mix_tokens").rowsBetween(Window.unboundedPreceding, -1)
    order = rows.join(plan, "mix_source").withColumn("mix_block", block)
    placed = order.withColumn("mix_inside", F.coalesce(F.sum("mix_tokens").over(inside), F.lit(0))).join(begins, ["mix_source", "mix_block"])
    start = (F.col("mix_begin") + F.col("mix_inside")).cast("long")
    # whole passes, and one more if the row starts before what is left of the quota
    passes = F.floor(F.col("mix_quota") / F.col("mix_all"))
    left = F.col("mix_quota") - passes * F.col("mix_all")
    copies = (passes + F.when(start < left, 1).otherwise(0)).cast("int")
    return placed.withColumn("mix_start", start).withColumn("mix_copies", copies)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, rules: MixRules, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"), token_count(F.col(text_col)).alias("mix_tokens"), F.xxhash64(F.lit(rules.seed), F.col(id_col), F.col(text_col)).alias("mix_turn"), F.col(id_col).alias("mix_id"), *more)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rules: MixRules | None = None) -> DataFrame:
    """For each row of docs its id, mix_source, mix_weight, mix_tokens, mix_start (tokens before the row in its
    source's order) and mix_copies (how often the mix holds the row; 0: not at all).  The text is read once."""
    rules = rules or MixRules()
    rows = stored(_sized(docs, id_col, text_col, source_col, rules))
    return _placed(rows, rows, rules).select(F.col("mix_id").alias(id_col), "mix_source", "mix_weight", "mix_tokens", "mix_start", "mix_copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rules: MixRules | None = None) -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources says, with the columns of docs."""
    rules = rules or MixRules()
    sizes = stored(_sized(docs, id_col, text_col, source_col, rules))
    rows = _sized(docs, id_col, text_col, source_col, rules, F.struct(*docs.columns).alias("mix_row"))
    placed = _placed(rows, sizes, rules).where("mix_copies > 0")
    return placed.select("mix_row", F.explode(F.sequence(F.lit(1), "mix_copies"))).select("mix_row.*")
