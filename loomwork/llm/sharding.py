"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together.  Sorted by size, each goes to the least loaded
shard, which a heap yields.  Groups of at least 1/HEAVY of all bytes (so at most
HEAVY of them) are scheduled one by one.  The smaller ones are first gathered by the
hash of their text into BUNDLES coarse bundles and BUNDLES fine ones, that hold a
tenth of them; the fine ones come last and level the loads.  What the driver
schedules is bounded by HEAVY + 2 * BUNDLES entries at any input size.

Defined results: a null text has no bytes (size 1) and is grouped with empty texts;
rows that repeat, ids included, are placed together; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.store import stored

HEAVY = 8192
BUNDLES = 2048
ROWS_IN_A_RUN = 20_000


def longest_first(sizes: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """The shard of each key: largest size first, ties by key, to the least loaded shard."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        placed[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (0, 1, ... within the shard), grown_shard (null)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("group"))
    rows = stored(rows)
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    spread = F.pmod(F.xxhash64("group"), F.lit(10 * BUNDLES))
    bundle = F.concat(F.lit("b"), F.when(spread < BUNDLES, spread + BUNDLES).otherwise(F.pmod(F.xxhash64("group", F.lit(1)), F.lit(BUNDLES))).cast("string"))
    groups = groups.withColumn("item", F.when(F.col("bytes") * HEAVY >= total, F.col("group")).otherwise(bundle))
    items = groups.groupBy("item").agg(F.sum("bytes").alias("bytes"))
    placed = longest_first([(int(r["bytes"]), r["item"]) for r in items.toLocalIterator()], shards)
    spark = docs.sparkSession
    law = spark.createDataFrame(list(placed.items()) or [("", 0)], "item string, shard int")
    # at most HEAVY + 2 * BUNDLES rows
    group_shard = groups.join(F.broadcast(law), "item").select("group", "shard")
    out = rows.join(group_shard, "group").drop("group")
    return numbered(out, n).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def numbered(rows: DataFrame, n: int) -> DataFrame:
    """rows with slot: gapless from 0 within each shard.

    Rows are ranked within runs of about ROWS_IN_A_RUN by a hash of the id, and each
    run starts where the run before it ended; no task sorts a whole shard.
    """
    runs = max(1, n // (16 * ROWS_IN_A_RUN))
    rows = stored(rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).cast("int")))
    counts = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("begin", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    rank = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("rank", rank).join(starts, ["shard", "run"]).withColumn("slot", (F.col("begin") + F.col("rank")).cast("long"))
