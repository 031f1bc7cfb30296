"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.store import forget, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of edges; component: its smallest reachable node.

    Nodes are known by their 64-bit hash, so their order is random.  Each round points
    every node at the smallest hash among itself and its neighbours, follows the pointers
    twice and contracts the edges to the nodes pointed at, until no edge is left: edges
    shrink by a constant share a round whatever the graph, and the rounds compose to the
    answer.  Aggregations combine on the map side, so a node with very many edges is no hot
    task there; the joins leave such a node to AQE's skew join.  Null ends and loops are
    ignored; no edges give no rows.  Each round is written to the shared folder, so lost
    executors cost one round.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    named = stored(pairs.select("a", "b", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb")))
    left, rounds = named.select(F.greatest("ha", "hb").alias("a"), F.least("ha", "hb").alias("b")), []
    while True:
        both = left.select("a", F.col("b").alias("to")).union(left.select(F.col("b").alias("a"), F.col("b").alias("to")))
        up = both.groupBy("a").agg(F.min("to").alias("to")).select("a", F.least("a", "to").alias("to"))
        for _ in range(2):
            up = up.join(up.select(F.col("a").alias("to"), F.col("to").alias("top")), "to").select("a", F.col("top").alias("to"))
        rounds.append(stored(up))
        la, lb = (rounds[-1].select(F.col("a").alias(x), F.col("to").alias(f"l{x}")) for x in "ab")
        ends = left.join(la, "a").join(lb, "b").where("la <> lb")
        after = stored(ends.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct())
        if len(rounds) > 1:
            forget(left)
        if after.isEmpty():
            break
        left = after
    label = rounds[0].select(F.col("a").alias("h"), F.col("to").alias("root"))
    for later in rounds[1:]:
        label = label.join(later.select(F.col("a").alias("root"), F.col("to").alias("next")), "root", "left").select("h", F.coalesce("next", "root").alias("root"))
    nodes = named.select(F.col("a").alias("node"), F.col("ha").alias("h")).union(named.select("b", "hb")).distinct()
    nodes = stored(nodes.join(label, "h").select("node", "root"))
    return nodes.join(nodes.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
