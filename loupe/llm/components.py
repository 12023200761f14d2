"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import discarded, join_counted, staged


#: Pairs of one node that a task may join; in smaller tables no node has more.
PAIRS = 1 << 20


def _stars(pairs: DataFrame, total: int) -> DataFrame:
    """Each directed pair (u, v) with the least node next to u, u itself included; nodes with very many pairs are looked up without a shuffle."""
    if total <= PAIRS:
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_counted(pairs, least, "u", total)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) names; root is the least node of its component.

    The table of edges is rewritten until it stays as it is: every round links
    nodes to smaller ones of their neighbourhood, which takes a number of rounds
    in the order of the logarithm of the nodes. A node's neighbours are never
    gathered, only their minimum. An empty table gives no rows.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    told = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == told or not state[0]:
            break
        told = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _stars(large, state[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, now = now, staged(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discarded(before)
    found = staged(_roots(now), "components")
    discarded(now)
    return found


def _roots(now: DataFrame) -> DataFrame:
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
