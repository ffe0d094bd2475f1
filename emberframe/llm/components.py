"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.session import cut_lineage


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of a link table (a, b); root is the smallest node reachable.

    Each round turns links to larger neighbours, then to smaller ones, towards the smallest neighbour; the number of links
    never grows and the rounds grow with the logarithm of a component's diameter. Each round is a table in the shared
    folder. Nodes with many links are never gathered: only their minimum is aggregated, and joins split hot nodes at run time.
    Links of a node with itself and null ends are left out; no links give no rows.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    pairs = cut_lineage(pairs)
    seen = None
    for _ in range(most_rounds):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == seen or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = state
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # larger neighbours move to the smallest one around u
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.where("m < u").select("u", F.col("m").alias("v"))
        ).distinct()
        # u and its smaller neighbours move to the smallest of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            below.select("u", F.col("m").alias("v"))
        ).distinct()
        pairs = cut_lineage(small)
    raise RuntimeError("components did not settle")
