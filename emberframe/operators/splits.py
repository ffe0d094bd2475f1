"""Decision trees grown by exact split search: every boundary between two values of every feature is judged, none are binned.

A level is one job. Rows are counted by node, feature, value and class, running totals in value order give both sides of every boundary,
and the best boundary of each node is kept. What a row's node is follows from its own values, so rows are never rewritten; the driver
holds the nodes alone, at most 2^depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.order import cumulative
from emberframe.session import cut_lineage

NODE = "node int, depth int, feature string, threshold double, n long, weight double, share double, gain double"
DIGITS = 10  # gains that agree to so many digits are ties


def number(name: str) -> Column:
    """A feature's value; missing ones are below all others."""
    value = F.col(name).cast("double")
    return F.when(value.isNull() | F.isnan(value), float("-inf")).otherwise(value)


def node_of(splits: dict[int, tuple[str, float]], node: int = 1) -> Column:
    """The number of the leaf a row comes to: the children of node k are 2k, for values up to the threshold, and 2k + 1."""
    if node not in splits:
        return F.lit(node)
    feature, threshold = splits[node]
    return F.when(number(feature) <= F.lit(threshold), node_of(splits, 2 * node)).otherwise(node_of(splits, 2 * node + 1))


def _gini(zero: Column, one: Column) -> Column:
    total = zero + one
    return 1 - (zero * zero + one * one) / (total * total)


def _best(counted: DataFrame, totals: DataFrame, features: Sequence[str], weights: tuple[float, float], leaf: int) -> DataFrame:
    """(node, gain, feature, low) of each node's best boundary: low is the largest value on its left."""
    running = cumulative(counted, ["node", "place"], "value", ["zeros", "ones"]).join(F.broadcast(totals), "node")  # one row a node
    left, right = (F.col("cum_zeros"), F.col("cum_ones")), (F.col("all_zeros") - F.col("cum_zeros"), F.col("all_ones") - F.col("cum_ones"))
    weigh = lambda side: (side[0] * weights[0], side[1] * weights[1])
    (a, b), (c, d), (e, f) = weigh(left), weigh(right), weigh((F.col("all_zeros"), F.col("all_ones")))
    gain = F.round(_gini(e, f) - ((a + b) * _gini(a, b) + (c + d) * _gini(c, d)) / (e + f), DIGITS)
    allowed = running.where((left[0] + left[1] >= leaf) & (right[0] + right[1] >= leaf)).withColumn("gain", gain).where("gain > 0")
    first = F.max(F.struct("gain", (-F.col("place")).alias("place"), (-F.col("value")).alias("value"))).alias("b")
    named = F.array(*map(F.lit, features))[-F.col("b.place")]
    return allowed.groupBy("node").agg(first).select("node", F.col("b.gain").alias("gain"), (-F.col("b.place")).alias("place"), named.alias("feature"), (-F.col("b.value")).alias("low"))


def grow(rows: DataFrame, features: Sequence[str], label: str, depth: int = 6, leaf: int = 5, balanced: bool = True) -> DataFrame:
    """The tree's nodes (node, depth, feature, threshold, n, weight, share, gain) for a label of 0 and 1.

    share is the weighted share of ones, gain the fall of the Gini impurity; a leaf has no feature. Of equal gains the earlier feature and
    the lower boundary win, thresholds lie halfway between two values, and each side keeps `leaf` rows at least. With `balanced`, both classes
    weigh the same. Rows without a label are left out; missing values go left. No rows give no nodes.
    """
    if depth < 0 or depth > 12 or leaf < 1 or not features:
        raise ValueError("depth is 0 to 12, a leaf has a row at least, and there is a feature at least")
    spark = rows.sparkSession
    rows = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("_y"), *(number(f).alias(f) for f in features))
    sizes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # two rows
    if set(sizes) - {0, 1}:
        raise ValueError("the label is 0 or 1")
    total = sum(sizes.values())
    weights = tuple(total / (2.0 * sizes[y]) if balanced and sizes.get(y) else 1.0 for y in (0, 1))
    values = F.array(*(F.struct(F.lit(k).alias("place"), F.col(f).alias("value")) for k, f in enumerate(features)))
    zeros, ones = F.sum(1 - F.col("_y")), F.sum("_y")
    splits: dict[int, tuple[str, float]] = {}
    nodes, open_nodes = [], [1] if total else []
    for level in range(depth + 1):
        if not open_nodes:
            break
        here = rows.withColumn("node", node_of(splits)).where(F.col("node").isin(open_nodes))
        counted = cut_lineage(here.select("node", "_y", F.inline(values)).groupBy("node", "place", "value").agg(zeros.alias("zeros"), ones.alias("ones")))
        totals = counted.where("place = 0").groupBy("node").agg(F.sum("zeros").alias("all_zeros"), F.sum("ones").alias("all_ones"))
        found = {}
        if level < depth:
            best = cut_lineage(_best(counted, totals, features, weights, leaf))
            above = counted.join(F.broadcast(best), ["node", "place"]).where("value > low").groupBy("node").agg(F.min("value").alias("high"))  # one row a node
            found = {r["node"]: r for r in best.join(above, "node").collect()}
        for r in sorted(totals.collect()):
            zero, one = r["all_zeros"] * weights[0], r["all_ones"] * weights[1]
            split = found.get(r["node"])
            if split:
                splits[r["node"]] = (split["feature"], (split["low"] + split["high"]) / 2)
            name, threshold = splits.get(r["node"], (None, None))
            nodes.append((r["node"], level, name, threshold, r["all_zeros"] + r["all_ones"], zero + one, one / (zero + one), split["gain"] if split else None))
        open_nodes = [child for node in found for child in (2 * node, 2 * node + 1)]
    return spark.createDataFrame(nodes, NODE)


def merged(nodes: DataFrame) -> DataFrame:
    """The tree without splits whose leaves all tell the same class, as MLlib's trees come: such a split becomes a leaf."""
    held = {r["node"]: r.asDict() for r in nodes.collect()}  # at most 2^(depth + 1)
    for node in sorted(held, reverse=True):
        pair = [held.get(2 * node), held.get(2 * node + 1)]
        if all(child and child["feature"] is None for child in pair) and len({child["share"] > 0.5 for child in pair}) == 1:
            held[node].update(feature=None, threshold=None, gain=None)
            del held[2 * node], held[2 * node + 1]
    return nodes.sparkSession.createDataFrame([tuple(held[n].values()) for n in sorted(held)], NODE)


def importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance) of the features a tree uses: their gains by weight, summing to 1."""
    by_feature = nodes.where("feature is not null").groupBy("feature").agg(F.sum(F.col("weight") * F.col("gain")).alias("_g"))
    return by_feature.join(F.broadcast(by_feature.agg(F.sum("_g").alias("_all")))).select("feature", (F.col("_g") / F.col("_all")).alias("importance"))


def score(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with `leaf`, the number of the leaf they come to, and `score`, its weighted share of ones."""
    held = nodes.collect()  # at most 2^(depth + 1)
    splits = {r["node"]: (r["feature"], r["threshold"]) for r in held if r["feature"] is not None}
    shares = F.create_map(*(F.lit(x) for r in held for x in (r["node"], r["share"]))) if held else F.create_map().cast("map<int,double>")
    return rows.withColumn("leaf", node_of(splits)).withColumn("score", F.element_at(shares, F.col("leaf")))
