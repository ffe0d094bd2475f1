"""Mutual information of a number and a class by distances to nearest neighbours (Ross 2014), exact and without one task a group.

Of each row, the distance to its k-th nearest row of its own class is found, then how many rows of any class lie nearer than that. Both
are questions about sorted values: equal values are counted once, a group is cut into slots of like size, each slot borrows the few
values on either side of it, and the rows within a distance are a difference of two running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions.order import cumulative, fixed_edges
from emberframe.functions.small import by_group
from emberframe.session import cut_lineage

EULER = 0.5772156649015329
SLOTS = 64


def digamma(n: Column) -> Column:
    """Of a positive number: the asymptotic series at n + 6, taken back by the recurrence."""
    x = n + F.lit(6.0)
    series = F.ln(x) - 1 / (2 * x) - 1 / (12 * F.pow(x, 2)) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6)) + 1 / (240 * F.pow(x, 8))
    for k in range(6):
        series = series - 1 / (n + F.lit(float(k)))
    return series


def _slots(counted: DataFrame, keys: Sequence[str], slots: int) -> DataFrame:
    """`_slot` of every value: approximate quantiles of the distinct values of its group are the edges."""
    edges = fixed_edges(counted, keys, "_v", slots)
    slot = F.size(F.filter("_edges", lambda edge: edge < F.col("_v")))
    return by_group(counted, edges, keys, F.col("_v")).withColumn("_slot", slot).drop("_edges")


def _with_rims(placed: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Rows of each slot, and as `_rim` the k values before and after it, from whichever slots hold them.

    A slot offers its k lowest and k highest values, so what is gathered for a group is bounded by slots and k.
    """
    ends = lambda order: F.row_number().over(W.partitionBy(*keys, "_slot").orderBy(order)) <= k
    offered = placed.withColumns({"_low": ends(F.col("_v")), "_high": ends(F.col("_v").desc())}).where("_low or _high")
    value = F.struct("_v", "_n", "_slot")
    gathered = offered.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_ends"))
    own = lambda side: F.filter("_ends", side)
    below, above = own(lambda e: e["_slot"] < F.col("_slot")), own(lambda e: e["_slot"] > F.col("_slot"))
    near = F.concat(F.slice(below, F.greatest(F.size(below) - k + 1, F.lit(1)), k), F.slice(above, 1, k))
    slots = gathered.withColumn("_slot", F.explode(F.array_distinct(F.transform("_ends", lambda e: e["_slot"]))))
    rims = slots.select(*keys, "_slot", F.explode(near).alias("_e")).select(*keys, "_slot", "_e._v", "_e._n", F.lit(True).alias("_rim"))
    return placed.select(*keys, "_slot", "_v", "_n", F.lit(False).alias("_rim")).unionByName(rims)


def _radius(keys: Sequence[str], k: int) -> Column:
    """Distance to the k-th nearest other row of a class: at most k distinct values on each side can hold it."""
    line = W.partitionBy(*keys, "_slot").orderBy("_v")
    sides = [f("_v", n).over(line) for f in (F.lag, F.lead) for n in range(1, k + 1)]
    counts = [f("_n", n).over(line) for f in (F.lag, F.lead) for n in range(1, k + 1)]
    steps = [F.struct(F.lit(0).cast("long").alias("d"), (F.col("_n") - 1).alias("n"))]
    steps += [F.struct(F.abs(v - F.col("_v")).alias("d"), n.alias("n")) for v, n in zip(sides, counts)]
    sorted_steps = F.array_sort(F.filter(F.array(*steps), lambda s: s["n"].isNotNull()))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("r"))

    def walk(state: Column, step: Column) -> Column:
        seen = state["seen"] + step["n"]
        return F.struct(seen.alias("seen"), F.coalesce(state["r"], F.when(seen >= F.col("_k"), step["d"])).alias("r"))

    return F.aggregate(sorted_steps, start, walk)["r"]


def nearest_information(rows: DataFrame, by: Sequence[str], value: str, label: str = "target", k: int = 3, resolution: float = 1e-6, slots: int = SLOTS) -> DataFrame:
    """(by, n, mi): information in nats of `value` about `label` in each group, 0 at least.

    Values are taken in units of `resolution`, so distances are whole numbers. Rows where the value is null or not finite, or the label
    is null, take no part; nor do rows that are alone in their class. A class of k rows or fewer uses all its other rows. Nearer means strictly nearer;
    the row itself and rows of its very value always count. A group without any class of two rows has no result.
    """
    if k < 1 or resolution <= 0 or slots < 2:
        raise ValueError("k and resolution are positive, slots at least 2")
    names = list(by)
    key, number = F.struct(*(names or [F.lit(0).alias("all")])), F.col(value).cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")) & F.col(label).isNotNull()
    rows = rows.where(usable).select(key.alias("_g"), F.struct(F.col(label).alias("label")).alias("_c"), F.round(number / resolution).cast("long").alias("_v"))
    counted = cut_lineage(rows.groupBy("_g", "_c", "_v").agg(F.count(F.lit(1)).alias("_n")))
    sizes = counted.groupBy("_g", "_c").agg(F.sum("_n").alias("_size")).where("_size > 1").withColumn("_k", F.least(F.lit(k), F.col("_size") - 1))
    own = ["_g", "_c"]
    rimmed = _with_rims(_slots(by_group(counted, sizes.select(*own), own, F.col("_v")), own, slots), own, k)
    sized = by_group(rimmed, sizes, own, F.col("_v"))
    near = sized.withColumn("_r", _radius(own, k)).where("not _rim").select(*own, "_v", "_n", "_k", "_size", "_r")
    # rows nearer than r lie from v - r + 1 to v + r - 1; of r = 0 those at v
    reach = F.greatest(F.col("_r") - 1, F.lit(0))
    near = cut_lineage(near.withColumns({"_first": F.col("_v") - reach - 1, "_last": F.col("_v") + reach}))
    asked = near.select("_g", F.explode(F.array("_first", "_last")).alias("_at"), F.lit(0).cast("long").alias("_n"))
    places = asked.unionByName(near.select("_g", F.col("_v").alias("_at"), "_n")).groupBy("_g", "_at").agg(F.sum("_n").alias("_n"))
    totals = cumulative(cut_lineage(places), ["_g"], "_at", ["_n"])
    upto = lambda name, total: totals.select("_g", F.col("_at").alias(name), F.col("cum__n").alias(total))
    within = near.join(upto("_last", "_b"), ["_g", "_last"]).join(upto("_first", "_a"), ["_g", "_first"]).withColumn("_m", F.col("_b") - F.col("_a"))
    n = F.col("_n")
    mean = lambda count: F.sum(n * digamma(count)) / F.sum(n)
    found = within.groupBy("_g").agg(F.sum(n).alias("n"), (mean(F.col("_k")) - mean(F.col("_size")) - mean(F.col("_m"))).alias("_rest"))
    return found.select(*(F.col(f"_g.{name}").alias(name) for name in names), "n", F.greatest(digamma(F.col("n")) + F.col("_rest"), F.lit(0.0)).alias("mi"))
