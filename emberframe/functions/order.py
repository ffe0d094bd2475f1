"""Exact ranks and percentiles of groups too big for one task.

A plain window or `percentile` puts a whole group in one task. Here a group is cut into ordered buckets, bucket totals
(a small table) are accumulated, and each bucket is ranked on its own, so the work of a hot group is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions.small import by_group
from emberframe.session import cut_lineage

HASH_DIGITS = 3  # 4,096 buckets of equal size, as the digits of a hash are uniform


def hash_order(*cols: Column, seed: int | str = 0) -> Column:
    """A reproducible random order: md5 text of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def rank_by_hash(df: DataFrame, groups: Sequence[str], order: Column, name: str) -> DataFrame:
    """`row_number` over (groups order by hash) without one task per group."""
    keys = [*groups, "_bucket"]
    marked = df.withColumn("_hash", order).withColumn("_bucket", F.substring("_hash", 1, HASH_DIGITS))
    before = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    totals = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = totals.select(
        *keys,
        (F.sum("_n").over(before.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    local = F.row_number().over(W.partitionBy(*keys).orderBy("_hash"))
    return (
        marked.withColumn("_local", local)
        .join(offsets, keys)
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_hash", "_bucket", "_local", "_before")
    )


def rank_by_range(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """`row_number` over the whole table in `order`, which must tell all rows apart, without one task for it.

    Rows are dealt by ranges and written with the number of their range, so that a task that is run again finds the same ranges;
    the ranges' sizes, one row a partition, are accumulated, and each range is ranked on its own.
    """
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_local", local).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def fixed_edges(df: DataFrame, groups: Sequence[str], value: str, slots: int) -> DataFrame:
    """One row a group: `_edges`, approximate quantiles of `value` that cut the group into `slots`.

    A sketch depends on the order in which its parts arrive from other executors, so it comes out otherwise each time it is made. The
    edges are written once: whoever places rows by them, and whenever, finds the same slots.
    """
    cuts = [k / slots for k in range(1, slots)]
    return cut_lineage(df.groupBy(*groups).agg(F.percentile_approx(value, cuts, 2000).alias("_edges")))


def cumulative(df: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str], descending: bool = False,
               buckets: int = 128) -> DataFrame:
    """Running totals `cum_<name>` of `sums` in the order of `value`, which is distinct within its group.

    Bucket edges are approximate quantiles of the group's distinct values, so buckets are of like size whatever the
    distribution; the totals are exact. `df` is run at once for the edges, and again when the totals are read.
    """
    groups = list(groups) or ["_all"]
    df = df if "_all" not in groups else df.withColumn("_all", F.lit(0))
    sign = F.lit(-1.0 if descending else 1.0)
    marked = df.withColumn("_pos", F.col(value).cast("double") * sign)
    edges = fixed_edges(marked, groups, "_pos", buckets)
    slot = F.size(F.filter("_edges", lambda edge: edge < F.col("_pos")))
    placed = by_group(marked, edges, groups, F.col(value)).withColumn("_slot", slot).drop("_edges")
    keys = [*groups, "_slot"]
    totals = placed.groupBy(*keys).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = W.partitionBy(*groups).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_b_{s}") for s in sums])
    inside = W.partitionBy(*keys).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    out = placed.withColumns({f"_c_{s}": F.sum(s).over(inside) for s in sums}).join(offsets, keys)
    out = out.withColumns({f"cum_{s}": F.col(f"_c_{s}") + F.col(f"_b_{s}") for s in sums})
    drop = ["_pos", "_slot", "_all", *[f"_c_{s}" for s in sums], *[f"_b_{s}" for s in sums]]
    return out.drop(*drop)


def percentiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group; NULL values are left out.

    Equal values are counted first; each probability then needs the values at two ranks.
    """
    keys = list(groups)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    if not keys:
        keys, counted = ["_g"], counted.withColumn("_g", F.lit(0))
    # A join needs keys that are equal to themselves, so NULL groups travel as a struct. The counts are read five times, the rows once.
    counted = cut_lineage(counted.withColumn("_key", F.struct(*keys)))
    ordered = cumulative(counted, ["_key"], value, ["_n"])
    sizes = counted.groupBy("_key").agg(F.sum("_n").alias("_total"))
    placed = by_group(ordered, sizes, ["_key"], F.col(value))
    aggs = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        hit = lambda rank: (F.col("cum__n") - F.col("_n") <= rank) & (rank < F.col("cum__n"))
        v = F.col(value).cast("double")
        aggs += [
            F.max(F.when(hit(low), v)).alias(f"_{name}_lo"),
            F.max(F.when(hit(high), v)).alias(f"_{name}_hi"),
            F.max(at - low).alias(f"_{name}_f"),
        ]
    found = placed.groupBy("_key").agg(*aggs)
    lerp = lambda n: (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n)
    return found.select(*[F.col(f"_key.{g}").alias(g) for g in groups], *[lerp(n) for n in probs])


def medians(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact medians of several columns per group in one pass: the columns become rows, then columns again."""
    rows = F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_value")) for c in columns])
    long = df.select(*groups, F.inline(rows))
    found = percentiles(long, [*groups, "_name"], "_value", {"_median": 0.5})
    return found.groupBy(*groups).agg(*[F.max(F.when(F.col("_name") == c, F.col("_median"))).alias(c) for c in columns])


def middle_values(df: DataFrame, columns: Sequence[str], near: float = 0.002) -> dict[str, float]:
    """Of each column the value at rank ceil(n / 2), exact; missing values are left out, a column without values has no entry.

    A sketch gives two values on either side of that rank (its error is a twentieth of `near`). Rows below are then counted, and only the
    few between the two are counted by value and ranked. Where the rank lies outside all the same, the whole column is.
    """
    numbers = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    sketch = numbers.agg(*[F.percentile_approx(c, [0.5 - near, 0.5 + near], int(20 / near)).alias(c) for c in columns]).first()
    ends = {c: tuple(sketch[c]) for c in columns if sketch[c]}
    found: dict[str, float] = {}
    while ends:
        sizes = numbers.agg(*[F.count(c).alias(f"n{k}") for k, c in enumerate(ends)], *[F.count_if(F.col(c) < low).alias(f"b{k}") for k, (c, (low, _)) in enumerate(ends.items())]).first()
        ranks = {c: (sizes[f"n{k}"] + 1) // 2 - sizes[f"b{k}"] for k, c in enumerate(ends)}
        between = F.array(*[F.struct(F.lit(c).alias("_name"), F.when(F.col(c).between(low, high), F.col(c)).alias("_value")) for c, (low, high) in ends.items()])
        counted = cut_lineage(numbers.select(F.inline(between)).where("_value is not null").groupBy("_name", "_value").agg(F.count(F.lit(1)).alias("_n")))
        rank = F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col("_name"))
        ordered = cumulative(counted, ["_name"], "_value", ["_n"]).where((F.col("cum__n") - F.col("_n") < rank) & (rank <= F.col("cum__n")))
        found |= {r["_name"]: r["_value"] for r in ordered.collect()}  # a row a column at most
        ends = {c: (float("-inf"), float("inf")) for c in ends if c not in found}
    return found
