"""Patches, sequences, vegetation indices and dependence between patch features and later fire."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions.nulls import ratio
from emberframe.functions.order import cumulative, hash_order, percentiles, rank_by_hash
from emberframe.functions.small import by_group
from emberframe.operators.neighbours import nearest_information
from emberframe.session import cut_lineage

PATCH_FEATURES = ("mean", "std", "high", "low", "p95", "p99", "excess")


def normalised_difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def to_patches(px: DataFrame, size: int = 64, stride: int = 32) -> DataFrame:
    """Each pixel once per overlapping patch that covers it, patches that stick out of the grid left out.

    With stride = size / 2 that is at most four copies.
    """
    extent = px.groupBy("region", "scene").agg((F.max("i") + 1).alias("_h"), (F.max("j") + 1).alias("_w"))

    def covering(name: str) -> Column:
        first = F.greatest(F.ceil((F.col(name) - size + 1) / stride), F.lit(0))
        return F.explode(F.sequence(first.cast("int"), F.floor(F.col(name) / stride).cast("int")))

    rows = by_group(px, extent, ["region", "scene"], F.struct("i", "j")).withColumn("py", covering("i")).withColumn("px", covering("j"))
    fits = (F.col("py") * stride + size <= F.col("_h")) & (F.col("px") * stride + size <= F.col("_w"))
    return rows.where(fits).drop("_h", "_w")


def patch_features(patches: DataFrame, value: str, by: Sequence[str] = ("region", "scene", "scene_epoch", "py", "px")) -> DataFrame:
    """Seven statistics per patch and its label; a patch holds size^2 pixels, so exact percentiles stay small."""
    hot = F.col("ref_code").isin(13, 14, 15)
    return patches.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.percentile(value, F.lit(0.95)).alias("p95"), F.percentile(value, F.lit(0.99)).alias("p99"),
        F.bool_or(hot).alias("any_fire"), F.count_if(hot).alias("n_fire"),
    ).withColumn("excess", F.col("high") - F.col("mean"))


def histories(features: DataFrame, length: int, lead: int, value: str = "mean") -> DataFrame:
    """The last `length` values of each patch and its label `lead` scenes ahead; incomplete windows are left out."""
    line = W.partitionBy("region", "py", "px").orderBy("scene_epoch")
    back = line.rowsBetween(-(length - 1), 0)
    rows = features.withColumns({"history": F.collect_list(value).over(back), "target": F.lead("any_fire", lead).over(line)})
    return rows.where((F.size("history") == length) & F.col("target").isNotNull())


def binned(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """`bin` by equal shares of the values: edges are exact quantiles, one row, so no global window is needed."""
    edges = percentiles(rows, [], value, {f"_e{n}": n / bins for n in range(1, bins)})
    at = F.lit(0)
    for n in range(1, bins):
        at = at + (F.col(value) > F.col(f"_e{n}")).cast("int")
    return rows.join(F.broadcast(edges)).withColumn("bin", at).drop(*[f"_e{n}" for n in range(1, bins)])


def mutual_information(rows: DataFrame, by: Sequence[str] = (), label: str = "target") -> DataFrame:
    """Sum of p ln(p / (px py)) over bins and labels, from counts."""
    groups = list(by) or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    cells = rows.groupBy(*groups, "bin", label).agg(F.count("*").alias("_n"))
    over = lambda *keys: W.partitionBy(*groups, *keys)
    # The cells number bins x labels per group.
    p = F.col("_n") / F.sum("_n").over(over())
    px = F.sum("_n").over(over("bin")) / F.sum("_n").over(over())
    py = F.sum("_n").over(over(label)) / F.sum("_n").over(over())
    terms = cells.select(*groups, (p * F.ln(p / (px * py))).alias("_t"))
    return terms.groupBy(*groups).agg(F.sum("_t").alias("mi")).drop("_all")


def information_by_lag(features: DataFrame, lags: Sequence[int], lead: int, bins: int = 4, value: str = "mean") -> DataFrame:
    """Mutual information between a patch feature `lag` scenes back and the label `lead` scenes ahead."""
    line = W.partitionBy("region", "py", "px").orderBy("scene_epoch")
    rows = binned(features.where(F.col(value).isNotNull()), value, bins)
    target = F.lead("any_fire", lead).over(line)
    wide = rows.withColumns({"target": target, **{f"_b{lag}": F.lag("bin", lag).over(line) for lag in lags}})
    pairs = F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(f"_b{lag}").alias("bin")) for lag in lags])
    long = wide.where("target is not null").select("target", F.inline(pairs)).where("bin is not null")
    return mutual_information(long, ["lag"])


def nearest_information_by_lag(features: DataFrame, lags: Sequence[int], leads: Sequence[int], values: Sequence[str] = PATCH_FEATURES, k: int = 3) -> DataFrame:
    """As `information_by_lag` for several features and leads at once, from nearest neighbours instead of bins."""
    line = W.partitionBy("region", "py", "px").orderBy("scene_epoch")
    targets = F.array(*[F.struct(F.lit(lead).alias("lead"), F.lead("any_fire", lead).over(line).alias("target")) for lead in leads])
    seen = [F.struct(F.lit(v).alias("feature"), F.lit(lag).alias("lag"), F.lag(v, lag).over(line).alias("value")) for v in values for lag in lags]
    wide = features.select(targets.alias("_t"), F.array(*seen).alias("_s"))
    long = wide.select(F.inline("_t"), "_s").where("target is not null").select("lead", "target", F.inline("_s"))
    return nearest_information(long, ["feature", "lead", "lag"], "value", "target", k)


def nearest_permutation_test(rows: DataFrame, key: Sequence[str], value: str, label: str, shuffles: int = 50, seed: int = 42, k: int = 3) -> DataFrame:
    """As `permutation_test`, from nearest neighbours: the observed information is shuffle 0, whose labels stay."""
    names = [F.col(c) for c in key]
    kept = rows.where(F.col(value).isNotNull() & F.col(label).isNotNull()).select(*key, value, label)
    many = kept.withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(shuffles))))
    left = rank_by_hash(many, ["shuffle"], hash_order(*names, seed=f"{seed}-x"), "_k").select("shuffle", "_k", value)
    right = rank_by_hash(many, ["shuffle"], hash_order(F.col("shuffle"), *names, seed=f"{seed}-y"), "_k").select("shuffle", "_k", F.col(label).alias("target"))
    paired = left.join(right, ["shuffle", "_k"]).drop("_k")
    both = paired.unionByName(kept.select(F.lit(0).alias("shuffle"), value, F.col(label).alias("target")))
    null, real = (lambda x: F.when(F.col("shuffle") > 0, x)), F.max(F.when(F.col("shuffle") == 0, F.col("mi"))).alias("observed")
    table = nearest_information(both, ["shuffle"], value, "target", k).agg(
        F.avg(null(F.col("mi"))).alias("null_mean"), F.stddev_pop(null(F.col("mi"))).alias("null_std"), F.count(null(F.col("mi"))).alias("n_shuffles"), real
    )
    return table.withColumn("z", ratio(F.col("observed") - F.col("null_mean"), F.col("null_std")))


def permutation_test(rows: DataFrame, key: Sequence[str], label: str, shuffles: int = 50, seed: int = 42) -> DataFrame:
    """Observed information against labels paired anew by two hash orders; ranks are found without a global sort in one task."""
    real = mutual_information(rows.withColumnRenamed(label, "target")).withColumnRenamed("mi", "observed")
    many = rows.select(*key, "bin", label).withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(shuffles))))
    names = [F.col(c) for c in key]
    left = rank_by_hash(many, ["shuffle"], hash_order(*names, seed=f"{seed}-x"), "_k").select("shuffle", "_k", "bin")
    right = rank_by_hash(many, ["shuffle"], hash_order(F.col("shuffle"), *names, seed=f"{seed}-y"), "_k").select(
        "shuffle", "_k", F.col(label).alias("target")
    )
    null = mutual_information(left.join(right, ["shuffle", "_k"]), ["shuffle"])
    table = null.agg(F.avg("mi").alias("null_mean"), F.stddev_pop("mi").alias("null_std"), F.count("*").alias("n_shuffles"))
    return table.join(F.broadcast(real)).withColumn("z", ratio(F.col("observed") - F.col("null_mean"), F.col("null_std")))


def chronological_split(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """The first `share` of the scenes trains; scenes are ranked in buckets, one row each."""
    scenes = cut_lineage(rows.select("scene").distinct().withColumn("_one", F.lit(1)))
    total = scenes.agg(F.count("*").alias("_t"))  # one row
    ranked = cumulative(scenes, [], "scene", ["_one"]).join(F.broadcast(total))
    side = F.when(F.col("cum__one") <= F.col("_t") * share, "train").otherwise("test")
    return rows.join(ranked.select("scene", side.alias("side")), "scene")
