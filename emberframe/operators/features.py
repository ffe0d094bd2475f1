"""Feature table, labels, sampling and splits. Random choices follow a hash of the key, so they repeat on any cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions.order import hash_order, rank_by_hash
from emberframe.functions.small import by_group
from emberframe.operators.audit import is_fire

# The feature contract: fixed names, in the order of the published table.
FEATURE_COLUMNS = (
    "bt7", "bt14_eff", "bt15", "albedo", "refl", "refl2", "tpw", "sza", "lza", "glint_angle", "emiss7", "emiss14", "eco_code",
    "diff_bt7_bt14", "bt7_bkg", "bt7_bkg_std", "bt14_bkg", "bt14_bkg_std", "albedo_bkg", "reflb", "std_reflb", "bt7_minus_bkg7",
    "bt14_minus_bkg14", "refl_minus_reflb", "n_passes", "rad_diff_sigma", "bt7_corr", "bt14_corr",
)
FINAL_COLUMNS = ("timestamp", "i", "j", "ref_fire", "ref_code", *FEATURE_COLUMNS)


def safe_columns(df: DataFrame) -> DataFrame:
    """Exactly the contract's columns; fails when one is missing."""
    absent = [c for c in FINAL_COLUMNS if c not in df.columns]
    if absent:
        raise ValueError(f"missing feature columns: {absent}")
    return df.select(*FINAL_COLUMNS)


def feature_table(audit: DataFrame) -> DataFrame:
    """Feature rows from the pixel audit."""
    c = F.col
    named = audit.withColumns({
        "timestamp": F.date_format(F.timestamp_seconds("scene_epoch"), "yyyyMMdd_HHmm"),
        "bt14_eff": c("bt14e"), "glint_angle": c("glint"),
    })
    return safe_columns(named)


def label(code: Column) -> Column:
    return is_fire(code).cast("int")


def scenes_with_fire(px: DataFrame) -> DataFrame:
    return px.groupBy("scene").agg(F.max(label(F.col("ref_code"))).alias("has_fire"))


def split_by_class(scenes: DataFrame, test_size: float, seed: int = 42, minimum: int = 1, label_col: str = "has_fire") -> DataFrame:
    """`side` per scene: of each class a rounded share goes to test, at least `minimum` on either side; one scene trains."""
    sizes = scenes.groupBy(label_col).agg(F.count("*").alias("_n"))
    ranked = rank_by_hash(scenes, [label_col], hash_order(F.col("scene"), seed=seed), "_k").drop("_n")
    ranked = by_group(ranked, sizes, [label_col], F.col("scene"))
    share = F.bround(F.col("_n") * F.lit(float(test_size)))
    n_test = F.when(F.col("_n") == 1, 0).otherwise(F.greatest(F.lit(minimum), F.least(F.col("_n") - minimum, share)))
    short = (F.col("_n") > 1) & (F.col("_n") < 2 * minimum)
    guarded = F.when(short, F.raise_error(F.lit("a class has too few scenes for both sides"))).otherwise(
        F.when(F.col("_k") <= n_test, "test").otherwise("train")
    )
    return ranked.withColumn("side", guarded).drop("_n", "_k")


def fire_aware_split(px: DataFrame, test_size: float, seed: int = 42, max_scenes: int | None = None, minimum: int = 1) -> DataFrame:
    """Split of scenes by fire, after an optional cap that keeps the minimum of each class and then fills in class order."""
    scenes = scenes_with_fire(px)
    if max_scenes is not None:
        if max_scenes < 2:
            raise ValueError("max_scenes must be at least 2")
        order = hash_order(F.col("scene"), seed=seed)
        ranked = rank_by_hash(scenes, ["has_fire"], order, "_k").drop("_n")
        first = F.when(F.col("_k") <= minimum, 0).otherwise(1)
        scenes = ranked.orderBy(first, "has_fire", order).limit(max_scenes).select("scene", "has_fire")
    return split_by_class(scenes, test_size, seed, minimum)


def content_id(scenes: DataFrame, groups: Sequence[str], name: str) -> DataFrame:
    """sha1 of the sorted scene names. One 13-character name per scene is collected, 0.7 MB for a year of 10-minute scenes."""
    joined = F.concat_ws("|", F.array_sort(F.collect_set(name)))
    return scenes.groupBy(*groups).agg(F.substring(F.sha1(joined), 1, 8).alias("content_id"), F.count_distinct(name).alias("n_scenes"))


def split_problems(split: DataFrame) -> DataFrame:
    """Scenes on both sides; must be empty."""
    side = lambda s: split.where(F.col("side") == s).select("split_id", "scene")
    return side("train").intersect(side("test"))


def load_split(split: DataFrame) -> DataFrame:
    """A split without repeated rows; fails where a split has a scene on both sides or a side without scenes."""
    rows = split.select("split_id", "scene", "side").distinct()
    both = split_problems(rows).limit(1).count()
    lone = rows.groupBy("split_id").agg(F.count_distinct("side").alias("n")).where("n < 2").limit(1).count()
    if both or lone:
        raise ValueError("a split has scenes on both sides" if both else "a split has an empty side")
    return rows


def balanced_sample(rows: DataFrame, groups: Sequence[str], per_group: int, key: Column, seed: int = 42) -> DataFrame:
    """At most n rows per group: n per group and hash bucket first, so a hot group is cut down before it meets one task."""
    marked = rows.withColumn("_h", hash_order(key, seed=seed)).withColumn("_b", F.substring("_h", 1, 2))
    near = W.partitionBy(*groups, "_b").orderBy("_h")
    cut = marked.withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= per_group)
    whole = W.partitionBy(*groups).orderBy("_h")
    return cut.withColumn("_k", F.row_number().over(whole)).where(F.col("_k") <= per_group).drop("_h", "_b", "_k")


def stratified_rows(rows: DataFrame, label_col: str, test_size: float, key: Column, seed: int = 42) -> DataFrame:
    """`side` per row: the same share of every class."""
    sizes = rows.groupBy(label_col).agg(F.bround(F.count("*") * F.lit(float(test_size))).alias("_t"))
    ranked = by_group(rank_by_hash(rows, [label_col], hash_order(key, seed=seed), "_k").drop("_n"), sizes, [label_col], key)
    return ranked.withColumn("side", F.when(F.col("_k") <= F.col("_t"), "test").otherwise("train")).drop("_k", "_t")


def empty_features(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features without a single value in the training rows."""
    counts = train.agg(*[F.count(n).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n")) for n in names])
    return counts.select(F.inline(rows)).where("n = 0").select("feature")


def dataset_manifest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, positives and an order-free content hash per scene: sha1 of the sum of the rows' md5 (60 bits of each).

    Values enter as text, null as the word `null`, so any engine that prints them alike finds the same hash.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    digits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy("timestamp").agg(
        F.count("*").alias("n_rows"), F.sum("ref_fire").alias("n_positive"), F.sha1(F.sum(digits).cast("string")).alias("content_hash")
    )


def uncovered(split: DataFrame, available: DataFrame) -> DataFrame:
    return split.join(available.select("scene").distinct(), "scene", "left_anti")
