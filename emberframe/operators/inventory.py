"""What is there, what is missing, and the manifest of downloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions.nulls import ratio
from emberframe.session import cut_lineage

GOOD = ("downloaded", "exists")
PATH = r"^(?:.*/)?([^/]+?)(?:-(\d{6}))?/(\d{8}_\d{4})(_planck|_kappa0|_dqf)?\.(npy|json)$"


def parse_listing(paths: DataFrame, path: str = "path") -> DataFrame:
    """product (month shard undone), timestamp and kind of each path; other paths are left out."""
    part = lambda n: F.regexp_extract(path, PATH, n)
    kind = F.when(part(4) == "", F.lit("data")).otherwise(F.substring(part(4), 2, 10))
    rows = paths.select("*", part(1).alias("product"), part(3).alias("stamp"), kind.alias("kind"))
    return rows.where(F.col("stamp") != "")


def shard_path(product: Column, stamp: Column) -> Column:
    """Month-sharded relative path of a file."""
    return F.concat(product, F.lit("-"), F.substring(stamp, 1, 6), F.lit("/"), stamp, F.lit(".npy"))


def missing(expected: DataFrame, found: DataFrame, keys: Sequence[str] = ("product", "slot")) -> DataFrame:
    return expected.join(found.select(*keys).distinct(), list(keys), "left_anti")


def completeness(expected: DataFrame, found: DataFrame) -> DataFrame:
    have = found.select("product", "slot").distinct().withColumn("_have", F.lit(1))
    table = expected.join(have, ["product", "slot"], "left").groupBy("product").agg(
        F.count("*").alias("n_expected"), F.count("_have").alias("n_found")
    )
    return table.withColumn("percent", ratio(F.col("n_found") * 100, F.col("n_expected")))


def _stretch(at: Column, width: int) -> Column:
    """Where the stretch of a slot starts."""
    return at - F.pmod(at, F.lit(width).cast("long"))


def _join_runs(runs: DataFrame, keys: Sequence[str], step: int, width: int) -> DataFrame:
    """Runs (product, first_slot, last_slot, n) of one key that follow each other by one step, over a border of stretches of `width`, become one."""
    line = W.partitionBy(*keys).orderBy("first_slot")
    before = F.lag("last_slot").over(line)
    # Inside a stretch all was joined that follows; slots off the others' grid that keep two runs apart there may be done already.
    follows = (F.col("first_slot") - before == step) & (_stretch(before, width) != _stretch(F.col("first_slot"), width))
    marked = runs.withColumn("_new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(line))
    return marked.groupBy(*keys, "_run").agg(F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot"), F.sum("n").alias("n")).drop("_run")


def contiguous_ranges(slots: DataFrame, step: int, span: int = 4096, levels: int = 2) -> DataFrame:
    """Runs of neighbouring slots per product (gaps and islands); slots are distinct, null ones are left out.

    Runs are found per product and stretch of `span` steps, so a task never holds a product. Only runs that touch the border of
    their stretch go on, at most two of them a stretch, to stretches `span` times as long; after the last level what still touches
    a border, two rows in `span` to the power of `levels` steps, is joined per product.
    """
    runs = slots.where("slot is not null").select("product", F.col("slot").cast("long").alias("first_slot"), F.col("slot").cast("long").alias("last_slot"), F.lit(1).cast("long").alias("n"))
    done, width = None, 1  # every slot a stretch of its own
    for level in range(1, levels + 1):
        earlier, width = width, step * span**level
        own = _stretch(F.col("first_slot"), width)
        joined = _join_runs(runs.withColumn("_at", own), ["product", "_at"], step, earlier).drop("_at")
        joined = cut_lineage(joined) if level == 1 else joined  # both parts are read again; what follows is small
        border = (_stretch(F.col("first_slot") - step, width) != own) | (_stretch(F.col("last_slot") + step, width) != own)
        inner, runs = joined.where(~border), joined.where(border)
        done = inner if done is None else done.unionByName(inner)
    return done.unionByName(_join_runs(runs, ["product"], step, width))


def same_missing_set(gaps: DataFrame) -> DataFrame:
    """Products that miss exactly the same slots. Sets are compared by count and two independent hash sums, so no set is
    ever collected."""
    prints = gaps.groupBy("product").agg(
        F.count("*").alias("n_missing"), F.sum(F.xxhash64("slot").cast("decimal(38,0)")).alias("_a"),
        F.sum(F.hash("slot", F.lit(17)).cast("decimal(38,0)")).alias("_b"),
    )
    grouped = prints.groupBy("n_missing", "_a", "_b").agg(F.array_sort(F.collect_list("product")).alias("_p"))
    return grouped.select("n_missing", F.concat_ws(",", "_p").alias("products"))


def upsert_manifest(results: DataFrame, order: str) -> DataFrame:
    """Latest result per scene and product; an unknown shape keeps the last known one. Aggregates before the shuffle."""
    last = F.max_by(F.struct("status", "path", "error"), order)
    shape = F.max_by("shape", F.when(F.col("shape").isNotNull(), F.col(order)))
    table = results.groupBy("scene", "product").agg(last.alias("_l"), shape.alias("shape"))
    return table.select("scene", "product", "_l.status", "_l.path", "_l.error", "shape")


def scene_status(manifest: DataFrame, required: Sequence[str]) -> DataFrame:
    """A scene is complete when every required product is downloaded or was there."""
    ok = manifest.groupBy("scene").agg(*[
        F.count_if((F.col("product") == p) & F.col("status").isin(*GOOD)).alias(f"_{n}") for n, p in enumerate(required)
    ])
    complete = F.lit(True)
    for n in range(len(required)):
        complete = complete & (F.col(f"_{n}") > 0)
    return ok.select("scene", F.when(complete, "complete").otherwise("incomplete").alias("status"))


def flat_metadata(manifest: DataFrame, products: Sequence[str]) -> DataFrame:
    """One row per scene, status and path per product, with defaults for what is absent."""
    wide = manifest.groupBy("scene").pivot("product", list(products)).agg(
        F.first("status").alias("status"), F.first("path").alias("path")
    )
    named = []
    for p in products:
        named += [F.coalesce(F.col(f"{p}_status"), F.lit("missing")).alias(f"{p}_status"), F.coalesce(F.col(f"{p}_path"), F.lit("N/A")).alias(f"{p}_path")]
    return wide.select("scene", *named)


def status_report(status: DataFrame) -> DataFrame:
    return status.agg(F.count("*").alias("n_scenes"), F.count_if(F.col("status") == "complete").alias("n_complete"))


def retry_list(scenes: DataFrame, required: Sequence[str], manifest: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Required scene-product pairs that are missing or failed; `in_range` tells those inside an optional time range."""
    wanted = scenes.select("scene").distinct().withColumn("product", F.explode(F.array(*[F.lit(p) for p in required])))
    state = wanted.join(manifest.select("scene", "product", "status"), ["scene", "product"], "left")
    again = state.where(F.col("status").isNull() | F.col("status").isin("error", "empty"))
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("scene") >= start)
    if end is not None:
        inside = inside & (F.col("scene") <= end)
    return again.select("scene", "product", F.when(F.col("status").isNull(), "missing").otherwise("failed").alias("reason"), inside.alias("in_range"))


def fire_statistics(px: DataFrame, fire: Column, code: str = "ref_code") -> DataFrame:
    """Per scene: fire pixels and whether the mask is unusable (all zero)."""
    return px.groupBy("scene").agg(F.count_if(fire).alias("n_fire"), F.bool_and(F.col(code) == 0).alias("invalid"))


def fire_summary(stats: DataFrame) -> DataFrame:
    valid = ~F.col("invalid")
    table = stats.agg(
        F.count("*").alias("n_scenes"), F.count_if("invalid").alias("n_invalid"),
        F.count_if(valid & (F.col("n_fire") > 0)).alias("with_fire"), F.count_if(valid & (F.col("n_fire") == 0)).alias("without_fire"),
    )
    return table.withColumn("percent_fire", ratio(F.col("with_fire") * 100, F.col("with_fire") + F.col("without_fire")))


def months_of(slots: DataFrame, epoch: str = "slot") -> DataFrame:
    return slots.select(F.date_format(F.timestamp_seconds(epoch), "yyyyMM").alias("month")).distinct()
