"""Scans and sinks: band tables, sidecars, feature tables, CSV and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LUT_SCHEMA = "tpw_bin int, zenith_bin int, trans_4um double, trans_11um double, offset_4um double, offset_11um double"
DETECTION_SCHEMA = (
    "latitude double, longitude double, bright_ti4 double, scan double, track double, acq_date string, acq_time int, satellite string, "
    "instrument string, confidence string, version string, bright_ti5 double, frp double, daynight string"
)
DETECTION_COLUMNS = ("latitude", "longitude", "bright_ti4", "bright_ti5", "frp", "confidence", "acq_date", "acq_time", "daynight")
LEGACY_KAPPA0 = 3.141592653589793 / 1622.088
DEFAULT_KEYS = ("region", "scene", "i", "j")
SCENE_LINES = 256  # scan lines of a scene that go to one file


def join_bands(required: dict[str, DataFrame], optional: dict[str, DataFrame], keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """One row per pixel: required bands must have it, optional ones may be NULL."""
    tables = list(required.values())
    out = tables[0]
    for table in tables[1:]:
        out = out.join(table, list(keys))
    for table in optional.values():
        out = out.join(table, list(keys), "left")
    return out


def month_of(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyyMM").cast("int")


def write_pixels(px: DataFrame, path: str, rows_per_file: int = 4_000_000) -> None:
    """The pixel table laid out by region and month; files follow scan time, so a range of scenes reads few of them."""
    marked = px.withColumn("yyyymm", month_of(F.col("scene_epoch")))
    ordered = marked.repartitionByRange("region", "yyyymm", "scene_epoch", "i").sortWithinPartitions("region", "yyyymm", "scene_epoch", "i", "j")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).option(
        "compression", "zstd").partitionBy("region", "yyyymm").parquet(path)


def read_pixels(spark: SparkSession, path: str, start: int, end: int, regions: Sequence[str] = ()) -> DataFrame:
    """Pixels of the scenes in [start, end), of all regions or the named ones: only their months' folders are read."""
    first, last = (month_of(F.lit(epoch)) for epoch in (start, max(start, end - 1)))
    px = spark.read.parquet(path).where(F.col("yyyymm").between(first, last) & (F.col("scene_epoch") >= start) & (F.col("scene_epoch") < end))
    return (px.where(F.col("region").isin(*regions)) if regions else px).drop("yyyymm")


def absent_bands(required: dict[str, DataFrame], scenes: DataFrame) -> DataFrame:
    """Scenes (region, scene) asked for that lack a required band."""
    parts = None
    for name, table in required.items():
        part = scenes.join(table.select("region", "scene").distinct(), ["region", "scene"], "left_anti").withColumn("band", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """Calibration sidecars `<band>/<stamp>_planck.json` in folders; band and stamp come from the path."""
    raw = spark.read.schema("planck_fk1 double, planck_fk2 double, planck_bc1 double, planck_bc2 double, fpt_count int").option(
        "recursiveFileLookup", "true").json(path)
    where = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(where, r"band=(\d+)", 1).cast("int").alias("band"), F.regexp_extract(where, r"stamp=(\d{8}_\d{4})", 1).alias("stamp"),
        F.col("planck_fk1").alias("fk1"), F.col("planck_fk2").alias("fk2"), F.col("planck_bc1").alias("bc1"), F.col("planck_bc2").alias("bc2"),
        focal_plane(F.col("fpt_count")).alias("fpt"),
    )


def focal_plane(count: Column) -> Column:
    """91 K where the quality count says the focal plane was warm, else 0."""
    return F.when(F.coalesce(count, F.lit(0)) > 0, 91.0).otherwise(0.0)


def kappa_lookup(scenes: DataFrame, sidecar: DataFrame, legacy: DataFrame, default: float = LEGACY_KAPPA0) -> DataFrame:
    """Reflectance factor per scene: sidecar, else the legacy table, else the published constant."""
    joined = scenes.join(sidecar.select("scene", F.col("kappa0").alias("_a")), "scene", "left").join(
        legacy.select("scene", F.col("kappa0").alias("_b")), "scene", "left")
    source = F.when(F.col("_a").isNotNull(), "sidecar").when(F.col("_b").isNotNull(), "legacy").otherwise("default")
    return joined.withColumns({"kappa0": F.coalesce("_a", "_b", F.lit(default)), "source": source}).drop("_a", "_b")


def first_layout(*layouts: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Rows of the first layout that has the key; a running aggregate instead of a sort."""
    parts = None
    for rank, table in enumerate(layouts):
        marked = table.withColumn("_p", F.lit(rank))
        parts = marked if parts is None else parts.unionByName(marked)
    values = [c for c in parts.columns if c not in (*keys, "_p")]
    best = parts.groupBy(*keys).agg(F.min_by(F.struct(*values), "_p").alias("_v"))
    return best.select(*keys, "_v.*")


def lut_problems(lut: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bins that are missing or doubled in a 5 x 7 table; no row means the table is good."""
    wanted = F.explode(F.sequence(F.lit(0), F.lit(34)))
    base = lut.select(*by).distinct() if by else lut.sparkSession.range(1).select(F.lit(0).alias("_one"))
    frame = base.withColumn("_k", wanted).withColumns({
        "tpw_bin": (F.floor(F.col("_k") / 7) + 1).cast("int"), "zenith_bin": (F.col("_k") % 7 + 1).cast("int"),
    })
    seen = lut.groupBy(*by, "tpw_bin", "zenith_bin").agg(F.count("*").alias("n"))
    keys = [*by, "tpw_bin", "zenith_bin"]
    return frame.join(seen, keys, "full").where(F.coalesce("n", F.lit(0)) != 1).select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=DETECTION_SCHEMA, header=True).select(*DETECTION_COLUMNS)


def write_by_scene(rows: DataFrame, path: str, scene: str = "timestamp") -> None:
    """One partition per scene, compressed; only the scenes in `rows` are replaced. A scene has one file for each SCENE_LINES lines."""
    rows.withColumn("scene", F.col(scene)).repartition("scene", F.floor(F.col("i") / SCENE_LINES)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("scene").parquet(path)


def still_to_do(requested: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    return requested if force else requested.join(done.select("scene").distinct(), "scene", "left_anti")


def contract_violations(rows: DataFrame, scene: str = "scene", stamp: str = "timestamp", target: str = "ref_fire") -> DataFrame:
    """Scene folders whose rows carry another timestamp, or a target that is not 0 or 1."""
    table = rows.groupBy(F.col(scene).cast("string").alias("scene")).agg(
        F.count_distinct(stamp).alias("n_stamps"), F.count_if(F.col(stamp) != F.col(scene).cast("string")).alias("n_other"),
        F.count_if(~F.coalesce(F.col(target).try_cast("int").isin(0, 1), F.lit(False))).alias("n_bad_target"),
    )
    return table.where("n_stamps > 1 or n_other > 0 or n_bad_target > 0")


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema, codec: str = "zstd", skip_existing: bool = False) -> bool:
    """Whether the table was written; with `skip_existing` one that is there already stays."""
    if skip_existing and has_table(spark, target):
        return False
    spark.read.csv(source, schema=schema, header=True).write.mode("overwrite").option("compression", codec).parquet(target)
    return True


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table lies there; any store that Spark reads."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def read_features(spark: SparkSession, parquet: str, csv: str, schema) -> DataFrame:
    """The Parquet table where there is one, else the CSV files."""
    return spark.read.parquet(parquet) if has_table(spark, parquet) else spark.read.csv(csv, schema=schema, header=True)


def ragged_union(*tables: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Rows of different shapes in one table: preferred columns first, the rest by name."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    first = [c for c in preferred if c in out.columns]
    return out.select(*first, *sorted(c for c in out.columns if c not in first))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(run, document) of a folder of metric documents, one JSON object a line, of whatever shape; `run` is its field of that name."""
    whole = spark.read.option("singleVariantColumn", "document").json(path)
    return whole.select(F.try_variant_get("document", "$.run", "string").alias("run"), "document").where("run is not null")
