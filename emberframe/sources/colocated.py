"""Band tables that lie together: bucketed and sorted by scan line, so bands join and masks are written back without a shuffle.

A store is a folder with one external table a band, all with one number of buckets by (region, scene, i). A scan line is bounded by the
sensor, so buckets are as even as scenes are many; choose their number such that a bucket of all bands fits a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.sources.tables import DEFAULT_KEYS, join_bands

LINE = ("region", "scene", "i")
BUCKETS = 64


def write_band(rows: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Rows (region, scene, i, j, ...) as the external table `table` at `path`; one file a bucket, as rows are dealt like buckets first.

    An existing table of that name is an error. Null keys are kept and belong to no pixel of another band.
    """
    rows.repartition(buckets, *LINE).write.bucketBy(buckets, *LINE).sortBy(*LINE, "j").format("parquet").option("path", path).option(
        "compression", "zstd").saveAsTable(table)


def same_layout(spark: SparkSession, tables: Sequence[str]) -> int:
    """The number of buckets that all the tables have; an error where they differ, as a join would then shuffle."""
    found = set()
    for table in tables:
        about = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe extended {table}").collect()}  # a row a column
        found.add((about.get("Num Buckets"), about.get("Bucket Columns")))
    if len(found) != 1 or None in next(iter(found)):
        raise ValueError(f"band tables differ in layout: {sorted(map(str, found))}")
    return int(found.pop()[0])


@contextmanager
def joined_by_line(spark: SparkSession) -> Iterator[None]:
    """While a query is planned here, buckets by scan line serve joins by pixel, and no side is taken for a broadcast."""
    wanted = {
        "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.enabled": "true",
        "spark.sql.sources.bucketing.autoBucketedScan.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def read_bands(spark: SparkSession, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """One row a pixel from tables by band name: required bands must have it, optional ones may be NULL. Plan it in `joined_by_line`."""
    optional = optional or {}
    same_layout(spark, [*required.values(), *optional.values()])
    return join_bands({n: spark.table(t) for n, t in required.items()}, {n: spark.table(t) for n, t in optional.items()})


def write_back(px: DataFrame, masks: DataFrame, code: str = "code", keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Pixels with the code of `masks` where it has one, one row a pixel; both sides lie by scan line."""
    new = masks.select(*keys, F.col(code).alias("_new"))
    return px.join(new, list(keys), "left").withColumn(code, F.coalesce("_new", F.col(code))).drop("_new")
