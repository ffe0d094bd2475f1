"""Band tables that lie together join without a shuffle; unlike layouts are refused."""

import uuid

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.session import new_path
from emberframe.sources import colocated


def written(spark, rows, buckets=4):
    table = f"band_{uuid.uuid4().hex}"
    colocated.write_band(rows, table, new_path(spark, "band"), buckets)
    return table


def pixels(spark, name, share):
    rows = spark.range(600).selectExpr("'r' as region", "id div 300 as scene", "cast(id % 300 div 20 as int) as i", "cast(id % 20 as int) as j", f"id * 1.0 as {name}", "cast(0 as int) as code")
    return rows.where(F.pmod(F.xxhash64("scene", "i", "j"), F.lit(100)) < share)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bands_lines_and_masks_need_no_exchange(spark):
    required = {"a": written(spark, pixels(spark, "a", 100)), "b": written(spark, pixels(spark, "b", 90).drop("code"))}
    masks = written(spark, pixels(spark, "c", 30).select(*colocated.DEFAULT_KEYS, F.lit(7).alias("code")))
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    with colocated.joined_by_line(spark):
        px = colocated.read_bands(spark, required).withColumn("step", F.col("a") - F.lag("a").over(W.partitionBy(*colocated.LINE).orderBy("j")))
        back = colocated.write_back(px, spark.table(masks))
        assert "Exchange" not in plan_of(back)
        got = {(r.scene, r.i, r.j): (r.a, r.b, r.code) for r in back.collect()}
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    hot = {(r.scene, r.i, r.j) for r in pixels(spark, "c", 30).collect()}
    both = {(r.scene, r.i, r.j): r.b for r in pixels(spark, "b", 90).collect()}
    assert got == {k: (v, v, 7 if k in hot else 0) for k, v in both.items()}


def test_optional_bands_and_null_keys(spark):
    rows = spark.createDataFrame([("r", 1, 0, 0, 1.0), ("r", 1, 0, 1, 2.0), ("r", 1, None, 1, 3.0)], "region string, scene long, i int, j int, a double")
    other = spark.createDataFrame([("r", 1, 0, 1, 5.0), ("r", 1, None, 1, 6.0)], "region string, scene long, i int, j int, b double")
    with colocated.joined_by_line(spark):
        out = colocated.read_bands(spark, {"a": written(spark, rows)}, {"b": written(spark, other)})
        assert {(r.i, r.j, r.a, r.b) for r in out.collect()} == {(0, 0, 1.0, None), (0, 1, 2.0, 5.0), (None, 1, 3.0, None)}
        empty = colocated.read_bands(spark, {"a": written(spark, rows.limit(0)), "b": written(spark, other)})
        assert empty.count() == 0


def test_unlike_layouts_are_refused(spark):
    tables = [written(spark, pixels(spark, "a", 100), buckets) for buckets in (4, 8)]
    with pytest.raises(ValueError, match="layout"):
        colocated.read_bands(spark, {"a": tables[0], "b": tables[1]})
