"""The trace in three parts against one chain over all survivors."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.operators import confirm, temporal
from emberframe.plans import detect
from emberframe.sources import tables
from emberframe.sources import views as v

SF = "/root/testdata/sf0.001"
NEVER_COME_TO = {"last_fire", "tpw_bin", "zenith_bin", "trans_4um", "trans_11um", "offset_4um", "offset_11um"}


def test_trace_corrects_only_what_goes_on_and_keeps_every_value(spark):
    px = v.pixels(spark, SF).withColumn("area_km2", F.lit(4.0)).localCheckpoint()
    gated = detect.gated_pixels(px).localCheckpoint()
    chain = temporal.temporal_filter(confirm.confirm(detect.outcome(gated, v.lut(spark)))).localCheckpoint()
    stopped = gated.where("not survivor").withColumns({"candidate": F.lit(False), "confirmed": F.lit(False)})
    old = stopped.unionByName(chain, allowMissingColumns=True).withColumns({
        "p1_code": F.col("code"), "final_code": F.coalesce("final_code", "code"), "flag": F.when(F.col("candidate"), F.col("flag")).otherwise(F.col("fail_char")),
    })
    new = detect.full_trace(px, v.lut(spark)).localCheckpoint()
    assert set(new.columns) == set(old.columns) - {"code"}
    names = [c for c in new.columns if c not in NEVER_COME_TO]
    assert old.select(names).exceptAll(new.select(names)).count() == 0 and new.select(names).exceptAll(old.select(names)).count() == 0
    going_on = F.col("path").isin(*detect.GOING_ON)
    assert new.where("survivor").where(~going_on & F.col("tpw_bin").isNotNull()).count() == 0
    assert new.where(going_on & F.col("tpw_bin").isNull()).count() == 0 and new.where(going_on).count() > 0


def test_a_scene_is_one_file_for_each_stretch_of_lines(spark, tmp_path):
    rows = spark.range(3000).select(F.expr("id % 3").alias("timestamp"), (F.col("id") % 2 * F.expr("if(id % 3 = 0, 400, 1)") + F.col("id") % 50).cast("int").alias("i"), "id")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        tables.write_by_scene(rows, str(tmp_path / "t"))
    finally:
        spark.conf.set(name, before)
    files = {n: len(list((tmp_path / "t" / f"scene={n}").glob("*.parquet"))) for n in range(3)}
    assert files[1] == files[2] == 1 and files[0] in (1, 2)
    assert spark.read.parquet(str(tmp_path / "t")).select("id").distinct().count() == 3000
