"""Variants that share the steps they do not change, against a whole trace of each."""

from collections import Counter

from pyspark.sql import functions as F

from emberframe import codes as k
from emberframe.operators import scenario
from emberframe.plans import detect, variants
from emberframe.sources import views

KEYS = "variant string, base_region string, base_scene long, i int, j int, ref_code int, final_code int"


def test_variants_share_steps_and_keep_every_decision(spark, tmp_path, monkeypatch):
    ids = [*range(7500), *range(100, 160), None, None]
    rows = [(n, None if n is not None and n % 401 == 3 else float((n or 0) * 37 % 211 + (190 if (n or 0) % 53 == 9 else 0))) for n in ids]
    spark.createDataFrame(rows, "event_id long, value double").withColumn("ts", F.lit("2024-01-01 00:00:00")).write.parquet(str(tmp_path / "events.parquet"))
    px = views.pixels(spark, str(tmp_path)).withColumn("area_km2", F.lit(4.0)).localCheckpoint()
    alone = detect.full_trace(scenario.with_variants(px), views.lut(spark)).select(*variants.MASK).localCheckpoint()
    written, keep = [], variants.cut_lineage
    monkeypatch.setattr(variants, "cut_lineage", lambda df: written.append(keep(df)) or written[-1])
    shared = variants.variant_masks(px, views.lut(spark)).localCheckpoint()
    assert alone.exceptAll(shared).count() == 0 and shared.exceptAll(alone).count() == 0
    assert {r.variant for r in shared.where("candidate").select("variant").distinct().collect()} == set(scenario.VARIANTS)
    assert shared.groupBy("variant").agg(F.sum("final_code").alias("s")).select("s").distinct().count() > 4
    # three sights and six classes, not twelve variants; what has ended carries no columns of later steps
    gated, found = written
    assert gated.count() == 3 * px.count() and found.select("class").distinct().count() == 6
    assert gated.where("not survivor and (rad7 is not null or tpw is not null)").count() == 0
    assert found.where(~F.col("path").isin(*detect.GOING_ON) & F.coalesce("bt7", "bt7_bkg", "tpw").isNotNull()).count() == 0


def test_families_go_by_what_is_replaced():
    found = scenario.families(scenario.VARIANTS)
    assert list(found) == ["baseline", "no_band_2", "forced_hybrid"]
    assert found["baseline"]["baseline"] == ["baseline", "tpw_climatology", "tpw_25", "tpw_minus_10", "tpw_plus_10", "neutral_lut", "no_quality"]
    assert list(found["baseline"]) == ["baseline", "emissivity_one", "emissivity_constant", "no_band_15"]
    assert scenario.families(["no_band_2", "tpw_25"]) == {"no_band_2": {"no_band_2": ["no_band_2"]}, "tpw_25": {"tpw_25": ["tpw_25"]}}


def test_only_pixels_with_a_fire_in_some_variant_are_gathered(spark):
    fire, none = k.FIRE_CODES[0], 100
    rows = []
    for place, (ref, base, others) in enumerate([(fire, fire, (none, fire)), (none, none, (fire, none)), (none, fire, (none, None)), (fire, none, (none, fire)), (none, None, (fire, fire))]):
        rows += [("baseline", None, 1, place, 0, ref, base), ("x", None, 1, place, 0, ref, others[0]), ("y", None, 1, place, 0, ref, others[1])]
    rows += [(v, "r", None, 7, j, ref, none) for v in ("baseline", "x", "y", "quiet") for j in range(50) for ref in (fire,)]
    rows += [("x", None, 1, 1, 0, none, fire)]  # a repeated row counts again
    px = spark.createDataFrame(rows, KEYS)
    found = {r.variant: tuple(r)[1:] for r in scenario.against_baseline(px).collect()}
    assert found == {"x": (4, 1, 0, 1, 2), "y": (1, 0, 1, 0, 0), "quiet": (0, 0, 0, 0, 0)}
    plan = scenario.against_baseline(px)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and Counter(r.variant for r in px.select("variant").collect())["quiet"] == 50
