"""Radiometric corrections of pixel and background, and the flags that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe import codes as k
from emberframe.functions.nulls import clip, holds
from emberframe.functions.radiometry import BandCoefficients, radiance_of, temperature_of
from emberframe.operators.gates import day_offset


def long_coefficients() -> BandCoefficients:
    return BandCoefficients.chosen(F.col("use_ch13"), BandCoefficients.of(13), BandCoefficients.of(14))


def lut_bins(px: DataFrame) -> DataFrame:
    rounded = lambda name, high: clip(F.rint(F.col(name) / 10.0), 1.0, float(high)).cast("int")
    return px.withColumns({"tpw_bin": rounded("tpw", 5), "zenith_bin": rounded("lza", 7)})


def attach_lut(px: DataFrame, lut: DataFrame) -> DataFrame:
    """The table has 35 rows by contract, so it is broadcast. Rows with `use_lut` false take the neutral values."""
    joined = lut_bins(px).join(F.broadcast(lut), ["tpw_bin", "zenith_bin"], "left")
    if "use_lut" not in px.columns:
        return joined
    neutral = {"trans_4um": 1.0, "trans_11um": 1.0, "offset_4um": 0.0, "offset_11um": 0.0}
    return joined.withColumns({n: F.when(F.col("use_lut"), F.col(n)).otherwise(v) for n, v in neutral.items()})


def vapour_corrected(rad: Column, band: str) -> Column:
    return F.try_divide(rad - F.col(f"offset_{band}um"), F.col(f"trans_{band}um"))


def vapour_step(px: DataFrame) -> DataFrame:
    opened = lambda c: F.when(F.col("path") == "open", c)
    px = px.withColumns({
        "r7_tpw": opened(vapour_corrected(F.col("rad7"), "4")), "r14_tpw": opened(vapour_corrected(F.col("rad14e"), "11")),
    })
    px = px.withColumns({
        "t7_tpw": temperature_of(F.col("r7_tpw"), BandCoefficients.of(7)),
        "t14_tpw": temperature_of(F.col("r14_tpw"), long_coefficients()),
    })
    # No row for the pixel's bins is no correction; a comparison with a missing value is false.
    failed = holds(F.col("r7_tpw") < 0) | holds(F.col("r14_tpw") < 0) | holds(F.col("t7_tpw") <= 0) | holds(F.col("t14_tpw") <= 0)
    unusable = (F.col("trans_4um") == 0) | (F.col("trans_11um") == 0)
    return px.withColumn("tpw_failed", failed | holds(unusable))


def thin_cloud_step(px: DataFrame) -> DataFrame:
    """Temperatures raised under smoke or thin cloud: reported only, later steps use the radiances."""
    excess = F.col("albedo") - F.col("albedo_bkg")
    smoke = holds(F.col("is_day") & (excess > k.SMOKE_LOW) & (excess < k.SMOKE_HIGH))
    cloud = holds(F.col("is_day") & excess.isNotNull() & ((F.col("albedo") > k.CLOUD_ALBEDO) | (excess >= k.SMOKE_HIGH)))
    raised = lambda name, slope, fixed: (
        F.col(name) + F.when(smoke, excess * slope).when(cloud, F.lit(fixed)).otherwise(F.lit(0.0))
    )
    return px.withColumns({
        "t7_cloud": raised("t7_tpw", k.SMOKE_BT7, k.CLOUD_BT7_ADD),
        "t14_cloud": raised("t14_tpw", k.SMOKE_BT14, k.CLOUD_BT14_ADD),
    })


def emissivity_step(px: DataFrame) -> DataFrame:
    opened = F.col("path") == "open"
    background = lambda temp, coeff, band: vapour_corrected(radiance_of(F.when(opened, F.col(temp)), coeff), band)
    px = px.withColumns({
        "r7_em": F.col("r7_tpw") / F.col("emiss7"), "r14_em": F.col("r14_tpw") / F.col("emiss14"),
        "r7_bkg": background("bt7_bkg", BandCoefficients.of(7), "4") / F.col("emiss7"),
        "r14_bkg": background("bt14_bkg", long_coefficients(), "11") / F.col("emiss14"),
    })
    return px.withColumn("bkg_failed", holds(F.col("r7_bkg") <= 0) | holds(F.col("r14_bkg") <= 0))


def solar_step(px: DataFrame) -> DataFrame:
    """Reflected sunlight removed by day; `r7_from_14` is the background's own emission in band 7."""
    px = px.withColumn("r7_from_14", radiance_of(temperature_of(F.col("r14_bkg"), long_coefficients()), BandCoefficients.of(7)))
    sun = F.col("r7_bkg") - F.col("emiss7") * F.col("r7_from_14")
    sun = F.when(sun.isNotNull(), F.greatest(F.lit(0.0), sun))
    return px.withColumn("r7_solar", F.when(F.col("is_day"), (F.col("r7_em") - sun) / F.col("emiss7")).otherwise(F.col("r7_em")))


def diffraction_step(px: DataFrame) -> DataFrame:
    px = px.withColumns({
        "r7_diff": (F.col("r7_solar") - F.col("r7_from_14") * k.DIFFRACTION_7) / (1 - k.DIFFRACTION_7),
        "r14_diff": (F.col("r14_em") - F.col("r14_bkg") * k.DIFFRACTION_14) / (1 - k.DIFFRACTION_14),
    })
    seven, long = BandCoefficients.of(7), long_coefficients()
    px = px.withColumns({
        "bt7_corr": temperature_of(F.col("r7_diff"), seven), "bt14_corr": temperature_of(F.col("r14_diff"), long),
        "bt7_bkg_corr": temperature_of(F.col("r7_bkg"), seven), "bt14_bkg_corr": temperature_of(F.col("r14_bkg"), long),
    })
    failed = [holds(F.col(n) <= 0) for n in ("r7_solar", "r7_diff", "r14_diff", "bt7_corr", "bt14_corr", "bt7_bkg_corr", "bt14_bkg_corr")]
    any_failed = failed[0]
    for f in failed[1:]:
        any_failed = any_failed | f
    return px.withColumn("diff_failed", any_failed)


def post_correction_flags(px: DataFrame) -> DataFrame:
    c = F.col
    cold = (c("bt14_corr") < 285.0) | (c("bt7_corr") < day_offset(k.BT7_MIN_SOLAR) + k.BT7_MIN_NIGHT)
    covered = holds(c("albedo") > 0.15) | c("is_cloudy")
    flag = (
        F.when((c("fail_char") != 7) & holds(cold), 3)
        .when(holds(c("bt14_corr") - c("bt14_bkg_corr") < 0.25),
              F.when(covered & holds(c("bt7_corr") - c("bt14_bkg_corr") > 10.0), 10).otherwise(4))
        .when(holds(c("bt7_corr") - c("bt14_bkg_corr") < 2.0), 5)
        .when((c("fail_char") == -1) & c("is_day")
              & (holds(c("albedo") >= 0.25) | holds(c("albedo") - c("albedo_bkg") > 0.07)), 8)
        .otherwise(c("fail_char"))
    )
    px = px.withColumn("fail_post", flag)
    return px.withColumn("skip_retrieval", c("fail_post").isin(3, 4, 5, 10))


def correct(px: DataFrame, lut: DataFrame) -> DataFrame:
    """All corrections on `open` pixels; a failed step gives code 180 and the stage before it."""
    px = thin_cloud_step(vapour_step(attach_lut(px, lut)))
    px = post_correction_flags(diffraction_step(solar_step(emissivity_step(px))))
    opened = F.col("path") == "open"
    failed_at = F.when(F.col("tpw_failed"), 14).when(F.col("bkg_failed"), 15).when(F.col("diff_failed"), 16)
    px = px.withColumn("_failed_at", F.when(opened, failed_at))
    px = px.withColumn("path", F.when(F.col("_failed_at").isNotNull(), "stopped").otherwise(F.col("path")))
    opened = F.col("path") == "open"
    corrected = ("bt7_corr", "bt14_corr", "bt7_bkg_corr", "bt14_bkg_corr")
    px = px.withColumns({
        **{n: F.when(opened, F.col(n)) for n in corrected},
        "code": F.when(F.col("_failed_at").isNotNull(), 180).otherwise(F.col("code")).cast("int"),
        "stage": F.when(opened, 17).otherwise(F.coalesce(F.col("_failed_at"), F.col("stage"))).cast("int"),
        "fail_char": F.when(opened, F.col("fail_post")).otherwise(F.col("fail_char")),
        "skip_retrieval": F.col("skip_retrieval") & opened,
    }).drop("fail_post", "_failed_at", "tpw_failed", "bkg_failed", "diff_failed")
    return px
