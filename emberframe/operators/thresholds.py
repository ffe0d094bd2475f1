"""Contextual thresholds, the quick path and the non-fire rejections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe import codes as k
from emberframe.functions.nulls import clip, holds
from emberframe.operators.gates import day_offset


def contextual_thresholds(bkg: DataFrame) -> DataFrame:
    growth = F.least(F.lit(5.0), F.col("n_passes") / 3.0)
    refl = F.col("refl")
    bkg = bkg.withColumns({
        "std_7b14b": F.when(F.col("diff_std").isNotNull(), F.least(F.lit(4.0), F.col("diff_std") * 3.0)),
        "std_7b": clip(F.col("bt7_bkg_std") * 3.75 + growth, 4.0, 10.0),
        "std_reflb": clip(F.col("rad_diff_sigma") * 3.0, 0.25, 1.0),
        "std_reflb_max": clip(F.col("rad_diff_sigma") * 2.5 + growth * 0.5, 2.5, 10.0),
        "albedo_bkg": F.when(
            F.col("is_day"), F.pow(F.col("vis_bkg") / 25.5, 2) / (F.greatest(F.col("cos_sza"), F.lit(1e-6)) * 100.0)
        ),
        "bt7_refl_thr": day_offset(k.BT7_REFL_SOLAR) + k.BT7_REFL_NIGHT,
    })
    lone = (refl - F.col("refl_m2") < F.col("std_reflb")) & (refl - F.col("refl_p2") < F.col("std_reflb"))
    return bkg.withColumn("pass_along", ~holds(lone & (F.col("bt7") < F.col("bt7_refl_thr"))))


def classify_survivors(bkg: DataFrame) -> DataFrame:
    """Code, stage and flag after the contextual tests; `path` says where the pixel goes next.

    path: none (170), quick (candidate without retrieval), stopped, or open (on to the corrections).
    """
    c = F.col
    diff, delta = c("bt7") - c("bt14e"), c("bt7") - c("bt7_bkg")
    low_diff, low_delta = holds(diff < c("std_7b14b")), holds(delta < c("std_7b"))
    steady = holds(c("refl") < c("std_reflb_max")) | c("pass_along")
    over_passes = c("n_passes") > k.MAX_PASSES
    non_fire = holds((c("refl") < c("std_reflb")) & (c("bt7") < 320.0)) | holds(diff < 0) | holds(delta < 0)
    step = (
        F.when(c("half_width").isNull(), "none")
        .when((c("sat_flag") | holds(over_passes)) & (low_diff | low_delta), "quick")
        .when(non_fire, "non_fire")
        .when(low_diff & steady, "flag_1")
        .when(low_delta & steady, "flag_2")
        .otherwise("open")
    )
    bkg = bkg.withColumn("step", step)
    is_step = lambda name: c("step") == name
    bkg = bkg.withColumns({
        "code": F.when(is_step("none"), 170).otherwise(c("code")).cast("int"),
        "stage": F.when(is_step("none"), 9).when(is_step("quick"), 22).when(is_step("non_fire"), 11)
        .when(is_step("flag_1"), 12).when(is_step("flag_2"), 13).otherwise(14).cast("int"),
        "fail_char": F.when(is_step("flag_1"), 1).when(is_step("flag_2"), 2).otherwise(c("fail_char")),
        "path": F.when(is_step("none") | is_step("quick") | is_step("open"), c("step")).otherwise("stopped"),
    }).drop("step")
    return bkg
