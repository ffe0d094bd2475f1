"""Part II: elimination of false alarms, categories, confidence, policy and final values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe import codes as k
from emberframe.functions.nulls import holds
from emberframe.functions.settle import settle
from emberframe.operators.gates import day_offset

POLICIES = ("atbd", "conservative")


def eliminate(cand: DataFrame) -> DataFrame:
    """elim_reason: the first of three conditions that discards the candidate, else NULL."""
    c = F.col
    cand = cand.withColumns({
        "p2_day": day_offset(k.P2_DAY),
        "p2_std_reflb": F.greatest(F.lit(k.P2_REFL), c("rad_diff_sigma") * k.P2_REFL),
    })
    calm = holds(c("refl") - c("reflb") < c("p2_std_reflb")) | c("pass_along")
    delta = c("bt7") - c("bt7_bkg")
    not_hot = c("bt7") < c("p2_day") + k.P2_WARM
    cand = cand.withColumns({
        "cond1": holds(delta < k.P2_DELTA_MIN) & calm,
        "cond2": holds(not_hot & (delta < k.P2_DELTA_MAX) & (c("bt7") - c("bt14e") < k.P2_DIFF_MAX)) & calm,
        "cond3": holds(not_hot & (c("bt7_bkg") < c("p2_day") + k.P2_BKG_COLD) & (c("n_passes") >= k.MAX_PASSES)) & calm,
    })
    return cand.withColumn("elim_reason", F.when(c("cond1"), "cond1").when(c("cond2"), "cond2").when(c("cond3"), "cond3"))


def reassign_edges(cand: DataFrame) -> DataFrame:
    """Flag 11 for cloud, glint and fog edges."""
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0.0))
    edge = (zero("albedo") > k.EDGE_ALBEDO) | (zero("albedo") - zero("albedo_bkg") >= k.EDGE_ALBEDO_DIFF)
    cand = cand.withColumn(
        "glint_edge", c("fail_char").isin(9, 10) & holds(edge) & holds(c("bt7") < c("p2_day") + k.EDGE_BT7)
    )
    cand = cand.withColumn("_flag", F.when(c("glint_edge"), 11).otherwise(c("fail_char")))
    fog = (c("p2_day") + k.FOG_ADD - (c("bt7_bkg") - c("bt14_bkg")) < k.FOG_DIFF) & (c("bt7") - c("bt7_bkg") <= k.FOG_DELTA)
    cand = cand.withColumn("fog_edge", (c("_flag") >= 9) & holds(fog))
    return cand.withColumn("flag", F.when(c("fog_edge"), 11).otherwise(c("_flag"))).drop("_flag")


def confidence_thresholds(level: str) -> tuple[Column, Column]:
    floor, add = k.CONFIDENCE[level]
    growth = F.least(F.lit(5.0), F.col("n_passes") / 3.0) + add
    own = growth + F.col("bt7_bkg_std") * 2.0
    between = growth + (F.col("bt7_bkg") - F.col("bt14_bkg")) + F.col("diff_std") * 2.0
    return F.greatest(F.lit(floor), own), F.greatest(F.lit(floor), between)


def categorise(cand: DataFrame) -> DataFrame:
    """base_code from temperature and flag, then the confidence upgrade and its flag offset."""
    c = F.col
    base = (
        F.when(holds(c("fire_temp") > k.MIN_FIRE_TEMP), 10)
        .when(c("sat_flag") & (c("fire_temp").isNull() | (c("fire_temp") == 0)), 11)
        .when(c("flag").isin(9, 10), 12)
        .otherwise(15)
    )
    high, medium = confidence_thresholds("high"), confidence_thresholds("medium")
    cand = cand.withColumns({
        "base_code": base, "thr1_high": high[0], "thr2_high": high[1], "thr1_medium": medium[0], "thr2_medium": medium[1],
    })
    eligible = c("flag").isin(3, 4, 6, 8) & holds(c("fire_temp") < 0)
    contrast = holds(c("refl") - c("reflb") >= c("std_reflb_max")) | c("pass_along")
    beyond = lambda lvl: contrast & holds(
        (c("bt7") - c("bt7_bkg") > c(f"thr1_{lvl}")) & (c("bt7") - c("bt14e") > c(f"thr2_{lvl}"))
    )
    cand = cand.withColumn("upgraded", F.when(eligible, F.when(beyond("high"), 13).when(beyond("medium"), 14).otherwise(15)))
    return cand.withColumns({
        "category": F.coalesce(c("upgraded"), c("base_code")),
        "flag": c("flag") + F.when(c("upgraded") == 13, 30).when(c("upgraded") == 14, 20).otherwise(0),
    })


def apply_policy(cand: DataFrame, policy: str = "atbd") -> DataFrame:
    if policy not in POLICIES:
        raise ValueError(f"unknown detection policy {policy!r}; use one of {POLICIES}")
    rejected = F.lit(None).cast("string")
    if policy == "conservative":
        weak = (F.col("category") == 15) & holds(F.col("bt7") - F.col("bt7_bkg") < k.CONSERVATIVE_DELTA)
        rejected = F.when(F.col("category") == 12, "cloud_contaminated").when(weak, "low_prob_delta_bt7_lt_6K")
    return cand.withColumn("policy_rejected", rejected)


def finalise(cand: DataFrame) -> DataFrame:
    """Area and power as reported, and whether the candidate is confirmed."""
    c = F.col
    cold = (c("category") != 10) & holds(c("fire_temp") < k.MIN_FIRE_TEMP)
    return cand.withColumns({
        "confirmed": c("candidate") & c("elim_reason").isNull() & c("policy_rejected").isNull(),
        "final_area": F.when(cold, k.NOT_RETRIEVED).otherwise(c("fire_area")),
        "final_frp": F.when(c("n_passes") > k.MAX_PASSES, k.FRP_OVER_PASSES)
        .when(c("category").isin(11, 12, 15), k.FRP_SKIPPED).otherwise(c("frp")),
    })


def confirm(cand: DataFrame, policy: str = "atbd") -> DataFrame:
    """Part II; its columns stay NULL for rows that are no candidates."""
    before = set(cand.columns)
    done = finalise(apply_policy(categorise(reassign_edges(eliminate(cand))), policy))
    only = {n: F.when(F.col("candidate"), F.col(n)) for n in done.columns if n not in before and n != "confirmed"}
    return settle(done.withColumns(only))
