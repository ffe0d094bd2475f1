"""Per-pixel quantities and the ordered gates of part I."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe import codes as k
from emberframe.functions.nulls import holds
from emberframe.functions.radiometry import BandCoefficients, radiance_of

SCAN_LINE = ("region", "scene", "i")
OUTCOME = ("code", "stage", "is_cloudy", "survivor", "sat_flag", "fail_char")


def effective_longwave(px: DataFrame) -> DataFrame:
    """Long-wave band per pixel: band 13 where the focal plane is warm and it fits band 7 better than band 14."""
    seven = BandCoefficients.of(7)
    residual = lambda bt: F.abs(F.col("rad7") - radiance_of(F.col(bt), seven))
    hybrid = F.col("fpt") > k.FOCAL_PLANE_LIMIT
    use_13 = holds(hybrid & F.col("rad13").isNotNull() & (residual("bt13") < residual("bt14")))
    px = px.withColumn("use_ch13", use_13)
    pick = lambda a, b: F.when(F.col("use_ch13"), F.col(a)).otherwise(F.col(b))
    return px.withColumns({"bt14e": pick("bt13", "bt14"), "rad14e": pick("rad13", "rad14")})


def reflectivity_product(px: DataFrame) -> DataFrame:
    bad = holds(F.col("rad7") < 0) | holds(F.col("rad14e") < 0)
    excess = F.col("rad7") - radiance_of(F.col("bt14e"), BandCoefficients.of(7))
    return px.withColumn("refl", F.when(bad, k.REFL_SENTINEL).otherwise(excess))


def day_quantities(px: DataFrame) -> DataFrame:
    px = px.withColumns({
        "is_day": F.col("sza").between(0.0, k.MAX_DAY_ZENITH),
        "cos_sza": F.cos(F.radians("sza")),
        "vis": F.when(F.col("refl2").isNotNull(), F.sqrt(F.greatest("refl2", F.lit(0.0))) * 255.0),
    })
    return px.withColumn("albedo", F.when(F.col("is_day") & (F.col("cos_sza") > 0), F.col("refl2") / F.col("cos_sza")))


def day_offset(coefficient: float) -> Column:
    return F.when(F.col("is_day"), F.col("cos_sza") * coefficient).otherwise(F.lit(0.0))


def _neighbour(name: str, step: int, scan_line: Sequence[str]) -> Column:
    """Value `step` columns away on the scan line; beyond an edge, the edge pixel's value.

    The value travels in a struct, so a missing value at the neighbour is not taken for a missing neighbour.
    """
    line = W.partitionBy(*scan_line).orderBy("j")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    boxed = F.struct(F.col(name).alias("v"))
    near = F.lag(boxed, step).over(line) if step > 0 else F.lead(boxed, -step).over(line)
    edge = F.first(boxed).over(whole) if step > 0 else F.last(boxed).over(whole)
    return F.coalesce(near, edge)["v"]


def scan_neighbours(px: DataFrame, scan_line: Sequence[str] = SCAN_LINE) -> DataFrame:
    """Reflectivity 2 and 3 columns away: one shuffle by scan line, whose length the sensor bounds."""
    return px.withColumns({
        "refl_m2": _neighbour("refl", 2, scan_line), "refl_p2": _neighbour("refl", -2, scan_line),
        "refl_m3": _neighbour("refl", 3, scan_line), "refl_p3": _neighbour("refl", -3, scan_line),
    })


def _outcome(code: int | Column, stage: int) -> Column:
    code = code if isinstance(code, Column) else F.lit(code)
    return F.struct(code.cast("int").alias("code"), F.lit(stage).cast("int").alias("stage"))


def hard_gate() -> Column:
    """First failing gate as struct(code, stage); NULL for a pixel that passes them all."""
    c, fails = F.col, lambda cond, code, stage: (holds(cond), _outcome(code, stage))
    diff = c("bt7") - c("bt14e")
    emissive = lambda name: holds((c(name) > 0) & (c(name) <= 1))
    any_warm = (c("bt7") > k.WARM_BT) | (c("bt14e") > k.WARM_BT)
    any_cold = (c("bt7") <= k.WARM_BT) | (c("bt14e") <= k.WARM_BT)
    rules = [
        fails(~c("in_roi"), 0, 0),
        fails(c("bt7").isNull(), 40, 0),
        fails(c("lza") > k.MAX_VIEW_ZENITH, 50, 1),
        fails((c("sza") < k.GLINT_BLOCK) | (c("glint") < k.GLINT_BLOCK), 60, 2),
        fails(c("bt14e").isNull(), 121, 3),
        fails(c("bt7") > k.SAT_BT7 + k.SAT_BUFFER, 123, 3),
        fails(c("bt14e") > k.SAT_BT14 + k.SAT_BUFFER, 124, 3),
        fails(c("bt7") < k.MIN_USABLE_BT, 126, 3),
        fails(c("bt14e") < k.MIN_USABLE_BT, 127, 3),
        fails(~(emissive("emiss7") & emissive("emiss14")), 160, 4),
        fails(c("eco_code").isin(150, 151, 152, 153), c("eco_code"), 4),
        fails((c("rad7") < 0) | (c("rad14e") < 0), 125, 5),
        fails(any_warm & (F.abs(diff) <= k.MIN_BT_DIFF), 100, 6),
        fails((diff < k.MIN_BT_DIFF) & any_cold, 201, 6),
    ]
    chain = F
    for cond, result in rules:
        chain = chain.when(cond, result)
    return chain


def cloud_code() -> Column:
    """Cloud tests in order; they mark a pixel without stopping it."""
    c = F.col
    diff, split = c("bt7") - c("bt14e"), c("bt14e") - c("bt15")
    cold = c("bt14e") < k.CLOUD_BT14
    return (
        F.when(holds(cold), 200)
        .when(holds(diff < k.CLOUD_DIFF_LOW), 205)
        .when(holds((diff > k.CLOUD_DIFF_HIGH) & (c("bt7") < k.CLOUD_BT7)), 210)
        .when(holds(c("is_day") & (c("sza") <= k.CLOUD_ALBEDO_MAX_ZENITH) & (c("albedo") > k.CLOUD_ALBEDO)), 215)
        .when(holds(c("bt15") <= k.CLOUD_BT15), 220)
        .when(holds(cold & (split < k.SPLIT_LOW)), 225)
        .when(holds(cold & (split > k.SPLIT_HIGH)), 230)
    )


def along_scan_code() -> Column:
    """Cloud-edge test at 3 columns, for pixels still fire free."""
    c = F.col
    flat = holds(c("refl_m3") < k.SCAN_REFL) | holds(c("refl_p3") < k.SCAN_REFL)
    bright = holds((c("albedo") >= k.CLOUD_ALBEDO) & (c("bt7") < k.SCAN_BT7_MAX))
    dim = holds((c("bt7") < k.BT7_MIN_NIGHT) & (c("bt7") >= k.SCAN_BT7_MIN))
    return F.when(c("is_day") & bright & flat, 245).when(~c("is_day") & dim & flat, 240)


def prepare(px: DataFrame) -> DataFrame:
    return day_quantities(reflectivity_product(effective_longwave(px)))


def apply_gates(px: DataFrame) -> DataFrame:
    """Columns code, stage, is_cloudy, sat_flag, fail_char; `survivor` marks pixels that need a background."""
    return judge(scan_neighbours(px))


def judge(px: DataFrame) -> DataFrame:
    """The gates of prepared pixels that know their neighbours: the columns of OUTCOME."""
    px = px.withColumns({"_hard": hard_gate(), "_cloud": cloud_code()})
    px = px.withColumn("_open", F.col("_hard").isNull())
    px = px.withColumn("_scan", F.when(F.col("_open") & F.col("_cloud").isNull(), along_scan_code()))
    saturated = holds((F.col("bt7") >= k.SAT_FLAG_BT7) | (F.col("bt14e") >= k.SAT_FLAG_BT14))
    survivor = F.col("_open") & F.col("_scan").isNull()
    px = px.withColumns({
        "code": F.coalesce(F.col("_hard.code"), F.col("_cloud"), F.col("_scan"), F.lit(100)).cast("int"),
        "stage": F.coalesce(F.col("_hard.stage"), F.when(F.col("_scan").isNotNull(), 8), F.lit(9)).cast("int"),
        "is_cloudy": F.col("_open") & F.col("_cloud").isNotNull(),
        "survivor": survivor,
        "sat_flag": survivor & saturated,
    })
    return px.withColumn("fail_char", F.when(F.col("sat_flag"), 7).otherwise(-1)).drop("_hard", "_cloud", "_scan", "_open")


def valid_background() -> Column:
    """May this pixel serve as background of its neighbours?"""
    c = F.col
    warm = c("bt7") > day_offset(k.BKG_WARM_SOLAR) + k.BKG_WARM_NIGHT
    cold = (c("bt7") < k.BKG_COLD) | (c("bt14e") < k.BKG_COLD)
    seen = c("is_day") & c("vis").isNotNull() & c("albedo").isNotNull()
    reflective = holds(seen & ((c("vis") < k.BKG_MIN_VIS) | (c("albedo") > k.BKG_MAX_ALBEDO)))
    finite = c("bt7").isNotNull() & c("bt14e").isNotNull()
    return c("land") & finite & ~holds(warm) & ~holds(cold) & ~reflective
