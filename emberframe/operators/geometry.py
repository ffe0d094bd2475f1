"""Static per-region geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.codes import EARTH_RADIUS_KM
from emberframe.functions.sky import great_circle_km


def _reach(value: Column, fixed: tuple[str, ...], along: str, step: int) -> Column:
    """`value` two steps away along an axis, held at the grid's edge."""
    line = W.partitionBy(*fixed).orderBy(along)
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = F.lead(value, step).over(line) if step > 0 else F.lag(value, -step).over(line)
    if step > 0:
        # With one neighbour left the last pixel is the clamped corner, as it is with none.
        return F.coalesce(near, F.last(value).over(whole))
    return F.coalesce(near, F.first(value).over(whole))


def pixel_areas(geom: DataFrame, region: str = "region") -> DataFrame:
    """area_km2 from the 4 x 4 box of corners two pixels away: sides / 4, opposite sides averaged.

    Two windows (rows, then columns) instead of four self-joins; run once per region and stored.
    """
    here = F.struct("lat", "lon")
    geom = geom.withColumns({"_w": _reach(here, (region, "i"), "j", -2), "_e": _reach(here, (region, "i"), "j", 2)})
    pair = F.struct("_w", "_e")
    geom = geom.withColumns({"_n": _reach(pair, (region, "j"), "i", -2), "_s": _reach(pair, (region, "j"), "i", 2)})
    side = lambda a, b: great_circle_km(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"), EARTH_RADIUS_KM) / 4.0
    vertical = (side("_n._w", "_s._w") + side("_n._e", "_s._e")) / 2.0
    horizontal = (side("_s._w", "_s._e") + side("_n._w", "_n._e")) / 2.0
    return geom.withColumn("area_km2", F.greatest(vertical * horizontal, F.lit(0.0))).drop("_w", "_e", "_n", "_s")
