"""Polar-orbiter detections matched to the scenes before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def previous_scenes(detections: DataFrame, hours: int, step: int = 600) -> DataFrame:
    """Each detection with the scene times of the last hours: from one step before its own slot, every step, both ends in."""
    end = F.floor(F.col("epoch") / step) * step - step
    slots = F.sequence((end - hours * 3600).cast("long"), end.cast("long"), F.lit(step).cast("long"))
    return detections.withColumn("slots", slots)


def match_scenes(detections: DataFrame, scenes: DataFrame, hours: int, step: int = 600) -> DataFrame:
    """Only the scenes that exist: an equi-join on the slot, at most 6 * hours + 1 rows a detection."""
    wanted = previous_scenes(detections, hours, step).withColumn("slot", F.explode("slots")).drop("slots")
    return wanted.join(scenes.select("slot").distinct(), "slot")
