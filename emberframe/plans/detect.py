"""The detector end to end, for any number of scenes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.functions.nulls import recover_unsigned
from emberframe.operators import background, confirm, corrections, gates, retrieval, temporal, thresholds
from emberframe.session import cut_lineage

KEY = ("region", "scene", "scene_epoch", "i", "j")
GOING_ON = ("open", "quick")  # paths of classified survivors that do not end there


def prepared(px: DataFrame) -> DataFrame:
    if "eco_code" not in px.columns:
        px = px.withColumn("eco_code", recover_unsigned(F.col("eco_byte")))
    return gates.prepare(px)


def gated_pixels(px: DataFrame) -> DataFrame:
    return gates.apply_gates(prepared(px))


def survivors(px: DataFrame) -> DataFrame:
    """Gate survivors with background, thresholds and the path they take."""
    return classified(gated_pixels(px))


def classified(gated: DataFrame) -> DataFrame:
    found = background.choose_approach(background.expanding_background(gated))
    return thresholds.classify_survivors(thresholds.contextual_thresholds(found))


def part_one(px: DataFrame, lut: DataFrame) -> DataFrame:
    """Every survivor with its part I outcome; `candidate` marks those that go on to part II.

    The paths are told apart by conditions on the same rows, so the background is computed once. `area_km2` is part of
    the static pixel geometry and comes with the pixels.
    """
    return outcome(gated_pixels(px), lut)


def outcome(gated: DataFrame, lut: DataFrame) -> DataFrame:
    rows = corrections.correct(classified(gated), lut)
    return retrieval.size_and_power(retrieval.last_chance(retrieval.retrieve(rows)))


def detections(px: DataFrame, lut: DataFrame, policy: str = "atbd", fires: DataFrame | None = None) -> DataFrame:
    """One row per candidate with the trace of both parts and, where confirmed, the final code."""
    found = confirm.confirm(part_one(px, lut).where("candidate"), policy)
    return temporal.temporal_filter(found, fires)


def traced(found: DataFrame, lut: DataFrame, policy: str = "atbd", fires: DataFrame | None = None) -> DataFrame:
    """The classified survivors that go on, with both parts and the final code."""
    rows = corrections.correct(found.where(F.col("path").isin(*GOING_ON)), lut)
    rows = retrieval.size_and_power(retrieval.last_chance(retrieval.retrieve(rows)))
    return temporal.temporal_filter(confirm.confirm(rows, policy), fires)


def whole_trace(gated: DataFrame, found: DataFrame, rest: DataFrame) -> DataFrame:
    """Every pixel once: those that a gate stopped, those that the background stopped, and the traced rest."""
    no = lambda *names: {n: F.lit(False) for n in names}
    stopped = gated.where(~F.col("survivor")).withColumns(no("candidate", "confirmed"))
    ended = found.where(~F.col("path").isin(*GOING_ON))
    ended = ended.withColumns(no("candidate", "confirmed", "skip_retrieval", "retrieval_valid", "temporally_filtered"))
    rows = rest.unionByName(ended, allowMissingColumns=True).unionByName(stopped, allowMissingColumns=True)
    return rows.withColumns({
        "p1_code": F.col("code"),
        "final_code": F.coalesce("final_code", "code"),
        "flag": F.when(F.col("candidate"), F.col("flag")).otherwise(F.col("fail_char")),
    }).drop("code")


def full_trace(px: DataFrame, lut: DataFrame, policy: str = "atbd", fires: DataFrame | None = None) -> DataFrame:
    """Every pixel: what stopped it or, for those that go on to the corrections, the trace of both parts and the final code.

    The gated pixels and the classified survivors are tables in the shared folder. Few survivors go on, and only these are corrected
    and shuffled by pixel; columns of steps that a pixel never came to are NULL.
    """
    gated = cut_lineage(gated_pixels(px))
    found = cut_lineage(classified(gated))
    return whole_trace(gated, found, traced(found, lut, policy, fires))


def scene_masks(px: DataFrame, lut: DataFrame, policy: str = "atbd", fires: DataFrame | None = None) -> DataFrame:
    """Every pixel with its part I code, stage and flag, and its final code."""
    columns = [*KEY, "stage", "fail_char", "p1_code", "candidate", "confirmed", "final_code", "flag"]
    return full_trace(px, lut, policy, fires).select(*columns)
