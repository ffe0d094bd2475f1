"""Last-fire state and the 12-hour temporal filter as joins over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe import codes as k

PIXEL = ("region", "i", "j")


def spread_to_neighbours(fires: DataFrame, radius: int = 1) -> DataFrame:
    """Each fire repeated at every pixel of its neighbourhood."""
    steps = lambda: F.array(*[F.lit(d) for d in range(-radius, radius + 1)])
    moved = fires.withColumn("_di", F.explode(steps())).withColumn("_dj", F.explode(steps()))
    return moved.withColumns({"i": F.col("i") + F.col("_di"), "j": F.col("j") + F.col("_dj")}).drop("_di", "_dj")


def last_fire_before(cand: DataFrame, fires: DataFrame) -> DataFrame:
    """`last_fire`: epoch of the latest strictly earlier fire in the 3 x 3 neighbourhood.

    An as-of join as one running maximum per pixel over the union of both tables: no pairs are formed, and a pixel's
    history has at most nine rows a scene.
    """
    names = [n for n in cand.columns if n not in (*PIXEL, "scene_epoch")]
    marks = spread_to_neighbours(fires.select(*PIXEL, "scene_epoch")).distinct()
    queries = cand.withColumns({"_row": F.struct(*names), "_fire": F.lit(None).cast("long")})
    both = queries.select(*PIXEL, "scene_epoch", "_row", "_fire").unionByName(
        marks.withColumn("_fire", F.col("scene_epoch").cast("long")), allowMissingColumns=True
    )
    earlier = W.partitionBy(*PIXEL).orderBy("scene_epoch").rangeBetween(W.unboundedPreceding, -1)
    seen = both.withColumn("last_fire", F.max("_fire").over(earlier)).where(F.col("_row").isNotNull())
    return seen.select(*PIXEL, "scene_epoch", "_row.*", "last_fire")


def recent(last_fire: Column, epoch: Column, lookback: int = k.LOOKBACK_SECONDS) -> Column:
    elapsed = epoch - last_fire
    return F.coalesce((elapsed > 0) & (elapsed <= lookback), F.lit(False))


def last_own_fire(cand: DataFrame) -> DataFrame:
    """`last_fire` where the fires are the confirmed candidates themselves.

    A confirmed row is exploded into itself and nine marks, so the detections are computed once and shuffled once.
    """
    names = [n for n in cand.columns if n not in (*PIXEL, "scene_epoch")]
    step = lambda di, dj, mark: F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(mark).alias("mark"))
    self_only = F.array(step(0, 0, False))
    marks = F.array(*[step(di, dj, True) for di in (-1, 0, 1) for dj in (-1, 0, 1)])
    spread = cand.withColumn("_to", F.explode(F.when(F.col("confirmed"), F.concat(self_only, marks)).otherwise(self_only)))
    rows = spread.select(
        "region", (F.col("i") + F.col("_to.di")).alias("i"), (F.col("j") + F.col("_to.dj")).alias("j"), "scene_epoch",
        F.when(~F.col("_to.mark"), F.struct(*names)).alias("_row"),
        F.when(F.col("_to.mark"), F.col("scene_epoch").cast("long")).alias("_fire"),
    )
    earlier = W.partitionBy(*PIXEL).orderBy("scene_epoch").rangeBetween(W.unboundedPreceding, -1)
    seen = rows.withColumn("last_fire", F.max("_fire").over(earlier)).where(F.col("_row").isNotNull())
    return seen.select(*PIXEL, "scene_epoch", "_row.*", "last_fire")


def temporal_filter(cand: DataFrame, fires: DataFrame | None = None) -> DataFrame:
    """Confirmed candidates with a fire nearby in the last 12 hours get their code + 20.

    `fires` is another fire table; without one the candidates' own confirmed fires count.
    """
    cand = last_own_fire(cand) if fires is None else last_fire_before(cand, fires)
    filtered = F.col("confirmed") & recent(F.col("last_fire"), F.col("scene_epoch"))
    cand = cand.withColumn("temporally_filtered", filtered)
    final = F.col("category") + F.when(F.col("temporally_filtered"), k.TEMPORAL_OFFSET).otherwise(0)
    return cand.withColumn("final_code", F.when(F.col("confirmed"), final).cast("int"))


def fire_events(source: str, detections: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """The fires that feed the filter: `none`, the engine's `own` detections, or the `reference` masks."""
    if source == "own":
        return detections.where("confirmed").select(*PIXEL, "scene_epoch")
    if source == "reference":
        return reference.where(F.col("ref_code").isin(*k.FIRE_CODES)).select(*PIXEL, "scene_epoch")
    if source == "none":
        base = detections if detections is not None else reference
        return base.select(*PIXEL, "scene_epoch").limit(0)
    raise ValueError(f"unknown temporal source {source!r}; use none, own or reference")


def state_before(fires: DataFrame, epoch: int | Column, lookback: int = k.LOOKBACK_SECONDS) -> DataFrame:
    """Last fire per pixel among scenes in [epoch - lookback, epoch)."""
    inside = (F.col("scene_epoch") >= epoch - lookback) & (F.col("scene_epoch") < epoch)
    return fires.where(inside).groupBy(*PIXEL).agg(F.max("scene_epoch").alias("last_fire"))


def merge_state(state: DataFrame, fires: DataFrame) -> DataFrame:
    """State after more scenes: the latest fire of each pixel, whatever the order of arrival."""
    new = fires.select(*PIXEL, F.col("scene_epoch").alias("last_fire"))
    return state.select(*PIXEL, "last_fire").unionByName(new).groupBy(*PIXEL).agg(F.max("last_fire").alias("last_fire"))


def outside_grid(state: DataFrame, rows: int, cols: int) -> DataFrame:
    """State rows that do not fit the scene's shape."""
    return state.where(~(F.col("i").between(0, rows - 1) & F.col("j").between(0, cols - 1)))


def seconds_since_2001(epoch: Column) -> Column:
    return epoch - k.EPOCH_2001
