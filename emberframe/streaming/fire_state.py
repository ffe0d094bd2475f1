"""The temporal filter on a stream: keyed state of recent fires per pixel, with a 12-hour life."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberframe import codes as k
from emberframe.operators import confirm
from emberframe.plans import detect
from emberframe.sources import scenes

OUT = "region string, i int, j int, scene_epoch bigint, category int, last_fire bigint, final_code int"
STATE = "fires array<bigint>, epochs array<bigint>, categories array<int>"


def _filter_pixel(lookback: int) -> Callable:
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fires, asked = set(), []
        if state.exists:
            old = state.get
            fires, asked = set(old[0]), list(zip(old[1], old[2]))
        if not state.hasTimedOut:
            for rows in frames:
                epochs, mark, categories = (rows[c].to_numpy() for c in ("scene_epoch", "mark", "category"))
                fires.update(epochs[mark].tolist())
                asked += zip(epochs[~mark].tolist(), categories[~mark].tolist())
        # Up to the watermark no fire can come any more, so a row there knows all fires before it.
        watermark = state.getCurrentWatermarkMs() // 1000
        due, waiting = [a for a in asked if a[0] <= watermark], sorted(a for a in asked if a[0] > watermark)
        oldest = min([watermark, *(e for e, _ in waiting)])
        # One pixel has at most one fire a scene, so the lists are bounded by the scenes in look-back and lateness.
        kept = sorted(f for f in fires if f >= oldest - lookback)
        if kept or waiting:
            state.update((kept, [e for e, _ in waiting], [c for _, c in waiting]))
            state.setTimeoutTimestamp(max((waiting[0][0] if waiting else kept[-1] + lookback) * 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if not due:
            return
        burnt = sorted(fires)
        before = [bisect_left(burnt, e) - 1 for e, _ in due]  # the latest fire before each, found in the sorted list
        last = [burnt[b] if b >= 0 and e - burnt[b] <= lookback else None for (e, _), b in zip(due, before)]
        yield pd.DataFrame({
            "region": key[0], "i": key[1], "j": key[2], "scene_epoch": [e for e, _ in due], "category": [c for _, c in due],
            "last_fire": pd.array(last, dtype="Int64"), "final_code": [c + k.TEMPORAL_OFFSET if f is not None else c for (_, c), f in zip(due, last)],
        })

    return step


def temporal_stream(confirmed: DataFrame, lookback: int = k.LOOKBACK_SECONDS, late: str = "12 hours") -> DataFrame:
    """Streaming rows (region, i, j, scene_epoch, category) to final codes, the same as in a batch.

    Fires may come in any order within `late`; a row is given its code when the watermark has passed it, later rows are dropped.
    A fire marks its 3 x 3 neighbourhood; state is kept only for marked pixels.
    """
    steps = F.array(F.struct(F.lit(0).alias("di"), F.lit(0).alias("dj"), F.lit(False).alias("mark")), *[
        F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(True).alias("mark")) for a in (-1, 0, 1) for b in (-1, 0, 1)
    ])
    timed = confirmed.withColumn("ts", F.timestamp_seconds("scene_epoch")).withWatermark("ts", late)
    spread = timed.select("region", "i", "j", "scene_epoch", "category", "ts", F.explode(steps).alias("s"))
    rows = spread.select(
        "region", (F.col("i") + F.col("s.di")).cast("int").alias("i"), (F.col("j") + F.col("s.dj")).cast("int").alias("j"), "scene_epoch",
        F.col("category").cast("int").alias("category"), F.col("s.mark").alias("mark"), "ts",
    )
    return rows.groupBy("region", "i", "j").applyInPandasWithState(
        _filter_pixel(lookback), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def detect_stream(pixels: DataFrame, lut: DataFrame, out: str, checkpoint: str, policy: str = "atbd", bands: Sequence[str] | None = None) -> StreamingQuery:
    """Scenes in, confirmed candidates out: the batch detector runs on each micro-batch, which must hold whole scenes.

    `scenes.stream_scenes` gives such batches; its rows are of single bands, and `bands` names those that a pixel must have. The sink is
    a scene store again, announced batch by batch: a batch that is retried replaces its own files and marker, so each scene is there once.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        px = batch if bands is None else scenes.assemble(batch, bands)
        found = confirm.confirm(detect.part_one(px, lut).where("candidate"), policy).where("confirmed")
        part = f"batch-{number:020d}"
        rows = found.select(*detect.KEY, F.lit("fires").alias("band"), "category", "flag", "final_area", "final_frp")
        rows.write.mode("overwrite").partitionBy("region", "scene_epoch", "band").parquet(f"{out}/{part}")
        scenes.announce(out, part, [part])

    return pixels.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FIRES = "scene int, category int, flag int, final_area double, final_frp double"


def to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run what is available into a parquet folder and wait."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
