"""Time windows over fire events, the same expressions for batch and stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, *keys: str, width: str = "10 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, *keys: str, width: str = "12 hours", step: str = "10 minutes") -> DataFrame:
    """Events of each key in windows of `width`, one every `step`; `bounds` gives them one row a window.

    On a stream the state of a key is its events of open windows, each once, and not their width / step windows; windows in a row with
    the same events are a run (`runs`: starts of its first and last window, number of events), and the runs of a key that close together
    come out as one row. A window is closed when the watermark has passed its end; an event is late when the last of its windows is closed.
    """
    if not events.isStreaming:
        return events.groupBy(F.window("ts", width, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    wide, apart = (int(pd.Timedelta(x).total_seconds()) for x in (width, step))
    delay = events.schema["ts"].metadata.get("spark.watermarkDelayMs")
    if delay is None:
        raise ValueError("a stream needs a watermark on ts")
    at = F.unix_timestamp("ts")
    # marked as the column that the watermark is held against, so an event counts until its last window is closed
    until = F.timestamp_seconds(at + wide).alias("until", metadata={"spark.watermarkDelayMs": delay})
    rows = events.where("ts is not null").select(*keys, at.alias("at"), until)
    names = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    found = rows.groupBy(*keys).applyInPandasWithState(
        _runs(keys, wide, apart), f"{names}, first array<bigint>, last array<bigint>, n array<bigint>", "at array<bigint>, n array<bigint>, upto bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    size = F.struct(F.lit(wide).cast("long").alias("wide"), F.lit(apart).cast("long").alias("step"))
    return found.select(*keys, F.arrays_zip("first", "last", "n").alias("runs"), size.alias("size"))


def _runs(keys: Sequence[str], wide: int, apart: int) -> Callable:
    """Of one key: the windows closed by now, as runs of windows with the same number of events, in one row."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, counts, upto = state.get if state.exists else ((), (), None)
        at, n = np.array(seen, np.int64), np.array(counts, np.int64)
        if not state.hasTimedOut:
            for rows in frames:
                at, n = np.r_[at, rows["at"].to_numpy(np.int64)], np.r_[n, np.ones(len(rows), np.int64)]
        at, place = np.unique(at, return_inverse=True)
        n = np.bincount(place, n, len(at)).astype(np.int64)
        # starts of windows are multiples of the step; `closed` is the last one whose end the watermark has reached
        closed = (state.getCurrentWatermarkMs() // 1000 - wide) // apart * apart
        first, last = ((at - wide) // apart + 1) * apart, at // apart * apart
        moves = np.r_[first, last + apart]
        starts, place = np.unique(moves, return_inverse=True)
        total = np.cumsum(np.bincount(place, np.r_[n, -n], len(starts))).astype(np.int64)
        lo, hi = starts[:-1] if upto is None else np.maximum(starts[:-1], upto + apart), np.minimum(starts[1:] - apart, closed)
        due = (total[:-1] > 0) & (lo <= hi)
        open_ = last > closed
        if open_.any():
            state.update((at[open_].tolist(), n[open_].tolist(), int(closed)))
            following = max(int(first[open_].min()), closed + apart) + wide
            state.setTimeoutTimestamp(max(following * 1000 - 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if due.any():
            own = {k: pd.Series([None if pd.isna(v) else v], dtype=object) for k, v in zip(keys, key)}
            yield pd.DataFrame({**own, "first": [lo[due].tolist()], "last": [hi[due].tolist()], "n": [total[:-1][due].tolist()]})

    return step


def episodes(events: DataFrame, *keys: str, gap: str = "1 hour") -> DataFrame:
    """Sessions of fires closer together than the gap."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def bounds(table: DataFrame) -> DataFrame:
    """Window bounds as epoch seconds, one row a window; runs of windows are unrolled."""
    if "runs" not in table.columns:
        rest = [c for c in table.columns if c != "w"]
        return table.select(F.unix_timestamp("w.start").alias("from_epoch"), F.unix_timestamp("w.end").alias("to_epoch"), *rest)
    rest = [c for c in table.columns if c not in ("runs", "size")]
    each = table.select(*rest, "size", F.inline("runs"))
    each = each.select(F.explode(F.sequence("first", "last", F.col("size.step"))).alias("from_epoch"), "size", *rest, "n")
    return each.select("from_epoch", (F.col("from_epoch") + F.col("size.wide")).alias("to_epoch"), *rest, "n")


def run_complete(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run what is available; each batch replaces the result table."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
