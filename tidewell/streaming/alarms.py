"""Alarms on a stream of readings: windowed counts with a watermark, and an EWMA kept per key as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, ts timestamp, value double, level double, alarm boolean"
STATE = "level double, spread double, seen long"


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events per type and window; events later than ``late`` are left out. Works on batches and streams."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def ewma_alarms(readings: DataFrame, alpha: float = 0.2, limit: float = 3.0) -> DataFrame:
    """(key, ts, value, level, alarm) for a stream of (key, ts, value): readings more than ``limit`` mean absolute deviations off the level.

    The state of a key is three numbers. Null values pass without a change; the first five readings of a key give no alarm.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, spread, seen = state.get if state.exists else (0.0, 0.0, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, value in zip(rows["ts"], rows["value"]):
            if value is None or value != value:
                continue
            off = abs(value - level)
            out.append((key[0], ts, float(value), level, bool(seen >= 5 and off > limit * max(spread, 1e-9))))
            level, spread, seen = (float(value), 0.0, 1) if not seen else (level + alpha * (value - level), spread + alpha * (off - spread), seen + 1)
        state.update((level, spread, seen))
        yield pd.DataFrame(out, columns=["key", "ts", "value", "level", "alarm"])

    return readings.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
