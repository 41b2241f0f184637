"""Readings packed into one array row per series, the input of the per-series kernels.

Rows are first aggregated to one per series, day and (if asked) value, with map-side combine, so a
series that holds a large share of all rows shrinks to at most one element per calendar day (and
distinct value) before anything is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import periods

GRAINS = periods.RESOLUTIONS


def pack(df: DataFrame, by_value: bool) -> DataFrame:
    """(source_id, source_subunit, metric, votes, readings).

    ``votes`` counts the rows that state each of day, week, month, quarter, year. ``readings`` has
    day (since 1970), value and published_at (microseconds) of the latest usable row of each day,
    or of each distinct day and value if ``by_value``. Null and NaN values and null dates give
    votes but no reading.
    """
    word = periods.resolution(F.col("temporal_resolution_normalized"))
    value = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    rows = df.select(
        "source_id",
        "source_subunit",
        "metric",
        F.when(value.isNotNull(), F.unix_date("period_start")).alias("day"),
        (value + F.lit(0.0)).alias("value"),
        F.unix_micros(F.col("published_at").cast("timestamp")).alias("at"),
        F.col("observation_id").alias("id"),
        *[F.when(word == g, 1).otherwise(0).alias(f"votes_{g}") for g in GRAINS],
    )
    keys = ["source_id", "source_subunit", "day", *(["value"] if by_value else [])]
    votes = [F.sum(f"votes_{g}").alias(f"votes_{g}") for g in GRAINS]
    if by_value:
        daily = rows.groupBy(*keys).agg(F.max("at").alias("at"), F.min("metric").alias("metric"), *votes)
        reading = F.struct("day", "value", "at")
    else:
        daily = rows.groupBy(*keys).agg(F.max(F.when(F.col("day").isNotNull(), F.struct("at", "id", "value"))).alias("last"), F.min("metric").alias("metric"), *votes)
        reading = F.struct("day", F.col("last.value").alias("value"), F.col("last.at").alias("at"))
    return daily.groupBy("source_id", "source_subunit").agg(
        F.min("metric").alias("metric"),
        F.array(*[F.sum(f"votes_{g}") for g in GRAINS]).alias("votes"),
        F.collect_list(F.when(F.col("day").isNotNull(), reading)).alias("readings"),
    )


class Batch:
    """One Arrow batch of packed series as flat numpy arrays, sorted by series, period, publication."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        lists = batch.column("readings")
        flat = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        self.n = batch.num_rows
        self.votes = np.array(batch.column("votes").flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(self.n, len(GRAINS))
        owner = np.repeat(np.arange(self.n), sizes)
        day = flat.field("day").to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.nan_to_num(flat.field("at").to_numpy(zero_copy_only=False).astype(np.float64), nan=-1e30)
        value = flat.field("value").to_numpy(zero_copy_only=False).astype(np.float64)
        self.grain = self.votes.argmax(axis=1)
        for i in np.flatnonzero(self.votes.sum(axis=1) == 0):  # nobody states it: the usual step decides
            d = np.unique(day[owner == i])
            step = np.median(np.diff(d)) if len(d) > 1 else 1
            self.grain[i] = int(np.searchsorted([3, 18, 60, 200], step))
        period = periods.ordinal(day, self.grain[owner])
        order = np.lexsort((value, day, at, period, owner))
        self.owner, self.day, self.value, self.period = owner[order], day[order], value[order], period[order]


def linear(column: pa.Array, rows: np.ndarray) -> pa.Array:
    """Rows of a batch column, repeated as indexed."""
    return column.take(pa.array(rows, pa.int64()))
