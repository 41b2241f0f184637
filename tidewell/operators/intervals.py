"""Continuous periods and gaps of overlapping day intervals, by a sweep line in SQL windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import periods


def closed_intervals(df: DataFrame, entity: str, start: str = "period_start", end: str = "period_end", word: str = "temporal_resolution") -> DataFrame:
    """(entity, first_day, last_day) of the rows that count.

    A null end is the end of the stated week (start + 6 days), calendar month, quarter or year;
    without a readable resolution it is the start. Rows without a start or with an end before it
    do not count.
    """
    first = F.col(start).cast("date")
    last = F.coalesce(F.col(end).cast("date"), periods.stated_end(first, periods.resolution(F.col(word))), first)
    return df.select(F.col(entity).alias("entity"), first.alias("first_day"), last.alias("last_day")).where("last_day >= first_day")


def sweep(intervals: DataFrame) -> DataFrame:
    """(entity, kind, first_day, last_day): covered periods and the gaps between them.

    Every interval gives +1 on its first day and -1 on the day after its last. The events are
    summed per entity and day before the window, with map-side combine, so an entity with a large
    share of the rows brings at most one event per calendar day to its task. An interval that starts
    the day after another ends continues it. Entities may be null; empty input gives no rows.
    """
    ends = intervals.select(
        "entity",
        F.explode(F.array(F.struct(F.col("first_day").alias("day"), F.lit(1).alias("step")), F.struct(F.date_add("last_day", 1).alias("day"), F.lit(-1).alias("step")))).alias("e"),
    ).select("entity", "e.day", "e.step")
    events = ends.groupBy("entity", "day").agg(F.sum("step").alias("step")).where("step != 0")
    order = Window.partitionBy("entity").orderBy("day")
    active = events.withColumn("active", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a covered period begins where the count leaves zero, a gap where it returns to it
    turns = active.where("active = 0 or active = step")
    spans = turns.withColumn("next_day", F.lead("day").over(order)).where("next_day is not null")
    return spans.select("entity", F.when(F.col("active") == 0, "gap").otherwise("covered").alias("kind"), F.col("day").alias("first_day"), F.date_sub("next_day", 1).alias("last_day"))


def gaps(df: DataFrame) -> DataFrame:
    """(dataset_id, gap_start, gap_end) as yyyy-mm-dd between the continuous periods of each dataset."""
    text = [F.date_format(c, "yyyy-MM-dd").alias(n) for c, n in (("first_day", "gap_start"), ("last_day", "gap_end"))]
    return sweep(closed_intervals(df, "dataset_id")).where("kind = 'gap'").select(F.col("entity").alias("dataset_id"), *text)
