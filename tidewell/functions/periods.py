"""Calendar periods, as Spark columns and as numpy arrays over days since 1970-01-01."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import text

RESOLUTIONS = ("day", "week", "month", "quarter", "year")

# Words by which sources state a resolution.
RESOLUTION_WORDS = {
    "day": ("day", "days", "daily", "harian", "hari", "d"),
    "week": ("week", "weeks", "weekly", "epiweek", "epi week", "epi_week", "mingguan", "minggu", "w"),
    "month": ("month", "months", "monthly", "bulanan", "bulan", "m"),
    "quarter": ("quarter", "quarters", "quarterly", "triwulan", "triwulanan", "kuartal", "q"),
    "year": ("year", "years", "yearly", "annual", "annually", "tahunan", "tahun", "y"),
}


def resolution(word: Column) -> Column:
    """One of RESOLUTIONS for a word in any case and spacing; null for null, empty or unknown words."""
    w = F.lower(text.clean(word))
    out = F.when(w.isin(*RESOLUTION_WORDS["day"]), "day")
    for name in RESOLUTIONS[1:]:
        out = out.when(w.isin(*RESOLUTION_WORDS[name]), name)
    return out


def period_start(day: Column, grain: Column | str) -> Column:
    """First day of the period (weeks begin on Monday) in which ``day`` lies."""
    if isinstance(grain, str):
        return F.date_trunc(grain, day).cast("date")
    out = F.when(grain == "day", day)
    for name in RESOLUTIONS[1:]:
        out = out.when(grain == name, F.date_trunc(name, day).cast("date"))
    return out


def stated_end(day: Column, grain: Column) -> Column:
    """End that a stated resolution gives to an interval starting on ``day``; a week is start + 6 days."""
    return (
        F.when(grain == "day", day)
        .when(grain == "week", F.date_add(day, 6))
        .when(grain == "month", F.last_day(day))
        .when(grain == "quarter", F.date_sub(F.add_months(F.date_trunc("quarter", day).cast("date"), 3), 1))
        .when(grain == "year", F.make_date(F.year(day), F.lit(12), F.lit(31)))
    )


def ordinal(days: np.ndarray, grain: np.ndarray) -> np.ndarray:
    """Consecutive number of the period of each day; ``grain`` indexes RESOLUTIONS."""
    months = days.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
    return np.select([grain == 0, grain == 1, grain == 2, grain == 3], [days, (days + 3) // 7, months, months // 3], months // 12)


def ordinal_start(number: np.ndarray, grain: np.ndarray) -> np.ndarray:
    """First day of a numbered period, the inverse of ``ordinal``."""

    def month(m: np.ndarray) -> np.ndarray:
        return m.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)

    return np.select(
        [grain == 0, grain == 1, grain == 2, grain == 3],
        [number, number * 7 - 3, month(np.where(grain == 2, number, 0)), month(np.where(grain == 3, number * 3, 0))],
        month(np.where(grain == 4, number * 12, 0)),
    )
