"""Panels of places and periods: roll-ups, coverage, calendar features, regular spines, readiness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import periods, text

SPACE = ("admin0", "admin1", "admin2", "admin3")
TIME = ("day", "week", "month", "quarter", "year")
# The longest span in days that still counts as a resolution, where no word states it.
SPANS = ((1, "day"), (8, "week"), (32, "month"), (92, "quarter"))


def resolve_resolution(word: Column, start: Column, end: Column) -> Column:
    """The stated resolution, else the one that the span from start to end suggests."""
    span = F.datediff(end, start) + 1
    guess = F.when(span.isNull(), F.lit(None).cast("string"))
    for days, name in SPANS:
        guess = guess.when(span <= days, name)
    return F.coalesce(periods.resolution(word), guess.otherwise("year"))


def period_end(start: Column, grain: Column) -> Column:
    """Last day of the period that begins on ``start``."""
    return periods.stated_end(start, grain)


def location_label(columns: list[str]) -> Column:
    """Non-blank names joined by a bar, from the top down; null if all are blank."""
    label = F.concat_ws(" | ", *[F.when(text.clean(c) != "", F.col(c)) for c in columns])
    return F.when(label != "", label)


def location_path(columns: list[str]) -> Column:
    """Distinct non-blank names in order, 'Unspecified' if there is none."""
    names = F.array_distinct(F.filter(F.array(*[text.clean(c) for c in columns]), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(names) > 0, F.array_join(names, " | ")).otherwise("Unspecified")


def valid_cases(df: DataFrame, start: str = "period_start", value: str = "cases") -> DataFrame:
    """Rows with a date and a finite value of zero or more."""
    return df.where(F.col(start).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0) & (F.col(value) < float("inf")))


def multiscale(df: DataFrame, space: Column, time: Column) -> DataFrame:
    """Every roll-up of (admin_0..admin_3, period_start, cases, population) to coarser or equal grains of space and time.

    ``space`` and ``time`` give the native grain of each row; rows of different native grains do not mix. One expansion and one partial
    aggregation make all grains. Rates are per 100,000 of the summed population, null unless it is positive;
    populations are summed over periods too. Null places keep their own group.
    """
    levels = F.array(*[F.lit(x) for x in SPACE])
    grains = F.array(*[F.lit(x) for x in TIME])
    coarser = F.slice(levels, F.lit(1), F.array_position(levels, space).cast("int"))
    longer = F.slice(grains, F.array_position(grains, time).cast("int"), F.lit(len(TIME)))
    usable = df.withColumn("native_space", space).withColumn("native_time", time).where(F.array_contains(levels, F.col("native_space")) & F.array_contains(grains, F.col("native_time")))
    wide = usable.withColumn("space", F.explode(coarser)).withColumn("time", F.explode(longer))
    depth = F.array_position(levels, F.col("space"))
    kept = [F.when(depth > i, F.col(f"admin_{i}")).alias(f"admin_{i}") for i in range(4)]
    rolled = wide.select("native_space", "native_time", "space", "time", *kept, periods.period_start(F.col("period_start"), F.col("time")).alias("period_start"), "cases", "population")
    out = rolled.groupBy("native_space", "native_time", "space", "time", *[f"admin_{i}" for i in range(4)], "period_start").agg(F.sum("cases").alias("cases"), F.sum("population").alias("population"), F.count(F.lit(1)).alias("rows"))
    return out.withColumn("period_end", period_end(F.col("period_start"), F.col("time"))).withColumn("incidence_per_100k", F.when(F.col("population") > 0, F.col("cases") / F.col("population") * 100000.0))


def inventory(panel: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Size, places, periods, first, last, total and share of filled values of each panel."""
    return panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(place).alias("places"), F.count_distinct("period_start").alias("periods"), F.min("period_start").alias("first_period"),
        F.max("period_start").alias("last_period"), F.sum(value).alias("total"), F.avg(F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)).alias("filled_share"),
    )


def expected_periods(first: Column, last: Column, grain: str) -> Column:
    """Periods from first to last, both included; weeks are counted by the Sundays between the two Mondays."""
    months = (F.year(last) * 12 + F.month(last)) - (F.year(first) * 12 + F.month(first))
    if grain == "day":
        return F.datediff(last, first) + 1
    if grain == "week":
        return F.floor(F.datediff(last, first) / 7).cast("int")
    return {"month": months + 1, "quarter": F.floor(months / 3).cast("int") + 1, "year": F.year(last) - F.year(first) + 1}[grain]


def by_years(panel: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per series with its sums in one column per year; the years are those of the data."""
    dated = panel.withColumn("_year", F.year("period_start"))
    years = [r[0] for r in dated.where("_year is not null").select("_year").distinct().orderBy("_year").toLocalIterator()]  # a few dozen numbers
    return dated.groupBy(*keys).pivot("_year", years).agg(F.sum(value))


def melt_years(wide: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, year, value) of every column named like a year, without nulls; other columns are left out."""
    years = [c for c in wide.columns if c not in keys and c.isdigit() and len(c) == 4]
    if not years:
        return wide.select(*keys, F.lit(None).cast("string").alias("year"), F.lit(None).cast("double").alias(value)).where("false")
    return wide.select(*keys, *years).unpivot(keys, years, "year", value).where(F.col(value).isNotNull())


def coverage_cells(df: DataFrame, across: str, word: str) -> DataFrame:
    """(across, word, rows): how many rows each pair holds, 0 for pairs that don't occur; null words count as ''. Words are counted before they are paired."""
    counted = df.groupBy(across, F.coalesce(F.col(word), F.lit("")).alias("word")).agg(F.count(F.lit(1)).alias("rows"))
    words = counted.agg(F.collect_set("word").alias("words"))  # the distinct words of one column
    cells = counted.groupBy(across).agg(F.map_from_entries(F.collect_list(F.struct("word", "rows"))).alias("have"))
    listed = cells.join(F.broadcast(words)).select(across, "have", F.explode("words").alias("word"))
    return listed.select(across, "word", F.coalesce(F.element_at("have", F.col("word")), F.lit(0)).alias("rows"))


def coverage(panel: DataFrame, keys: list[str], grain: str) -> DataFrame:
    """Observed against expected periods of each series."""
    out = panel.groupBy(*keys).agg(F.count_distinct("period_start").alias("observed"), F.min("period_start").alias("first_period"), F.max("period_start").alias("last_period"))
    out = out.withColumn("expected", expected_periods(F.col("first_period"), F.col("last_period"), grain))
    return out.withColumn("completeness", F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")))


def quality_counters(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(check_name, failing, rows, rate) of missing, negative, fractional and zero values, missing dates and repeated keys, in one pass."""
    v = F.col(value)
    checks = {
        "value_missing": v.isNull() | F.isnan(v),
        "value_negative": v < 0,
        "value_fractional": ~F.isnan(v) & (v != F.floor(v)),
        "value_zero": v == 0,
        "date_missing": F.col("period_start").isNull(),
        "key_repeated": None,
    }
    # counted by key first, and these few counts then summed: a hot or null key is reduced map-side, and no row meets a window
    own = {n: c for n, c in checks.items() if n != "key_repeated"}
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"), *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in own.items()])
    counted = each.agg(
        F.coalesce(F.sum("_times"), F.lit(0)).alias("rows"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in own], F.coalesce(F.sum(F.when(F.col("_times") > 1, F.col("_times")).otherwise(0)), F.lit(0)).alias("key_repeated")
    )
    rows = counted.select("rows", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in checks]), F.array(*[F.col(n) for n in checks]))).alias("check_name", "failing"))
    return rows.select("check_name", "failing", "rows", F.try_divide("failing", "rows").alias("rate"))


def pair_differences(totals: DataFrame, group: list[str], source: str, value: str) -> DataFrame:
    """All pairs of sources (in name order) that state a total for the same group, with absolute and relative difference.

    Meant for totals: one row per group and source, so the pairs of a group are bounded by the number of sources.
    """
    a, b = (totals.select(*group, F.col(source).alias(f"source_{x}"), F.col(value).alias(f"value_{x}")) for x in "ab")
    return a.join(b, group).where("source_a < source_b").withColumn("difference", F.abs(F.col("value_a") - F.col("value_b"))).withColumn("relative", F.col("difference") / F.greatest(F.abs("value_a"), F.abs("value_b"), F.lit(1.0)))


def series_catalog(series: DataFrame, keys: list[str], value: str, grain: str, least: int = 8) -> DataFrame:
    """Per series: rows, periods, repeated periods, gaps, expected periods, completeness, and whether it is regular enough for analysis."""
    order = Window.partitionBy(*keys).orderBy("period_start")
    per_period = series.groupBy(*keys, "period_start").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    steps = per_period.withColumn("gap", F.datediff("period_start", F.lag("period_start").over(order)))
    out = steps.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("periods"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated_periods"), F.count_distinct("gap").alias("distinct_gaps"),
        F.min("period_start").alias("first_period"), F.max("period_start").alias("last_period"), F.avg(F.when(F.col("v") == 0, 1.0).otherwise(0.0)).alias("zero_rate"),
    )
    expected = expected_periods(F.col("first_period"), F.col("last_period"), grain) + (1 if grain == "week" else 0)
    out = out.withColumn("expected", expected).withColumn("completeness", F.col("periods") / F.col("expected"))
    regular = (F.col("repeated_periods") == 0) & (F.col("completeness") >= 0.8) & ((F.col("distinct_gaps") <= 2) | F.lit(grain in ("month", "quarter", "year")))
    return out.withColumn("regular", regular).withColumn("usable", regular & (F.col("periods") >= least))


def calendar_lags(series: DataFrame, keys: list[str], value: str, lags: tuple[int, ...] = (1, 2, 3, 6, 12)) -> DataFrame:
    """Value of exactly k calendar months before (null across gaps), the mean of the three months before, and whether all are there.

    Series with a repeated month are left out, as are rows with a null key.
    """
    counted = series.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*keys, "period_start")))
    clean = counted.withColumn("_m", F.max("_c").over(Window.partitionBy(*keys))).where("_m = 1").drop("_c", "_m")
    for k in keys:
        clean = clean.where(F.col(k).isNotNull())
    # months as numbers, so a range frame is exactly one calendar month wide
    month = F.year("period_start") * 12 + F.month("period_start")
    order = Window.partitionBy(*keys).orderBy(month)
    out = clean
    for k in lags:
        out = out.withColumn(f"lag_{k}", F.max(value).over(order.rangeBetween(-k, -k)))
    three = order.rangeBetween(-3, -1)
    out = out.withColumn("prior_3", F.when(F.count(value).over(three) == 3, F.avg(value).over(three)))
    complete = F.col("prior_3").isNotNull()
    for k in lags:
        complete &= F.col(f"lag_{k}").isNotNull()
    return out.withColumn("complete_history", complete)


def longest_runs(series: DataFrame, keys: list[str]) -> DataFrame:
    """Months with data, the longest run of consecutive months, and where it begins."""
    month = (F.year("period_start") * 12 + F.month("period_start")).alias("month")
    distinct = series.select(*keys, month).distinct()
    island = F.col("month") - F.row_number().over(Window.partitionBy(*keys).orderBy("month"))
    runs = distinct.withColumn("island", island).groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("length"), F.min("month").alias("start"))
    return runs.groupBy(*keys).agg(F.sum("length").alias("months"), F.max("length").alias("longest_run"), F.max(F.struct("length", (-F.col("start")).alias("s"))).alias("best")).select(*keys, "months", "longest_run", (-F.col("best.s")).alias("run_start"))


def month_spine(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every month from the first to the last of each series: the value, whether it is present, filled forward and interpolated.

    Repeated months are summed. Interpolation is linear between neighbours; forward fill looks only back.
    """
    base = series.groupBy(*keys, F.date_trunc("month", "period_start").cast("date").alias("period_start")).agg(F.sum(value).alias("value"))
    ends = base.groupBy(*keys).agg(F.min("period_start").alias("a"), F.max("period_start").alias("z"))
    spine = ends.select(*keys, F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("period_start"))
    joined = spine.join(base, [*keys, "period_start"], "left")
    month = F.year("period_start") * 12 + F.month("period_start")
    back = Window.partitionBy(*keys).orderBy("period_start").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("period_start").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.struct(month.alias("m"), F.col("value").alias("v")))
    out = joined.withColumn("prev", F.last(known, True).over(back)).withColumn("next", F.first(known, True).over(ahead)).withColumn("m", month)
    between = F.when(F.col("next.m") == F.col("prev.m"), F.col("value")).otherwise(F.col("prev.v") + (F.col("next.v") - F.col("prev.v")) * (F.col("m") - F.col("prev.m")) / (F.col("next.m") - F.col("prev.m")))
    return out.select(*keys, "period_start", "value", F.col("value").isNotNull().alias("present"), F.col("prev.v").alias("forward_filled"), between.alias("interpolated"))


def ewma(series: DataFrame, keys: list[str], value: str, alpha: float = 0.2) -> DataFrame:
    """Last exponentially weighted mean of each series, folded over its periods in order (periods bounded by the calendar)."""
    daily = series.groupBy(*keys, "period_start").agg(F.sum(value).alias("v"))
    ordered = daily.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("period_start", "v"))).alias("s"))
    first = F.col("s")[0]["v"].cast("double")
    folded = F.aggregate("s", first, lambda acc, x: acc * (1 - alpha) + x["v"].cast("double") * alpha)
    return ordered.select(*keys, F.size("s").alias("periods"), folded.alias("ewma"))


def seasonal_peak(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Calendar month of the highest mean (the earliest on ties), its mean, and its phase angle."""
    monthly = series.groupBy(*keys, F.month("period_start").alias("month")).agg(F.avg(value).alias("mean"))
    best = monthly.groupBy(*keys).agg(F.max(F.struct("mean", (-F.col("month")).alias("m"))).alias("b"))
    peak = -F.col("b.m")
    return best.select(*keys, peak.alias("peak_month"), F.col("b.mean").alias("peak_mean"), (2 * math.pi * (peak - 1) / 12).alias("phase"))


def variance_split(panel: DataFrame, place: str, value: str) -> DataFrame:
    """Shares of the variance of log(1 + value) between places, between periods, and left over."""
    logged = panel.select(place, "period_start", F.log1p(F.col(value).cast("double")).alias("x"))
    overall = logged.agg(F.avg("x").alias("g"), F.var_pop("x").alias("total"), F.count(F.lit(1)).alias("n"))
    out = None
    for name, key in (("space", place), ("time", "period_start")):
        part = logged.groupBy(key).agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("c")).agg((F.sum(F.col("c") * F.col("m") * F.col("m")) / F.sum("c") - F.pow(F.sum(F.col("c") * F.col("m")) / F.sum("c"), 2)).alias("between"))
        row = part.select(F.lit(name).alias("component"), "between")
        out = row if out is None else out.unionByName(row)
    return out.join(F.broadcast(overall.select("total")), F.lit(True)).select("component", F.when(F.col("total") > 0, F.col("between") / F.col("total")).alias("share"))


def year_before(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Each year with the value of exactly the year before; years without one are left out."""
    before = df.select(*keys, (F.col(year) + 1).alias(year), F.col(value).alias("before"))
    return df.select(*keys, year, value).join(before, [*keys, year]).withColumn("change", F.col(value) - F.col("before"))


def demand_class(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Zero rate, mean interval between non-zero periods, squared variation of their sizes, and the class by 1.32 and 0.49."""
    ordered = series.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy("period_start")))
    positive = ordered.where(F.col(value) > 0).withColumn("step", F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t")))
    size = positive.groupBy(*keys).agg(F.avg("step").alias("adi"), F.pow(F.stddev_pop(value) / F.avg(value), 2).alias("cv2"))
    zero = series.groupBy(*keys).agg(F.avg(F.when(F.col(value) == 0, 1.0).otherwise(0.0)).alias("zero_rate"))
    adi = F.coalesce("adi", F.lit(1.0))
    kind = F.when((adi < 1.32) & (F.col("cv2") < 0.49), "smooth").when((adi >= 1.32) & (F.col("cv2") < 0.49), "intermittent").when((adi < 1.32) & (F.col("cv2") >= 0.49), "erratic").otherwise("lumpy")
    return zero.join(size, keys, "left").select(*keys, "zero_rate", adi.alias("adi"), "cv2", kind.alias("demand"))


def readiness(panel: DataFrame, keys: list[str], place: str, value: str, population: Column) -> DataFrame:
    """Scores (0 to 100) of what a panel can be used for, from its periods, places, zeros and filled populations."""
    g = panel.groupBy(*keys).agg(
        F.count_distinct("period_start").alias("p"), F.count_distinct(place).alias("l"), F.avg(F.when(F.col(value) == 0, 1.0).otherwise(0.0)).alias("z"), F.avg(F.when(population.isNotNull(), 1.0).otherwise(0.0)).alias("pop"),
    )

    def full(c: str, of: int) -> Column:
        return F.least(F.col(c) / of, F.lit(1.0))

    scores = {
        "forecasting": 0.5 * full("p", 60) + 0.3 * (1 - F.col("z")) + 0.2 * full("l", 10),
        "transmission": 0.4 * full("p", 36) + 0.3 * full("l", 20) + 0.3 * F.col("pop"),
        "risk": 0.5 * full("l", 30) + 0.3 * full("p", 12) + 0.2 * F.col("pop"),
        "transfer": 0.5 * full("l", 20) + 0.5 * full("p", 36),
        "disaggregation": 0.5 * full("l", 50) + 0.3 * F.col("pop") + 0.2 * full("p", 24),
    }
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("use"), (100 * x).alias("score")) for n, x in scores.items()]))
    return g.select(*keys, listed.alias("s")).select(*keys, "s.use", "s.score")
