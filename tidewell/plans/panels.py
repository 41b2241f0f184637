"""Queries of the panel layer: orders by place and month stand in for reported cases; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import panel as p
from tidewell.sources.tables import table


def cases(s: SparkSession, d: str) -> DataFrame:
    """Orders as native monthly cases: region over nation over segment, with a population that depends on the nation."""
    orders = table(s, d, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").cast("date").alias("period_start"), "o_totalprice")
    customer = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    nation = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    rows = orders.join(customer, "o_custkey").join(nation, "n_nationkey")
    return rows.groupBy("region", "nation", "segment", "period_start", "n_nationkey").agg(F.count(F.lit(1)).alias("cases"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


def native(s: SparkSession, d: str) -> DataFrame:
    return cases(s, d).select(
        F.lit("all").alias("admin_0"), F.col("region").alias("admin_1"), F.col("nation").alias("admin_2"), F.col("segment").alias("admin_3"), "period_start",
        F.col("cases").cast("double").alias("cases"), (F.lit(100000.0) + 10000 * F.col("n_nationkey")).alias("population"),
    )


def by_nation(s: SparkSession, d: str) -> DataFrame:
    return cases(s, d).groupBy("nation", "period_start").agg(F.sum("cases").cast("double").alias("cases"))


def by_segment(s: SparkSession, d: str) -> DataFrame:
    return cases(s, d).select("nation", "segment", "period_start", F.col("cases").cast("double").alias("cases"))


KEYS = ["nation", "segment"]


def queries() -> dict:
    return {
        "multiscale_rollup": lambda s, d: p.multiscale(native(s, d), F.lit("admin3"), F.lit("month")),
        "grain_inventory": lambda s, d: p.inventory(p.multiscale(native(s, d), F.lit("admin3"), F.lit("month")), ["space", "time"], "admin_2", "cases"),
        "coverage_expected_periods": lambda s, d: p.coverage(by_segment(s, d), KEYS, "month"),
        "coverage_weeks": lambda s, d: p.coverage(table(s, d, "events").select("event_type", F.date_trunc("week", "ts").cast("date").alias("period_start")), ["event_type"], "week"),
        "quality_counters": lambda s, d: p.quality_counters(table(s, d, "modeling_series"), ["source_id", "source_subunit", "period_start"], "value"),
        "cross_source_pairs": lambda s, d: p.pair_differences(
            table(s, d, "modeling_series").where("not isnan(value)").groupBy("metric", F.year("period_start").alias("year"), "source_id").agg(F.round(F.sum("value"), 6).alias("total")), ["metric", "year"], "source_id", "total"
        ),
        "series_catalog": lambda s, d: p.series_catalog(by_segment(s, d), KEYS, "cases", "month"),
        "calendar_lags": lambda s, d: p.calendar_lags(by_segment(s, d), KEYS, "cases"),
        "longest_run_islands": lambda s, d: p.longest_runs(by_segment(s, d), KEYS),
        "forward_fill_spine": lambda s, d: p.month_spine(by_segment(s, d), KEYS, "cases").select(*KEYS, "period_start", "value", "present", "forward_filled"),
        "interpolate_linear": lambda s, d: p.month_spine(by_segment(s, d), KEYS, "cases").select(*KEYS, "period_start", F.round("interpolated", 9).alias("interpolated")),
        "ewma_fold": lambda s, d: p.ewma(by_nation(s, d), ["nation"], "cases"),
        "seasonal_peak_phase": lambda s, d: p.seasonal_peak(by_nation(s, d), ["nation"], "cases"),
        "variance_decomposition": lambda s, d: p.variance_split(by_nation(s, d), "nation", "cases").withColumn("share", F.round("share", 9)),
        "year_over_year": lambda s, d: p.year_before(by_nation(s, d).groupBy("nation", F.year("period_start").alias("year")).agg(F.sum("cases").alias("cases")), ["nation"], "year", "cases"),
        "demand_class": lambda s, d: p.demand_class(p.month_spine(by_segment(s, d), KEYS, "cases").withColumn("value", F.coalesce("value", F.lit(0.0))), KEYS, "value"),
        "readiness_scores": lambda s, d: p.readiness(native(s, d), ["admin_1"], "admin_2", "cases", F.col("population")).withColumn("score", F.round("score", 9)),
        "location_labels": lambda s, d: table(s, d, "silver_observation").select(
            "silver_observation_id", p.location_label(["admin_0", "admin_1", "admin_2", "admin_3"]).alias("label"), p.location_path(["admin_0", "admin_1", "admin_2", "admin_3", "facility_name"]).alias("path")
        ),
        "resolution_resolve": lambda s, d: table(s, d, "silver_observation").select("silver_observation_id", p.resolve_resolution(F.col("temporal_resolution"), F.col("period_start"), F.col("period_end")).alias("resolution")),
        "valid_cases": lambda s, d: p.valid_cases(table(s, d, "modeling_series"), "period_start", "value").groupBy("metric").agg(F.count(F.lit(1)).alias("rows")),
        "wide_year_melt": lambda s, d: p.melt_years(p.by_years(by_nation(s, d), ["nation"], "cases"), ["nation"], "cases"),
        "coverage_matrix": lambda s, d: p.coverage_cells(table(s, d, "modeling_series"), "metric", "temporal_resolution_normalized"),
        "top_series": lambda s, d: table(s, d, "modeling_series").groupBy("source_id", "source_subunit").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "source_id", "source_subunit").limit(25),
    }


_CASES = """c as (select r_name region, n_name nation, c_mktsegment segment, n_nationkey, cast(date_trunc('month', o_orderdate) as date) period_start, count(*) cases
 from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all),
n as (select nation, period_start, cast(sum(cases) as double) cases from c group by all),
g as (select nation, segment, period_start, cast(cases as double) cases from c)"""
_ROLL = f"""{_CASES}, levels(space, depth) as (values ('admin0', 1), ('admin1', 2), ('admin2', 3), ('admin3', 4)), times("time") as (values ('month'), ('quarter'), ('year')),
m as (select 'admin3' native_space, 'month' native_time, space, "time", 'all' admin_0, case when depth > 1 then region end admin_1, case when depth > 2 then nation end admin_2, case when depth > 3 then segment end admin_3,
 cast(date_trunc("time", period_start) as date) period_start, cast(sum(cases) as double) cases, sum(100000.0::double + 10000 * n_nationkey) population, count(*) as "rows" from c, levels, times group by all)"""
_SPINE = f"""{_CASES}, e as (select nation, segment, min(period_start) a, max(period_start) z from g group by all),
s as (select nation, segment, cast(unnest(generate_series(cast(a as timestamp), cast(z as timestamp), interval 1 month)) as date) period_start from e),
f as (select s.*, g.cases as value, year(s.period_start) * 12 + month(s.period_start) m from s left join g using (nation, segment, period_start)),
w as (select *, last_value(value ignore nulls) over b pv, last_value(case when value is not null then m end ignore nulls) over b pm, first_value(value ignore nulls) over h nv, first_value(case when value is not null then m end ignore nulls) over h nm from f
 window b as (partition by nation, segment order by period_start rows unbounded preceding), h as (partition by nation, segment order by period_start rows between current row and unbounded following))"""
_WORD = "case when {0} in ('day','days','daily','harian','hari','d') then 'day' when {0} in ('week','weeks','weekly','epiweek','epi week','epi_week','mingguan','minggu','w') then 'week' when {0} in ('month','months','monthly','bulanan','bulan','m') then 'month' when {0} in ('quarter','quarters','quarterly','triwulan','triwulanan','kuartal','q') then 'quarter' when {0} in ('year','years','yearly','annual','annually','tahunan','tahun','y') then 'year' end"


def oracle_sql() -> dict[str, str]:
    lags = ", ".join(f"max(cases) over (partition by nation, segment order by m range between {k} preceding and {k} preceding) as lag_{k}" for k in (1, 2, 3, 6, 12))
    return {
        "multiscale_rollup": f"""with {_ROLL} select *, case "time" when 'month' then last_day(period_start) when 'quarter' then cast(period_start + interval 3 month - interval 1 day as date) else make_date(year(period_start), 12, 31) end as period_end, cases / population * 100000.0 as incidence_per_100k from m""",
        "grain_inventory": f"""with {_ROLL} select space, "time", count(*) as "rows", count(distinct admin_2) as places, count(distinct period_start) as periods, min(period_start) as first_period, max(period_start) as last_period, sum(cases) as total, 1.0::double as filled_share from m group by all""",
        "coverage_expected_periods": f"with {_CASES}, a as (select nation, segment, count(distinct period_start) as observed, min(period_start) as first_period, max(period_start) as last_period from g group by all) select *, datediff('month', first_period, last_period) + 1 as expected, observed / (datediff('month', first_period, last_period) + 1) as completeness from a",
        "coverage_weeks": "with a as (select event_type, count(distinct date_trunc('week', ts)) as observed, cast(min(date_trunc('week', ts)) as date) as first_period, cast(max(date_trunc('week', ts)) as date) as last_period from events group by 1) select *, (last_period - first_period) // 7 as expected, case when last_period > first_period then observed / ((last_period - first_period) // 7) end as completeness from a",
        "quality_counters": """with t as (select *, count(*) over (partition by source_id, source_subunit, period_start) k from modeling_series),
a as (select count(*) n, count(*) filter (value is null or cast(value as varchar) = 'nan') c1, count(*) filter (value < 0) c2, count(*) filter (cast(value as varchar) <> 'nan' and value <> floor(value)) c3, count(*) filter (value = 0) c4, count(*) filter (period_start is null) c5, count(*) filter (k > 1) c6 from t),
b as (select unnest(['value_missing', 'value_negative', 'value_fractional', 'value_zero', 'date_missing', 'key_repeated']) check_name, unnest([c1, c2, c3, c4, c5, c6]) failing, n as "rows" from a) select *, failing / "rows" as rate from b""",
        "cross_source_pairs": """with t as (select metric, year(period_start) as year, source_id, round(sum(value), 6) total from modeling_series where isfinite(value) group by all)
select a.metric, a.year, a.source_id as source_a, b.source_id as source_b, a.total as value_a, b.total as value_b, abs(a.total - b.total) as difference, abs(a.total - b.total) / greatest(abs(a.total), abs(b.total), 1.0) as relative from t a join t b on a.metric = b.metric and a.year = b.year and a.source_id < b.source_id""",
        "series_catalog": f"""with {_CASES}, q as (select *, period_start - lag(period_start) over (partition by nation, segment order by period_start) gap from g),
a as (select nation, segment, count(*) as "rows", count(*) as periods, 0 as repeated_periods, count(distinct gap) as distinct_gaps, min(period_start) as first_period, max(period_start) as last_period, 0.0::double as zero_rate from q group by all),
b as (select *, datediff('month', first_period, last_period) + 1 as expected from a) select *, periods / expected as completeness, periods / expected >= 0.8 as regular, periods / expected >= 0.8 and periods >= 8 as usable from b""",
        "calendar_lags": f"""with {_CASES}, x as (select *, year(period_start) * 12 + month(period_start) m from g),
y as (select nation, segment, period_start, cases, {lags}, case when count(cases) over t = 3 then avg(cases) over t end as prior_3 from x window t as (partition by nation, segment order by m range between 3 preceding and 1 preceding))
select *, prior_3 is not null and lag_1 is not null and lag_2 is not null and lag_3 is not null and lag_6 is not null and lag_12 is not null as complete_history from y""",
        "longest_run_islands": f"""with {_CASES}, x as (select nation, segment, year(period_start) * 12 + month(period_start) m from g), i as (select *, m - row_number() over (partition by nation, segment order by m) k from x),
r as (select nation, segment, k, count(*) n, min(m) a from i group by all), o as (select *, row_number() over (partition by nation, segment order by n desc, a) o, sum(n) over (partition by nation, segment) ms from r) select nation, segment, ms as months, n as longest_run, a as run_start from o where o = 1""",
        "forward_fill_spine": f"with {_SPINE} select nation, segment, period_start, value, value is not null as present, pv as forward_filled from w",
        "interpolate_linear": f"with {_SPINE} select nation, segment, period_start, round(case when nm = pm then value else pv + (nv - pv) * (m - pm) / (nm - pm) end, 9) as interpolated from w",
        "ewma_fold": f"with {_CASES}, o as (select *, row_number() over (partition by nation order by period_start) t, count(*) over (partition by nation) k from n) select nation, max(k) as periods, sum(cases * case when t = 1 then power(0.8::double, k - 1) else 0.2::double * power(0.8::double, k - t) end) as ewma from o group by nation",
        "seasonal_peak_phase": f"with {_CASES}, q as (select nation, month(period_start) mo, avg(cases) a from n group by all), o as (select *, row_number() over (partition by nation order by a desc, mo) k from q) select nation, mo as peak_month, a as peak_mean, 2 * pi() * (mo - 1) / 12 as phase from o where k = 1",
        "variance_decomposition": f"""with {_CASES}, l as (select nation, period_start, ln(1 + cases) x from n), t as (select var_pop(x) v, avg(x) a from l),
s as (select 'space' component, avg((m - a) * (m - a)) b from (select avg(x) over (partition by nation) m, a from l, t)), u as (select 'time' component, avg((m - a) * (m - a)) b from (select avg(x) over (partition by period_start) m, a from l, t))
select component, round(b / v, 9) as share from (select * from s union all select * from u), t""",
        "year_over_year": f"with {_CASES}, y as (select nation, year(period_start) as year, sum(cases) as cases from n group by all) select a.nation, a.year, a.cases, b.cases as before, a.cases - b.cases as change from y a join y b on a.nation = b.nation and a.year = b.year + 1",
        "demand_class": f"""with {_SPINE}, v as (select nation, segment, period_start, coalesce(value, 0.0) x, row_number() over (partition by nation, segment order by period_start) t from f),
o as (select *, t - lag(t) over (partition by nation, segment order by t) step from v where x > 0), z as (select nation, segment, avg(case when x = 0 then 1.0 else 0.0 end) zero_rate from v group by all),
a as (select nation, segment, coalesce(avg(step), 1.0) adi, power(stddev_pop(x) / avg(x), 2) cv2 from o group by all)
select nation, segment, zero_rate, adi, cv2, case when adi < 1.32 and cv2 < 0.49 then 'smooth' when adi >= 1.32 and cv2 < 0.49 then 'intermittent' when adi < 1.32 and cv2 >= 0.49 then 'erratic' else 'lumpy' end as demand from z join a using (nation, segment)""",
        "readiness_scores": f"""with {_CASES}, a as (select region admin_1, count(distinct period_start) p, count(distinct nation) l, 0.0::double z, 1.0::double pop from c group by 1)
select admin_1, 'forecasting' as use, round(100 * (0.5::double * least(p / 60, 1) + 0.3::double * (1 - z) + 0.2::double * least(l / 10, 1)), 9) as score from a union all select admin_1, 'transmission', round(100 * (0.4::double * least(p / 36, 1) + 0.3::double * least(l / 20, 1) + 0.3::double * pop), 9) from a
union all select admin_1, 'risk', round(100 * (0.5::double * least(l / 30, 1) + 0.3::double * least(p / 12, 1) + 0.2::double * pop), 9) from a union all select admin_1, 'transfer', round(100 * (0.5::double * least(l / 20, 1) + 0.5::double * least(p / 36, 1)), 9) from a
union all select admin_1, 'disaggregation', round(100 * (0.5::double * least(l / 50, 1) + 0.3::double * pop + 0.2::double * least(p / 24, 1)), 9) from a""",
        "location_labels": """select silver_observation_id, nullif(concat_ws(' | ', nullif(case when trim(admin_0) <> '' then admin_0 end, ''), case when trim(admin_1) <> '' then admin_1 end, case when trim(admin_2) <> '' then admin_2 end, case when trim(admin_3) <> '' then admin_3 end), '') as label,
coalesce(nullif(array_to_string(list_reduce(list_prepend([], list_transform(list_filter([trim(admin_0), trim(admin_1), trim(admin_2), trim(admin_3), trim(facility_name)], lambda x: x is not null and x <> ''), lambda x: [x])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end), ' | '), ''), 'Unspecified') as path from silver_observation""",
        "resolution_resolve": "select silver_observation_id, coalesce(" + _WORD.format("lower(trim(temporal_resolution))") + ", case when period_end - period_start + 1 is null then null when period_end - period_start + 1 <= 1 then 'day' when period_end - period_start + 1 <= 8 then 'week' when period_end - period_start + 1 <= 32 then 'month' when period_end - period_start + 1 <= 92 then 'quarter' else 'year' end) as resolution from silver_observation",
        "valid_cases": 'select metric, count(*) as "rows" from modeling_series where period_start is not null and isfinite(value) and value >= 0 group by 1',
        "wide_year_melt": f"with {_CASES} select nation, cast(year(period_start) as varchar) as year, sum(cases) as cases from n group by all",
        "coverage_matrix": """with q as (select metric, coalesce(temporal_resolution_normalized, '') as word, count(*) as "rows" from modeling_series group by 1, 2), m as (select distinct metric from q), w as (select distinct word from q)
select m.metric, w.word, coalesce(q."rows", 0) as "rows" from m, w left join q on q.metric is not distinct from m.metric and q.word = w.word""",
        "top_series": 'select source_id, source_subunit, count(*) as "rows" from modeling_series group by 1, 2 order by 3 desc, 1, 2 limit 25',
    }
