"""Queries of the general data-preparation operators over their whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import drift, intervals, spikes, units
from tidewell.operators import regular_grid as grid
from tidewell.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# Resolution words, as in functions.periods, for the SQL twins.
_GRAIN = """case when lower(trim({0})) in ('day','days','daily','harian','hari','d') then 'day'
 when lower(trim({0})) in ('week','weeks','weekly','epiweek','epi week','epi_week','mingguan','minggu','w') then 'week'
 when lower(trim({0})) in ('month','months','monthly','bulanan','bulan','m') then 'month'
 when lower(trim({0})) in ('quarter','quarters','quarterly','triwulan','triwulanan','kuartal','q') then 'quarter'
 when lower(trim({0})) in ('year','years','yearly','annual','annually','tahunan','tahun','y') then 'year' end"""


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: grid.missing_periods(table(s, d, "modeling_series")),
        "p1_regular_grid": lambda s, d: grid.regular_grid(table(s, d, "modeling_series")),
        "p1_grid_cells": lambda s, d: grid.regular_grid(table(s, d, "modeling_series")).select("source_id", "source_subunit", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), F.when(~F.col("is_filled"), F.col("value")).alias("value"), "is_filled"),
        "p2_found": lambda s, d: units.recorded_otherwise(table(s, d, "silver_observation"), table(s, d, "unit_reference")),
        "p2_units": lambda s, d: units.harmonise(table(s, d, "silver_observation"), table(s, d, "unit_reference")),
        "p3_found": lambda s, d: intervals.gaps(table(s, d, "silver_observation")),
        "p3_periods": lambda s, d: intervals.sweep(intervals.closed_intervals(table(s, d, "silver_observation"), "dataset_id")).withColumnRenamed("entity", "dataset_id"),
        "p4_found": lambda s, d: drift.schema_changes(table(s, d, "metadata_dataset"), table(s, d, "bronze_record")),
        "p4_unified_rows": lambda s, d: drift.unified_rows(table(s, d, "metadata_dataset"), table(s, d, "bronze_record")).select("bronze_record_id", "dataset_id", "dataset_name", "row_number", *[F.to_json(c).alias(c) for c in ("values", "unread", "others")]),
        "p4_unified_columns": lambda s, d: drift.unified_columns(table(s, d, "metadata_dataset"), table(s, d, "bronze_record")),
        "p5_found": lambda s, d: spikes.implausible_readings(table(s, d, "modeling_series")).select("observation_id"),
    }


def _closed(name: str) -> str:
    grain = _GRAIN.format("temporal_resolution")
    return f"""{name} as (select dataset_id, a, z from (select dataset_id, period_start a, coalesce(period_end, case {grain}
 when 'week' then period_start + 6 when 'month' then last_day(period_start)
 when 'quarter' then cast(date_trunc('quarter', period_start) + interval 3 month - interval 1 day as date)
 when 'year' then make_date(year(period_start), 12, 31) else period_start end) z from silver_observation) where z >= a)"""


def _spans() -> str:
    """Covered periods by the running latest end, another way than the sweep line."""
    return f"""with {_closed("i")},
m as (select *, max(z) over (partition by dataset_id order by a, z rows between unbounded preceding and 1 preceding) before from i),
g as (select *, sum(case when before is null or a > before + 1 then 1 else 0 end) over (partition by dataset_id order by a, z rows unbounded preceding) k from m),
c as (select dataset_id, k, min(a) a, max(z) z from g group by all),
n as (select *, lead(a) over (partition by dataset_id order by a) follows from c)"""


def _unit_sql() -> str:
    """The unit of every observation, with the fixed spellings as an inline table."""

    def quote(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    alias = ", ".join(f"({quote(q)}, {quote(n)}, {quote(code)})" for (q, code), names in units.UNIT_NAMES.items() for n in names)
    metric = ", ".join(f"({quote(n)}, {quote(q)})" for q, names in units.QUANTITY_NAMES.items() for n in names)
    pattern = units.METRIC.replace("'", "''")

    def spelled(x: str) -> str:
        y = f"regexp_replace(lower({x}), '[\\s_\u00a0]+', ' ', 'g')"
        for _ in range(2):  # no look-around here: digits that touch two separators need a second pass
            y = f"regexp_replace({y}, '([0-9])[., ]([0-9]{{3}})', '\\1\\2', 'g')"
        return f"nullif(rtrim(regexp_replace(trim({y}), '\\.$', '')), '')"

    return f"""with alias(quantity, spelling, code) as (values {alias}), metrics(name, quantity) as (values {metric}),
o as (select silver_observation_id, value_numeric vn, coalesce(value_numeric, try_cast(replace(regexp_extract(value_text, '(-?[0-9][0-9.,]*)', 1), ',', '.') as double)) v, m.quantity, {spelled("unit")} u1,
  {spelled("regexp_extract(value_text, '^[^0-9]*[0-9][0-9.,]*\\s*(.*)$', 1)")} u2,
  {spelled("regexp_extract(json_extract_string(provenance, '$.source_record.note'), '(?i)^\\s*(?:unit of measure|unit|satuan|angka dalam)\\s*:\\s*(.*)$', 1)")} u3,
  {spelled(f"regexp_extract(lower(trim(metric)), '{pattern}', 2)")} u4
  from silver_observation left join metrics m on m.name = regexp_extract(lower(trim(metric)), '{pattern}', 1)),
n as (select o.*, coalesce(a1.code, a2.code, a3.code, a4.code) code,
  case when a1.code is not null then 'field' when a2.code is not null then 'text' when a3.code is not null then 'note' when a4.code is not null then 'metric' end origin from o
  left join alias a1 on a1.quantity = o.quantity and a1.spelling = u1 left join alias a2 on a2.quantity = o.quantity and a2.spelling = u2
  left join alias a3 on a3.quantity = o.quantity and a3.spelling = u3 left join alias a4 on a4.quantity = o.quantity and a4.spelling = u4),
s as (select *, case when code is not null or v is null or not isfinite(v) or v = 0 then null
  when quantity = 'cases' and v <> round(v) then 'thousand_cases'
  when quantity = 'mean_temperature' and not v between -40 and 50 then case when (v - 32) / 1.8 between -40 and 50 then 'fahrenheit' when v - 273.15 between -40 and 50 then 'kelvin' end
  when quantity = 'area' and v > 2e6 then case when abs(ln(v * 0.01 / 500)) < abs(ln(v * 0.000001 / 500)) and v * 0.01 <= 2e6 then 'ha' else 'm2' end
  when quantity = 'population' and v > 0 and v < 5000 then case when v * 1e3 >= 5000 and (v * 1e6 > 1e9 or abs(ln(v * 1e3 / 1e5)) <= abs(ln(v * 1e6 / 1e5))) then 'thousand_people' when v * 1e6 >= 5000 then 'million_people' end
  when quantity = 'larva_free_index' and v > 0 and v < 1 then case when v >= 0.01 then 'proportion' end
  when quantity = 'larva_free_index' and v > 100 and v <= 1000 then 'per_mille' end sized from n),
f as (select s.silver_observation_id, s.quantity, v, vn, c.common_unit, coalesce(code, sized, c.common_unit) unit_code,
  coalesce(origin, case when sized is not null then 'size' when s.quantity is not null then 'default' end) unit_origin
  from s left join (select distinct quantity, common_unit from unit_reference) c on c.quantity = s.quantity)"""


def _grid_sql() -> str:
    """Periods with (u) and without (e) usable readings, by the resolution most rows of a series state."""
    return f"""with r as (select source_id, source_subunit, period_start, value, published_at, {_GRAIN.format("temporal_resolution_normalized")} g from modeling_series),
n as (select source_id, source_subunit, g, count(*) c from r where g is not null group by all),
v as (select source_id, source_subunit, g, row_number() over (partition by source_id, source_subunit
        order by c desc, case g when 'day' then 1 when 'week' then 2 when 'month' then 3 when 'quarter' then 4 else 5 end) k from n),
u as (select distinct r.source_id, r.source_subunit, v.g, cast(date_trunc(v.g, r.period_start) as date) p
      from r join v on v.k = 1 and v.source_id is not distinct from r.source_id and v.source_subunit is not distinct from r.source_subunit
      where cast(r.value as varchar) <> 'nan' and r.period_start is not null),
b as (select source_id, source_subunit, g, min(p) a, max(p) z from u group by all),
e as (select source_id, source_subunit, cast(unnest(generate_series(cast(a as timestamp), cast(z as timestamp),
        case g when 'day' then interval 1 day when 'week' then interval 7 day when 'month' then interval 1 month when 'quarter' then interval 3 month else interval 1 year end)) as date) p from b)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_grid_cells": _grid_sql() + """, w as (select r.source_id, r.source_subunit, cast(date_trunc(v.g, r.period_start) as date) p, first(r.value order by r.published_at desc nulls last, r.period_start desc, r.value desc) as value
 from r join v on v.k = 1 and v.source_id is not distinct from r.source_id and v.source_subunit is not distinct from r.source_subunit where cast(r.value as varchar) <> 'nan' and r.period_start is not null group by 1, 2, 3)
select e.source_id, e.source_subunit, strftime(e.p, '%Y-%m-%d') as period_start, w.value, w.p is null as is_filled from e left join w on w.source_id is not distinct from e.source_id and w.source_subunit is not distinct from e.source_subunit and w.p = e.p""",
        "p2_found": _unit_sql() + " select silver_observation_id, unit_code from f where vn is not null and unit_code <> common_unit",
        "p2_units": _unit_sql() + """ select f.silver_observation_id, f.quantity, f.unit_code, f.unit_origin, f.common_unit, v * r.factor + r.shift as value_common
from f left join unit_reference r on r.quantity = f.quantity and r.unit_code = f.unit_code""",
        "p3_found": _spans() + " select dataset_id, strftime(z + 1, '%Y-%m-%d') as gap_start, strftime(follows - 1, '%Y-%m-%d') as gap_end from n where follows is not null",
        "p3_periods": _spans() + """ select dataset_id, 'covered' as kind, a as first_day, z as last_day from c
union all select dataset_id, 'gap', z + 1, follows - 1 from n where follows is not null""",
        "p1_found": _grid_sql() + """
select e.source_id, e.source_subunit, strftime(e.p, '%Y-%m-%d') as period_start from e
where not exists (select 1 from u where u.source_id is not distinct from e.source_id and u.source_subunit is not distinct from e.source_subunit and u.p = e.p)""",
    }
