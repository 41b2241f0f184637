"""Queries of normalisation, audits and comparisons over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import audits as a
from tidewell.operators import medallion
from tidewell.operators import normalise as n
from tidewell.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# The columns of a canonical panel and their types.
PANEL = {"observation_key": "string", "province": "string", "district": "string", "year": "int", "metric": "string", "value": "double", "population": "double", "native_record": "boolean", "retrieved_at": "timestamp"}
KEY = ["province", "year", "metric"]


def _panel(s: SparkSession, d: str) -> DataFrame:
    blanks = r"^[\s\u00a0]+|[\s\u00a0]+$"
    status = F.regexp_replace(F.lower("quality_status"), blanks, "")
    return table(s, d, "research_panel_observation").select("observation_key", F.regexp_replace(F.lower("province"), blanks, "").alias("province"), "year", "metric", F.nanvl("value", F.lit(None).cast("double")).alias("value"), status.alias("status"))


def _silver(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "silver_observation")


def _titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "metadata_dataset").select("dataset_id", F.col("dataset_name").alias("title"))


def _checks() -> dict[str, Column]:
    stated = {"place": "admin_1", "facility": "facility_name", "unit": "unit", "sex": "sex", "species": "species", "definition": "case_definition"}
    return {"value": F.col("value_numeric").isNotNull(), "period": F.col("period_start").isNotNull() & F.col("period_end").isNotNull(), **{k: a.stated(c) for k, c in stated.items()}}


def _levels() -> dict[str, Column]:
    return {f"admin{k}": F.col(f"admin_{k}") for k in range(1, 5)}


def _sex() -> Column:
    word = F.lower(F.trim("sex"))
    return F.when(word.isin("male", "m", "laki-laki", "l"), "male").when(word.isin("female", "f", "perempuan", "p"), "female")


def _abstracts(s: SparkSession, d: str) -> DataFrame:
    """Abstracts taken apart into inverted indexes and put together again."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    index = F.transform(F.array_distinct("words"), lambda w: F.struct(w, F.filter(F.transform("words", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())))
    split = table(s, d, "documents").where("doc_type = 'abstract'").select("doc_id", words.alias("words"))
    return split.select("doc_id", n.restored_text(F.map_from_entries(index)).alias("abstract"))


def queries() -> dict[str, Query]:
    return {
        "canonical_columns": lambda s, d: n.canonical(table(s, d, "research_panel_observation"), PANEL, {"native_record": True}),
        "measure_columns": lambda s, d: n.measure_columns(table(s, d, "bronze_record")).withColumn("numeric_share", F.round("numeric_share", 9)),
        "measure_sums": lambda s, d: n.measure_sums(table(s, d, "bronze_record")).withColumn("total", F.round("total", 6)),
        "canonical_rows": lambda s, d: n.canonical_rows(table(s, d, "bronze_record"), _titles(s, d)),
        "admin_levels": lambda s, d: _silver(s, d).select("silver_observation_id", n.admin_level(F.col("spatial_resolution"), _levels()).alias("admin_level")),
        "count_faults": lambda s, d: _silver(s, d).select(F.coalesce(n.count_fault(F.col("value_numeric")), F.lit("none")).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("rows")),
        "restored_abstracts": _abstracts,
        "safe_ids": lambda s, d: table(s, d, "modeling_series").select(n.safe_id(F.concat_ws("/", "source_id", "source_subunit")).alias("panel_id")).distinct(),
        "quality_summary": lambda s, d: a.quality_summary(_silver(s, d), ["disease", "metric", "spatial_resolution", "temporal_resolution"], "period_start", "period_end", "value_numeric", "dataset_id", "source_id"),
        "usable_proportions": lambda s, d: a.usable_shares(_silver(s, d), "silver_observation", _checks()),
        "occurrence_summary": lambda s, d: a.occurrence_summary(_silver(s, d), "species", a.stated("admin_2"), "period_start", "dataset_id"),
        "complete_totals": lambda s, d: a.complete_totals(_silver(s, d), ["dataset_id", "metric", "period_start"], _sex(), ["male", "female"], "value_numeric").withColumn("total", F.round("total", 6)),
        "key_coverage": lambda s, d: a.key_coverage(table(s, d, "modeling_series"), "source_id", ["source_subunit", "period_start"], "period_start"),
        "baseline_verdicts": lambda s, d: a.verdicts(_panel(s, d).where("status = 'conflict'").drop("status"), _panel(s, d).where("status = 'valid'"), KEY, "value"),
        "baseline_merge": lambda s, d: a.merge_one(
            _panel(s, d).drop("status"),
            a.verdicts(_panel(s, d).where("status = 'conflict'").select(*KEY, "value"), _panel(s, d).where("status = 'valid'"), KEY, "value").where("value is not null").distinct(),
            [*KEY, "value"],
        ).select("observation_key", "baseline_match"),
        "conflict_flags": lambda s, d: a.conflicts(_panel(s, d), KEY, "value").select("observation_key", "conflict"),
        "series_inputs": lambda s, d: a.series_inputs(table(s, d, "modeling_series"), table(s, d, "metadata_dataset"), table(s, d, "metadata_source")),
        "candidate_cells": lambda s, d: a.candidate_cells(table(s, d, "bronze_record")),
        "largest_panel": lambda s, d: a.largest(table(s, d, "modeling_series"), ["metric"], ["source_id", "source_subunit"]),
        "common_places": lambda s, d: _silver(s, d).select(F.col("admin_1").alias("place")).intersect(table(s, d, "place_reference").where("place_level = 'admin_1'").select(F.col("place_name").alias("place"))),
        "aligned_union": lambda s, d: table(s, d, "metadata_source").select("source_id", "source_name", "license_name").unionByName(table(s, d, "metadata_dataset").select("source_id", "dataset_name", "row_count"), allowMissingColumns=True),
        "best_representation": lambda s, d: medallion.best_representation(
            _silver(s, d), ["dataset_id", "metric", "admin_1", "period_start"], [F.col("value_numeric").isNotNull().cast("int"), F.col("processed_at")], ["silver_observation_id"]
        ).select("dataset_id", "metric", "admin_1", "period_start", F.col("best.silver_observation_id").alias("silver_observation_id"), "representations"),
        "delivery_rows": lambda s, d: a.delivered(_silver(s, d).select("silver_observation_id", "metric", "value_numeric", "privacy_class", "provenance"), F.col("value_numeric").isNull() | (F.lower("privacy_class") != "aggregate"), ["privacy_class", "provenance"]),
    }


_PANEL = "p as (select observation_key, regexp_replace(lower(province), '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g') province, year, metric, case when cast(value as varchar) = 'nan' then null else value end as value, regexp_replace(lower(quality_status), '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g') status from research_panel_observation)"
_NAME = "regexp_replace(lower(trim({0})), '\\s+', '_', 'g')"
_CELLS = f"""cells as (select bronze_record_id, dataset_id, row_number, payload, list_transform(json_keys(payload), lambda k: {{'name': {_NAME.format("k")}, 'text': nullif(trim(json_extract_string(payload, '$."' || k || '"')), '')}}) e from bronze_record),
each as (select bronze_record_id, dataset_id, unnest(e, recursive := true) from cells)"""


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _first(kind: str) -> str:
    return "coalesce(" + ", ".join(f"list_filter(e, lambda x: regexp_matches(x.name, {_quote(p)}) and x.text is not null)[1].text" for p in n.COLUMN_PATTERNS[kind]) + ")"


def _number(x: str) -> str:
    return f"try_cast(replace({x}, ',', '.') as double)"


def _rows() -> str:
    """The canonical rows, cell by cell, with the rules as one CASE."""
    taken = "|".join(f"({p})" for k in n.COLUMN_PATTERNS for p in n.COLUMN_PATTERNS[k])
    rules = " ".join(f"when regexp_matches(name, {_quote(p)}) then " + ("name" if m is None else f"disease || {_quote(m[2:])}" if m.startswith("{}") else _quote(m)) for p, m in n.METRIC_RULES)
    woman = "regexp_matches(lower({0}), 'perempuan|wanita|female')"
    sex = lambda x: f"case when regexp_matches(lower({x}), 'total|seluruh|laki_laki_dan_perempuan') then 'all' when regexp_matches(lower({x}), 'laki|pria|male') and not {woman.format(x)} then 'male' when {woman.format(x)} then 'female' end"
    species = lambda x: "case " + " ".join(f"when contains(lower({x}), '{k}') then 'Plasmodium {k}'" for k in n.SPECIES) + " end"
    return f"""with {_CELLS},
w as (select bronze_record_id, cells.dataset_id, e, {_first("admin_1")} admin_1, coalesce({_first("admin_2")}, nullif(trim(regexp_extract(dataset_name, '\\b((?:Kabupaten|Kota)\\s+[A-Za-z][A-Za-z .''-]+?)(?:\\s+Tahun|\\s+20\\d{{2}}|$)', 1)), '')) admin_2,
 {_first("admin_3")} admin_3, {_first("admin_4")} admin_4, {_first("facility_name")} facility_name, try_cast(regexp_extract({_first("day")}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) as date) d,
 cast(trunc({_number(_first("year"))}) as integer) y, cast(trunc({_number(_first("month"))}) as integer) m, cast(trunc({_number(_first("week"))}) as integer) k, lower(coalesce({_first("disease")}, 'unknown')) disease, {_first("sex")} rs, {_first("species")} rp, {_first("unit")} ru
 from cells left join metadata_dataset md on md.dataset_id = cells.dataset_id),
v as (select *, case when d is not null then 'day' when y between 1900 and 2100 and k between 1 and 53 then 'week' when y between 1900 and 2100 and m between 1 and 12 then 'month' when y between 1900 and 2100 then 'year' end grain from w),
z as (select * exclude (e), unnest(e, recursive := true) from v),
f as (select *, {_number("text")} as value from z where not regexp_matches(name, {_quote(taken)}) and not regexp_matches(name, {_quote(n.DESCRIPTORS)})),
g as (select *, case {rules} when name <> '' then name else disease || '_value' end as metric from f where value is not null),
wk as (select *, cast(date_trunc('week', make_date(y, 1, 4)) as date) + 7 * (k - 1) ws from g)
select bronze_record_id, dataset_id, admin_1, admin_2, admin_3, admin_4, facility_name, case grain when 'day' then d when 'week' then ws when 'month' then make_date(y, m, 1) when 'year' then make_date(y, 1, 1) end as period_start,
 case grain when 'day' then d when 'week' then ws + 6 when 'month' then last_day(make_date(y, m, 1)) when 'year' then make_date(y, 12, 31) end as period_end, grain as temporal_resolution, disease, metric,
 coalesce({sex("name")}, {sex("rs")}) as sex, coalesce({species("name")}, {species("rp")}) as species, coalesce(ru, case when regexp_matches(metric, 'rate|percent|persentase|index') then 'percent' else 'count' end) as unit, value from wk"""


def oracle_sql() -> dict[str, str]:
    measures = f"""{_CELLS}, r as (select dataset_id, count(*) k from bronze_record group by 1),
c as (select dataset_id, name as column_name, count({_number("text")}) v from each where regexp_matches(name, '{n.MEASURE_NAMES}') and not regexp_matches(name, '{n.NO_MEASURE_NAMES}') group by 1, 2),
mc as (select dataset_id, column_name, v / k as numeric_share from c join r using (dataset_id) where v / k >= 0.25)"""
    dims = {"value": "value_numeric is not null", "period": "period_start is not null and period_end is not null", "place": "trim(admin_1) <> ''", "facility": "trim(facility_name) <> ''", "unit": "trim(unit) <> ''", "sex": "trim(sex) <> ''", "species": "trim(species) <> ''", "definition": "trim(case_definition) <> ''"}
    given = "regexp_replace(lower(spatial_resolution), '[^0-9a-z]', '', 'g')"
    verdict = "case when exists (select 1 from b where b.province = c.province and b.year = c.year and b.metric = c.metric and b.value = c.value) then 'same_count_present' when exists (select 1 from b where b.province = c.province and b.year = c.year and b.metric = c.metric) then 'different_count_present' else 'no_exact_match' end"
    cited = f"with {_PANEL}, b as (select * from p where status = 'valid' and value is not null), c as (select * from p where status = 'conflict')"
    return {
        "canonical_columns": "select observation_key, province, cast(null as varchar) as district, year, metric, value, cast(null as double) as population, true as native_record, retrieved_at from research_panel_observation",
        "measure_columns": f"with {measures} select dataset_id, column_name, round(numeric_share, 9) as numeric_share from mc",
        "measure_sums": f"with {measures} select bronze_record_id, round(sum({_number('text')}), 6) as total from each join mc on mc.dataset_id = each.dataset_id and mc.column_name = each.name where {_number('text')} is not null group by 1",
        "canonical_rows": _rows(),
        "admin_levels": f"select silver_observation_id, coalesce(case when regexp_matches({given}, '^[0-4]$') then 'admin' || {given} when starts_with({given}, 'admin') then {given} end, case when trim(admin_4) <> '' then 'admin4' when trim(admin_3) <> '' then 'admin3' when trim(admin_2) <> '' then 'admin2' when trim(admin_1) <> '' then 'admin1' else 'admin0' end) as admin_level from silver_observation",
        "count_faults": "select case when value_numeric is null or isnan(value_numeric) then 'missing' when isinf(value_numeric) then 'infinite' when value_numeric < 0 then 'negative' when value_numeric <> floor(value_numeric) then 'fractional' else 'none' end as fault, count(*) as \"rows\" from silver_observation group by 1",
        "restored_abstracts": "select doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''), ' ') as abstract from documents where doc_type = 'abstract'",
        "safe_ids": "select distinct regexp_replace(concat_ws('/', source_id, source_subunit), '[^a-zA-Z0-9_]+', '_', 'g') as panel_id from modeling_series",
        "quality_summary": "select disease, metric, spatial_resolution, temporal_resolution, count(*) as measurements, min(period_start) as earliest, max(period_end) as latest, count(distinct dataset_id) as datasets, count(distinct source_id) as sources, min(value_numeric) as minimum, median(value_numeric) as median from silver_observation group by 1, 2, 3, 4",
        "usable_proportions": " union all ".join(f"select 'silver_observation' as dataset, '{k}' as dimension, count(*) as records, count(*) filter ({c}) as usable_records, count(*) filter ({c}) / count(*) as usable_proportion from silver_observation" for k, c in dims.items()),
        "occurrence_summary": "select species, count(*) as occurrences, count(*) filter (trim(admin_2) <> '') as located, count(period_start) as dated, min(period_start) as first_date, max(period_start) as last_date, count(distinct dataset_id) as datasets from silver_observation group by 1",
        "complete_totals": """with q as (select *, case when lower(trim(sex)) in ('male', 'm', 'laki-laki', 'l') then 'male' when lower(trim(sex)) in ('female', 'f', 'perempuan', 'p') then 'female' end g from silver_observation where value_numeric is not null)
select dataset_id, metric, period_start, round(sum(value_numeric), 6) as total from q where g is not null group by 1, 2, 3 having count(*) filter (g = 'male') = 1 and count(*) filter (g = 'female') = 1""",
        "key_coverage": 'select source_id, count(*) as "rows", count(distinct (source_subunit, period_start)) as keys, count(*) - count(distinct (source_subunit, period_start)) as repeated, min(period_start) as first_date, max(period_start) as last_date from modeling_series group by 1',
        "baseline_verdicts": f"{cited} select c.* exclude (status), {verdict} as baseline_match from c",
        "baseline_merge": f"{cited} select p.observation_key, m.baseline_match from p left join (select distinct province, year, metric, value, {verdict} as baseline_match from c where value is not null) m on m.province = p.province and m.year = p.year and m.metric = p.metric and m.value = p.value",
        "conflict_flags": f"with {_PANEL} select observation_key, coalesce(min(value) over w <> max(value) over w, false) as conflict from p window w as (partition by province, year, metric)",
        "series_inputs": """with q as (select source_id, source_subunit, source_dataset_id, metric, concat_ws(' | ', admin_0, admin_1, admin_2, admin_3, facility_name) l, count(*) as readings, min(period_start) as first_date, max(period_start) as last_date
 from modeling_series where cast(value as varchar) <> 'nan' and period_start is not null group by all)
select concat_ws('/', q.source_id, source_subunit, metric) as series_id, coalesce(nullif(l, ''), 'Unspecified') as label, dataset_name, source_name, readings, first_date, last_date from q join metadata_dataset m on m.dataset_id = source_dataset_id join metadata_source s on s.source_id = q.source_id""",
        "candidate_cells": """with q as (select bronze_record_id, dataset_id, row_number, unnest(json_keys(payload)) as column_name, payload from bronze_record), t as (select * exclude (payload), json_extract_string(payload, '$."' || column_name || '"') as text from q)
select * from t where regexp_matches(text, '(?i)\\b(dbd|dengue|malaria)\\b')""",
        "largest_panel": 'with q as (select metric, source_id, source_subunit, count(*) as "rows" from modeling_series group by 1, 2, 3) select * exclude (k) from (select *, row_number() over (partition by metric order by "rows" desc, source_id nulls first, source_subunit nulls first) k from q) where k = 1',
        "common_places": "select admin_1 as place from silver_observation intersect select place_name from place_reference where place_level = 'admin_1'",
        "aligned_union": "select source_id, source_name, license_name, null as dataset_name, null as row_count from metadata_source union all select source_id, null, null, dataset_name, row_count from metadata_dataset",
        "best_representation": "select dataset_id, metric, admin_1, period_start, first(silver_observation_id order by value_numeric is not null desc, processed_at desc nulls last, silver_observation_id desc) as silver_observation_id, count(*) as representations from silver_observation group by 1, 2, 3, 4",
        "delivery_rows": "select silver_observation_id, metric, value_numeric from silver_observation where not coalesce(value_numeric is null or lower(privacy_class) <> 'aggregate', false)",
    }
