"""Queries of the medallion layer over the domain tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import medallion as m
from tidewell.operators import silver as sv
from tidewell.sources.tables import table


def _native(s, d):
    return m.native_observations(table(s, d, "silver_observation"), table(s, d, "metadata_dataset"))


def _text(df, column):
    return df.withColumn(column, F.array_join(column, ","))


def queries() -> dict:
    def t(name):
        return lambda s, d: table(s, d, name)

    silver, bronze, dataset, panel, source = t("silver_observation"), t("bronze_record"), t("metadata_dataset"), t("research_panel_observation"), t("metadata_source")
    panel_key = ["source_record", "province", "year", "metric"]
    return {
        "bronze_latest_version": lambda s, d: m.latest_version(dataset(s, d)).select("dataset_name", "dataset_id", "source_id", F.col("row_count"), "sha256"),
        "bronze_latest_records": lambda s, d: m.latest_records(dataset(s, d), bronze(s, d)).select("dataset_name", "dataset_id", "bronze_record_id", "row_number"),
        "bronze_row_hash": lambda s, d: m.row_hashes(bronze(s, d)),
        "bronze_snapshot_digest": lambda s, d: m.snapshot_digest(silver(s, d), "silver_observation_id", F.col("record_hash")),
        "gold_native_observation": lambda s, d: _native(s, d),
        "gold_modeling_series": lambda s, d: m.modeling_series(_native(s, d)).select("observation_id", "source_id", "metric", "value", "period_start", "period_end_effective", "spatial_resolution"),
        "gold_aggregated_series": lambda s, d: _text(m.aggregated_series(_native(s, d)), "observation_ids"),
        "gold_grain_inventory": lambda s, d: m.grain_inventory(_native(s, d)),
        "gold_source_coverage": lambda s, d: m.source_coverage(silver(s, d)),
        "asset_provenance": lambda s, d: dataset(s, d).join(source(s, d), "source_id").select("dataset_id", "dataset_name", "source_id", "source_name", "access_class", "license_name", "sha256", "loaded_at"),
        "dataset_silver_counts": lambda s, d: m.latest_version(dataset(s, d))
        .select("dataset_id", "dataset_name")
        .join(silver(s, d).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("observations")), "dataset_id", "left")
        .select("dataset_id", "dataset_name", F.coalesce("observations", F.lit(0)).alias("observations")),
        "orphan_anti_check": lambda s, d: m.orphans(silver(s, d), m.latest_version(dataset(s, d)), "dataset_id").select("silver_observation_id", "dataset_id"),
        "lineage_left_anti": lambda s, d: m.lineage(silver(s, d), bronze(s, d), silver(s, d).where("confirmation_status = 'confirmed'")),
        "quality_gates": lambda s, d: m.quality_gates(silver(s, d), bronze(s, d), dataset(s, d)),
        "conflict_quarantine": lambda s, d: m.conflicts(panel(s, d), panel_key, "value"),
        "dedup_keep_last": lambda s, d: m.keep_last(panel(s, d), panel_key, ["retrieved_at", "observation_key"]).select(*panel_key, "observation_key", "value"),
        "upsert_newest": lambda s, d: m.upsert(dataset(s, d).where("storage_format = 'csv'").select("dataset_name", "loaded_at", "dataset_id"), dataset(s, d).where("storage_format <> 'csv'").select("dataset_name", "loaded_at", "dataset_id"), ["dataset_name"], "loaded_at"),
        "insert_missing": lambda s, d: m.insert_missing(
            silver(s, d).where("disease = 'dengue'").select("source_id", "metric", "silver_observation_id"), silver(s, d).where("disease is null").select("source_id", "metric", "silver_observation_id"), ["source_id", "metric"], ["silver_observation_id"]
        ),
        "silver_build": lambda s, d: sv.observations(bronze(s, d)).drop("observation_hash"),
        "gold_publish": lambda s, d: sv.publish(sv.observations(bronze(s, d))).groupBy("metric", "grain").agg(F.count(F.lit(1)).alias("facts"), F.sum("records").alias("records")),
        "usable_shares": lambda s, d: sv.usable_shares(sv.observations(bronze(s, d))),
        "max_per_group": lambda s, d: bronze(s, d).groupBy("dataset_id").agg(F.max(F.get_json_object("payload", "$.kabupaten")).alias("largest")),
        "distinct_concat": lambda s, d: silver(s, d).where("value_numeric is not null").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("metric")), "; ").alias("metrics")),
        "json_path_projection": lambda s, d: silver(s, d).select(
            "silver_observation_id", m.filled(F.get_json_object("provenance", "$.source_record.aggregation_level")).alias("aggregation_level"), m.filled(F.get_json_object("provenance", "$.source_record.note")).alias("note")
        ),
        "payload_unpivot": lambda s, d: bronze(s, d).select("bronze_record_id", F.explode(F.from_json("payload", "map<string,string>")).alias("name", "value")).where("value is not null").groupBy("name").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("bronze_record_id").alias("records")),
    }


_NATIVE = """native as (select s.silver_observation_id as observation_id, s.source_id, s.dataset_id as source_dataset_id, d.dataset_name as source_dataset_name, s.disease, s.metric,
 s.value_numeric as value, s.unit, s.period_start, s.period_end, s.temporal_resolution, nullif(lower(trim(s.temporal_resolution)), '') as temporal_resolution_normalized,
 coalesce(s.period_end, case lower(trim(s.temporal_resolution)) when 'week' then s.period_start + 6 when 'month' then last_day(s.period_start)
  when 'quarter' then cast(date_trunc('quarter', s.period_start) + interval 3 month - interval 1 day as date) when 'year' then make_date(year(s.period_start), 12, 31) else s.period_start end) as period_end_effective,
 nullif(lower(json_extract_string(s.provenance, '$.source_record.aggregation_level')), '') as source_aggregation_level,
 nullif(trim(s.spatial_resolution), '') as stated, nullif(trim(s.facility_name), '') as f,
 case when nullif(trim(s.admin_4), '') is not null then 'adm4' when nullif(trim(s.admin_3), '') is not null then 'adm3' when nullif(trim(s.admin_2), '') is not null then 'adm2'
  when nullif(trim(s.admin_1), '') is not null then 'adm1' when nullif(trim(s.admin_0), '') is not null then 'adm0' else 'unspecified' end as deepest,
 s.admin_0, s.admin_1, s.admin_2, s.admin_3, s.admin_4, s.facility_name, s.facility_type, s.sex, s.age_group, s.species, s.case_definition, s.confirmation_status,
 nullif(json_extract_string(s.provenance, '$.source_record.subunit'), '') as source_subunit, nullif(json_extract_string(s.provenance, '$.source_record.source'), '') as upstream_source
 from silver_observation s join metadata_dataset d on d.dataset_id = s.dataset_id where s.value_numeric is not null),
gold as (select n.* exclude (stated, f, deepest), cast(period_end_effective - period_start + 1 as integer) as temporal_span_days,
 coalesce(stated, case when source_aggregation_level in ('kelurahan', 'desa', 'village') then 'adm4' when source_aggregation_level in ('kecamatan', 'subdistrict', 'admin3', 'adm3') then 'adm3'
  when source_aggregation_level in ('puskesmas', 'hospital', 'facility') then 'facility' when source_aggregation_level in ('admin0', 'adm0') then 'adm0' when source_aggregation_level in ('admin1', 'adm1') then 'adm1'
  when source_aggregation_level in ('admin2', 'adm2') then 'adm2' when f is not null then 'facility' else deepest end) as spatial_resolution,
 coalesce(stated, source_aggregation_level, case when f is not null then coalesce(nullif(lower(facility_type), ''), 'facility') else deepest end) as spatial_unit_type from native n)"""
_LATEST = "latest as (select * from (select *, row_number() over (partition by dataset_name order by loaded_at desc, dataset_id desc) k from metadata_dataset) where k = 1)"


def _silver_sql() -> str:
    """Observations from raw rows: every cell as a row, then one row per measure."""
    names = ", ".join(f"('{n}', '{several[0]}')" for several in sv.COLUMN_NAMES for n in several)
    first = ", ".join(f"first(v order by k) filter (name = '{c}') as {c}" for c in (*sv.DESCRIBES, "report_date", "onset_date", "year", "month", "week"))
    measures = ", ".join(f"('{x}')" for x in sv.MEASURES)
    return f"""ms(raw, name) as (values {names}), ks as (select bronze_record_id, dataset_id, payload, unnest(json_keys(payload)) kk, generate_subscripts(json_keys(payload), 1) k from bronze_record),
cl as (select bronze_record_id, dataset_id, k, coalesce(ms.name, regexp_replace(lower(trim(kk)), '\\s+', '_', 'g')) as name, trim(json_extract_string(payload, '$."' || kk || '"')) v from ks left join ms on ms.raw = regexp_replace(lower(trim(kk)), '\\s+', '_', 'g')),
fl as (select * from cl where v <> ''), wd as (select bronze_record_id, dataset_id, {first} from fl group by 1, 2),
dt as (select *, coalesce(try_cast(report_date as date), try_cast(onset_date as date)) as d, try_cast(year as integer) y, case when try_cast(month as integer) between 1 and 12 then try_cast(month as integer) end m, case when try_cast(week as integer) between 1 and 53 then try_cast(week as integer) end w from wd),
gr as (select *, case when d is not null then 'day' when y between 1900 and 2100 and w is not null then 'week' when y between 1900 and 2100 and m is not null then 'month' when y between 1900 and 2100 then 'year' end as grain from dt),
me(metric) as (values {measures}), fm as (select bronze_record_id, name, first(v order by k) v from fl group by 1, 2),
ob as (select gr.bronze_record_id, gr.dataset_id, metric, case when regexp_matches(x, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then cast(x as double) end as value, {", ".join(sv.DESCRIBES)}, grain,
 case grain when 'day' then d when 'week' then cast(date_trunc('week', make_date(y, 1, 4)) + to_days(7 * (w - 1)) as date) when 'month' then make_date(y, m, 1) when 'year' then make_date(y, 1, 1) end as period_start
 from gr join me on true join (select bronze_record_id, name, case when regexp_matches(v, '^[^,.]*,[^,.]*$') then replace(v, ',', '.') else replace(v, ',', '') end x from fm) f on f.bronze_record_id = gr.bronze_record_id and f.name = metric)"""


def oracle_sql() -> dict[str, str]:
    keys = ", ".join(m.AGGREGATE_KEYS)
    return {
        "bronze_latest_version": f"with {_LATEST} select dataset_name, dataset_id, source_id, row_count, sha256 from latest",
        "bronze_latest_records": f"with {_LATEST} select l.dataset_name, l.dataset_id, b.bronze_record_id, b.row_number from latest l join bronze_record b on b.dataset_id = l.dataset_id",
        "bronze_row_hash": "select bronze_record_id, sha256(payload) as row_hash from bronze_record",
        "gold_native_observation": f"with {_NATIVE} select * from gold",
        "gold_modeling_series": f"with {_NATIVE} select observation_id, source_id, metric, value, period_start, period_end_effective, spatial_resolution from gold where period_start is not null",
        "gold_aggregated_series": f"with {_NATIVE} select {keys}, sum(value) as value, count(*) as contributing_records, array_to_string(list(observation_id order by observation_id), ',') as observation_ids from gold where period_start is not null group by {keys}",
        "gold_grain_inventory": f"""with {_NATIVE} select source_id, source_dataset_id, source_dataset_name, upstream_source, disease, metric, spatial_resolution, spatial_unit_type, temporal_resolution_normalized as grain,
 count(*) as observations, min(period_start) as first_period, max(period_end_effective) as last_period, count(distinct admin_1) as provinces, count(distinct admin_2) as districts, count(distinct admin_3) as subdistricts,
 count(distinct admin_4) as villages, count(distinct facility_name) as facilities, count(distinct source_subunit) as source_subunits from gold group by all""",
        "gold_source_coverage": """select source_id, disease, metric, temporal_resolution, case when facility_name is not null then 'facility' when admin_4 is not null then 'adm4' when admin_3 is not null then 'adm3'
 when admin_2 is not null then 'adm2' when admin_1 is not null then 'adm1' when admin_0 is not null then 'adm0' else 'unspecified' end as level, min(period_start) as first_period, max(period_end) as last_period,
 count(*) as observations, count(distinct facility_name) as facilities, count(distinct admin_1) as provinces, count(distinct admin_2) as districts from silver_observation where value_numeric is not null group by 1, 2, 3, 4, 5""",
        "asset_provenance": "select d.dataset_id, d.dataset_name, d.source_id, s.source_name, s.access_class, s.license_name, d.sha256, d.loaded_at from metadata_dataset d join metadata_source s using (source_id)",
        "dataset_silver_counts": f"with {_LATEST} select l.dataset_id, l.dataset_name, coalesce(c.n, 0) as observations from latest l left join (select dataset_id, count(*) n from silver_observation group by 1) c on c.dataset_id = l.dataset_id",
        "orphan_anti_check": f"with {_LATEST} select silver_observation_id, dataset_id from silver_observation s where not exists (select 1 from latest l where l.dataset_id = s.dataset_id)",
        "lineage_left_anti": "select s.silver_observation_id, s.bronze_record_id, s.dataset_id from silver_observation s join bronze_record b on b.bronze_record_id = s.bronze_record_id where s.confirmation_status is distinct from 'confirmed'",
        "quality_gates": """select 'observation_without_record' as check_name, count(*) as failures from silver_observation s where not exists (select 1 from bronze_record b where b.bronze_record_id = s.bronze_record_id)
union all select 'observation_without_dataset', count(*) from silver_observation s where not exists (select 1 from metadata_dataset b where b.dataset_id = s.dataset_id)
union all select 'record_without_dataset', count(*) from bronze_record s where not exists (select 1 from metadata_dataset b where b.dataset_id = s.dataset_id)
union all select 'reversed_period', count(*) from silver_observation where period_end < period_start
union all select 'repeated_record_hash', count(*) from (select record_hash from silver_observation group by 1 having count(*) > 1)
union all select 'value_not_finite', count(*) from silver_observation where not isfinite(value_numeric)""",
        "conflict_quarantine": 'select source_record, province, year, metric, count(distinct value) as distinct_values, count(*) as "rows" from research_panel_observation group by 1, 2, 3, 4 having count(distinct value) > 1',
        "dedup_keep_last": "select source_record, province, year, metric, observation_key, value from (select *, row_number() over (partition by source_record, province, year, metric order by retrieved_at desc nulls last, observation_key desc) k from research_panel_observation) where k = 1",
        "upsert_newest": "select dataset_name, loaded_at, dataset_id from (select *, row_number() over (partition by dataset_name order by loaded_at desc, storage_format <> 'csv' desc, dataset_id desc) k from metadata_dataset) where k = 1",
        "insert_missing": """with o as (select source_id, metric, silver_observation_id from silver_observation where disease = 'dengue'),
n as (select source_id, metric, min(silver_observation_id) as silver_observation_id from silver_observation s where disease is null group by 1, 2)
select * from o union all select * from n where not exists (select 1 from o where o.source_id = n.source_id and o.metric = n.metric)""",
        "silver_build": f"with {_silver_sql()} select * from ob where value is not null",
        "gold_publish": f"""with {_silver_sql()}, h as (select dataset_id, metric, value, {", ".join(sv.DESCRIBES)}, grain, period_start, count(distinct bronze_record_id) n from ob where value is not null and period_start is not null group by all)
select metric, grain, count(*) as facts, cast(sum(n) as bigint) as records from h group by 1, 2""",
        "usable_shares": f"""with {_silver_sql()} select metric, count(*) as observations, avg(case when period_start is not null then 1.0 else 0.0 end) as with_period, avg(case when coalesce(facility, subdistrict, district, province) is not null then 1.0 else 0.0 end) as with_place,
 avg(case when disease is not null then 1.0 else 0.0 end) as with_disease, avg(case when value >= 0 then 1.0 else 0.0 end) as not_negative from ob where value is not null group by 1""",
        "max_per_group": "select dataset_id, max(json_extract_string(payload, '$.kabupaten')) as largest from bronze_record group by 1",
        "distinct_concat": "select source_id, array_to_string(list_sort(list(distinct metric)), '; ') as metrics from silver_observation where value_numeric is not null and metric is not null group by 1",
        "json_path_projection": "select silver_observation_id, nullif(json_extract_string(provenance, '$.source_record.aggregation_level'), '') as aggregation_level, nullif(json_extract_string(provenance, '$.source_record.note'), '') as note from silver_observation",
        "payload_unpivot": """select name, count(*) as cells, count(distinct bronze_record_id) as records from (select bronze_record_id, name, json_extract_string(payload, '$."' || name || '"') v from (select bronze_record_id, payload, unnest(json_keys(payload)) as name from bronze_record)) where v is not null group by 1""",
    }
