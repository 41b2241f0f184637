"""Queries of the text and parser layer over documents, events and observations, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as t
from tidewell.operators import parse
from tidewell.sources import files
from tidewell.sources.tables import table
from tidewell.streaming import alarms

# Topics of a text, English and Indonesian.
TOPICS = [
    ("climate", r"(?i)\b(rainfall|temperature|curah hujan|suhu)\b"),
    ("vector", r"(?i)\b(larvae|traps?|jentik|perangkap)\b"),
    ("laboratory", r"(?i)\b(samples?|tested|sampel|uji)\b"),
    ("deaths", r"(?i)\b(deaths?|kematian)\b"),
    ("stock", r"(?i)\b(stocks?|sisa)\b"),
]


def queries() -> dict:
    return {
        "regex_tagging": lambda s, d: table(s, d, "documents").select("doc_id", t.tags(F.coalesce("text", F.lit("")), TOPICS).alias("topics")),
        "privacy_gate": lambda s, d: table(s, d, "documents").select("doc_id", files.personal_register(F.col("text")).alias("personal")),
        "embedded_links": lambda s, d: table(s, d, "documents").select("doc_id", F.explode(files.embedded_links(F.col("text"))).alias("link")),
        "weekly_reports": lambda s, d: parse.weekly_reports(table(s, d, "documents")),
        "markdown_cells": lambda s, d: parse.markdown_cells(table(s, d, "documents")),
        "parsed_tables": lambda s, d: parse.parse_tables(parse.markdown_cells(table(s, d, "documents")), "table_key"),
        "json_paths": lambda s, d: files.json_paths(table(s, d, "silver_observation"), "silver_observation_id", "provenance"),
        "windowed_counts": lambda s, d: alarms.windowed_counts(table(s, d, "events")).withColumn("total", F.round("total", 6)),
        "numbers_as_written": lambda s, d: table(s, d, "silver_observation").where("value_text is not null").select(
            "silver_observation_id", t.loader_number("value_text").alias("loader"), t.portal_number("value_text").alias("portal"), t.digits("value_text").alias("digits"), t.year("value_text").alias("year")
        ),
        "panel_checks": lambda s, d: parse.panel_checks(table(s, d, "research_panel_observation"), ["province", "year"], "metric", "value").select("province", "year", "quarantined", "incidence_off", "fatality_off", "more_deaths_than_cases"),
        "stable_ids": lambda s, d: table(s, d, "modeling_series").groupBy(t.stable_id("series", ["source_id", "source_subunit", "metric", "unit"]).alias("series_id")).agg(F.count(F.lit(1)).alias("rows")),
    }


def _weekly(pattern: str, language: str, thousands: str) -> str:
    return f"""select doc_id, '{language}' as language, cast(regexp_extract(s, '{pattern}', 2) as integer) as year, cast(regexp_extract(s, '{pattern}', 1) as integer) as week, regexp_extract(s, '{pattern}', 3) as place,
 regexp_extract(s, '{pattern}', 5) as disease, cast(replace(regexp_extract(s, '{pattern}', 4), '{thousands}', '') as bigint) as cases from (select doc_id, unnest(regexp_extract_all(text, '{pattern}')) s from documents)"""


def oracle_sql() -> dict[str, str]:
    topics = ", ".join("case when regexp_matches(coalesce(text, ''), '" + p + "') then '" + n + "' end" for n, p in TOPICS)
    return {
        "regex_tagging": f"select doc_id, concat_ws('; ', {topics}) as topics from documents",
        "privacy_gate": r"select doc_id, coalesce(regexp_matches(text, '(?im)^.*\b(?:nama|name)\b.*\b(?:umur|usia|age)\b.*\b(?:alamat|address)\b'), false) as personal from documents",
        "embedded_links": r"""select doc_id, unnest(list_distinct(regexp_extract_all(text, '(https?://[^\s"''<>]+)'))) as link from documents""",
        "weekly_reports": f"""with w as ({_weekly(parse.WEEKLY_EN, "en", ",")} union all {_weekly(parse.WEEKLY_ID, "id", ".")}) select *, cast(date_trunc('week', make_date(year, 1, 4)) + to_days(7 * (week - 1)) as date) as week_start from w where week between 1 and 53""",
        "windowed_counts": "select date_trunc('day', ts) as start, event_type, count(*) as events, round(sum(value), 6) as total from events group by 1, 2",
        "markdown_cells": r"""with l as (select cast(doc_id as varchar) table_key, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from documents),
p as (select table_key, n, string_split(trim(line, '|'), '|') v from l where regexp_matches(line, '^\|.*\|$') and not regexp_matches(line, '^[|\s:-]+$')),
c as (select table_key, cast(n as integer) as row_number, cast(generate_subscripts(v, 1) as integer) as column_number, trim(unnest(v), ' ') as value from p) select * from c where value <> ''""",
        "numbers_as_written": r"""with c as (select silver_observation_id, value_text t, trim(regexp_replace(value_text, '[\s\x{a0}]+', ' ', 'g')) c, lower(regexp_replace(value_text, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) l, regexp_replace(value_text, '[^0-9]', '', 'g') d from silver_observation where value_text is not null),
n as (select *, case when regexp_matches(c, '^[^,.]*,[^,.]*$') then replace(c, ',', '.') else replace(c, ',', '') end w from c)
select silver_observation_id, case when regexp_matches(w, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') then cast(w as double) end as loader,
 case when l = 'nihil' then 0 when regexp_matches(l, '^[0-9.,]+$') and regexp_matches(l, '[0-9]') then cast(regexp_replace(l, '[.,]', '', 'g') as bigint) end as portal,
 case when length(d) between 1 and 18 then cast(d as bigint) end as digits, try_cast(nullif(regexp_extract(t, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '') as integer) as year from n""",
        "stable_ids": """select 'series_' || substr(sha256(cast(to_json({'source_id': source_id, 'source_subunit': source_subunit, 'metric': metric, 'unit': unit}) as varchar)), 1, 24) as series_id, count(*) as "rows" from modeling_series group by 1""",
        "json_paths": """select silver_observation_id, replace(substr(t.fullkey, 3), '"', '') as path, case when t.type = 'NULL' then null else t.value ->> '$' end as value from silver_observation, json_tree(provenance) t where t.type not in ('OBJECT', 'ARRAY')""",
        "panel_checks": """with w as (select province, year, max(value) filter (metric = 'cases') c, max(value) filter (metric = 'deaths') d, max(value) filter (metric = 'population') p, max(value) filter (metric = 'incidence_rate') i, max(value) filter (metric = 'case_fatality_rate') f from research_panel_observation group by 1, 2),
s as (select province, year, case when c > 0 then c end c, d, case when p > 0 then p end p, i, f from w), k as (select province, year, coalesce(abs(c / p * 1e5 - i) > 1, false) as incidence_off, coalesce(abs(d / c * 100 - f) > 0.1, false) as fatality_off, coalesce(d > c, false) as more_deaths_than_cases from s)
select province, year, incidence_off or fatality_off or more_deaths_than_cases as quarantined, incidence_off, fatality_off, more_deaths_than_cases from k""",
    }
