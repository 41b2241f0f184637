"""Queries of this subpackage over their whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import leaks, packing, places, survivors, truncation
from tidewell.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p6_found": lambda s, d: places.free_entries(table(s, d, "silver_observation"), table(s, d, "place_reference")),
        "p7_found": lambda s, d: survivors.duplicate_groups(table(s, d, "research_panel_observation"), table(s, d, "place_reference")),
        "p8_containers": lambda s, d: packing.pack(table(s, d, "documents"), table(s, d, "pack_capacity")),
        "p8_fill": lambda s, d: packing.fill_report(packing.pack(table(s, d, "documents"), table(s, d, "pack_capacity")), table(s, d, "pack_capacity")),
        "p9_found": lambda s, d: leaks.leaked_items(table(s, d, "documents"), table(s, d, "eval_item")),
        "p9_leaks": lambda s, d: leaks.test_leaks(table(s, d, "documents"), table(s, d, "eval_item")),
        "p9_longest": lambda s, d: leaks.longest_matches(table(s, d, "documents"), table(s, d, "eval_item")),
        "p9_stock": lambda s, d: leaks.stock_passages(table(s, d, "documents"), table(s, d, "eval_item")),
        "p9_clean_documents": lambda s, d: leaks.without_leaks(table(s, d, "documents"), table(s, d, "eval_item")),
        "p10_found": lambda s, d: truncation.cut_texts(table(s, d, "documents")),
        "p10_rates": lambda s, d: truncation.rates(table(s, d, "documents")),
        "p10_limits": lambda s, d: truncation.length_limits(table(s, d, "documents")),
    }


_BLANK = "'^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g'"


def _plain(v: str) -> str:
    x = f"strip_accents(lower({v}))"
    x = f"regexp_replace({x}, '\\([^)]*\\)?', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[^a-z0-9,]+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g')"
    x = f"trim(regexp_replace(regexp_replace({x}, '^([^,]*),(.*)$', '\\2 \\1'), '[ ,]+', ' ', 'g'))"
    x = f"regexp_replace(regexp_replace({x}, '^r s u d ', 'rsud '), '^(propinsi|provinsi|prov) ', '')"
    return f"translate({x}, '01345789', 'oieastbg')"


def _names_sql(values: str) -> str:
    """CTEs: best (level, v, place_id) of the distinct (level, v) in ``values``, comparing every name with every reference name."""
    directions = "x"
    for whole, short in places.DIRECTIONS.items():
        directions = f"regexp_replace({directions}, ' ({short})$', ' {whole}')"
    kind, apart, glued = [], [], []
    for level, kinds in places.KINDS.items():
        words = sorted((w for several in kinds.values() for w in several), key=len, reverse=True)
        apart.append(f"when '{level}' then '^({'|'.join(words)}) (.+)$'")
        glued.append(f"when '{level}' then '^({'|'.join(w.replace(' ', '') for w in words if len(w) > 2)})(.{{4,}})$'")
        for name, several in kinds.items():
            both = ", ".join(f"'{w}'" for w in dict.fromkeys([*several, *[w.replace(" ", "") for w in several]]))
            kind.append(f"when level = '{level}' and w in ({both}) then '{name}'")
    return f"""vals as ({values}),
named as (select level, v, cast(null as bigint) place_id from vals union all select place_level, place_name, place_id from place_reference
 union all select place_level, unnest(string_split(aliases, '|')), place_id from place_reference where aliases is not null),
n1 as (select *, {_plain("v")} x from named), n2 as (select * exclude (x), case when level = 'admin_1' then {directions} else x end x from n1),
n3 as (select *, replace(x, ' ', '') w0, case level {" ".join(apart)} end pa, case level {" ".join(glued)} end pg from n2),
n4 as (select level, v, place_id, regexp_extract(x, pa, 1) w, replace(regexp_extract(x, pa, 2), ' ', '') core from n3 where regexp_matches(x, pa)
 union all select level, v, place_id, '' w, w0 from n3 where not regexp_matches(x, pa) union all select level, v, place_id, regexp_extract(w0, pg, 1), regexp_extract(w0, pg, 2) from n3 where not regexp_matches(x, pa) and regexp_matches(w0, pg)),
n5 as (select level, v, place_id, core, case {" ".join(kind)} else '' end kind from n4 where core <> ''),
cores as (select distinct level, core from n5 where place_id is null), refs as (select distinct level, core, kind, place_id from n5 where place_id is not null),
near as (select c.level, c.core, r.kind, r.place_id, levenshtein(c.core, r.core) edits from cores c join refs r on r.level = c.level and abs(length(r.core) - length(c.core)) <= 2
 where levenshtein(c.core, r.core) <= case when length(r.core) <= 3 then 0 when length(r.core) <= 6 then 1 else 2 end),
rk as (select n.level, n.v, near.place_id, rank() over (partition by n.level, n.v order by edits, case when n.kind = near.kind or n.kind = '' then 0 else 1 end) k from n5 n join near on near.level = n.level and near.core = n.core where n.place_id is null),
best as (select distinct level, v, place_id from rk where k = 1)"""


def oracle_sql() -> dict[str, str]:
    fields = " union all ".join(f"select silver_observation_id id, '{f}' field_name, '{level}' as level, {f} v from silver_observation where regexp_replace({f}, {_BLANK}) <> ''" for f, level in places.FIELDS.items())
    statuses = "regexp_replace(lower(regexp_replace(quality_status, " + _BLANK + ")), '[\\s\u00a0_\\-]+', ' ', 'g')"

    def best(field: str, present: str) -> str:
        return f"first(observation_key order by {present} desc, pr desc, retrieved_at desc nulls last, observation_key desc) filter ({present}) as {field}"

    return {
        "p6_found": f"""with lng as ({fields}), {_names_sql("select distinct level, v from lng")},
up as (select p.place_id, coalesce(p.parent_id, -1) u1, coalesce(q.parent_id, -1) u2 from place_reference p left join place_reference q on q.place_id = p.parent_id),
opt as (select l.id, l.field_name, l.level, l.v, b.place_id, u1, u2 from lng l join best b on b.level = l.level and b.v = l.v join up on up.place_id = b.place_id),
sc as (select o.*, 4 * cast(exists (select 1 from opt x where x.id = o.id and x.place_id = o.u1) as int) + 2 * cast(exists (select 1 from opt x where x.id = o.id and x.place_id = o.u2) as int)
 + cast(exists (select 1 from opt x where x.id = o.id and (x.u1 = o.place_id or x.u2 = o.place_id)) as int) s from opt o),
pk as (select *, row_number() over (partition by id, field_name order by s desc, place_id) k from sc)
select l.id as silver_observation_id, l.field_name, coalesce(pk.place_id, 0) as place_id from lng l left join pk on pk.id = l.id and pk.field_name = l.field_name and pk.k = 1
where not exists (select 1 from place_reference r where r.place_level = l.level and r.place_name = l.v)""",
        "p7_found": f"""with {_names_sql("select distinct 'admin_1' as level, province v from research_panel_observation where regexp_replace(province, " + _BLANK + ") <> ''")},
pl as (select v, min(place_id) place_id from best group by 1),
r as (select observation_key, year, lower(trim(metric)) metric, regexp_extract(regexp_replace(source_record, '[^0-9]', '', 'g'), '([0-9]{{8}})$', 1) deposit, coalesce(cast(pl.place_id as varchar), lower(trim(province))) pv,
 value, unit, source_url, retrieved_at, case {statuses} when 'valid' then 3 when 'review required' then 2 when 'conflict' then 1 else 0 end pr from research_panel_observation left join pl on pl.v = province),
g as (select deposit, pv, year, metric, count(*) n, min(observation_key) as first_key, {best("value_key", "value is not null")}, {best("unit_key", "trim(unit) <> ''")}, {best("url_key", "trim(source_url) <> ''")}
 from r where deposit <> '' and pv <> '' and year is not null and metric <> '' group by 1, 2, 3, 4)
select first_key, coalesce(value_key, '') as value_key, coalesce(unit_key, '') as unit_key, coalesce(url_key, '') as url_key from g where n > 1""",
    }
