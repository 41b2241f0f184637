"""Bronze, silver and gold layers: versions, hashes, observations, inventories, lineage and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADMIN = ("admin_0", "admin_1", "admin_2", "admin_3", "admin_4")
# What a source calls its level of aggregation.
LEVEL_WORDS = {
    "adm4": ("kelurahan", "desa", "village"),
    "adm3": ("kecamatan", "subdistrict", "admin3", "adm3"),
    "facility": ("puskesmas", "hospital", "facility"),
    "adm0": ("admin0", "adm0"),
    "adm1": ("admin1", "adm1"),
    "adm2": ("admin2", "adm2"),
}
# The columns that make two observations parts of one aggregate.
AGGREGATE_KEYS = (
    "source_id", "source_dataset_id", "source_dataset_name", "upstream_source", "disease", "metric", "unit", "temporal_resolution",
    "period_start", "period_end", "spatial_resolution", "spatial_unit_type", "admin_0", "admin_1", "admin_2", "admin_3", "admin_4",
    "facility_name", "facility_type", "sex", "age_group", "species", "case_definition", "confirmation_status",
)


def filled(value: Column | str) -> Column:
    """The value, null where blank."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.trim(c) != "", c)


def latest_version(datasets: DataFrame) -> DataFrame:
    """The version of each dataset_name loaded last; ties go to the larger dataset_id. One partial aggregation, no window."""
    columns = datasets.columns
    newest = datasets.groupBy("dataset_name").agg(F.max(F.struct("loaded_at", "dataset_id", *[c for c in columns if c not in ("loaded_at", "dataset_id", "dataset_name")])).alias("v"))
    return newest.select(*[F.col("dataset_name") if c == "dataset_name" else F.col(f"v.{c}") for c in columns])


def latest_records(datasets: DataFrame, records: DataFrame) -> DataFrame:
    """Raw rows of the latest version of each file."""
    return records.join(latest_version(datasets).select("dataset_id", "dataset_name"), "dataset_id")


def row_hashes(records: DataFrame, text: str = "payload") -> DataFrame:
    """(bronze_record_id, row_hash): SHA-256 of each raw row without NUL characters; null for null rows."""
    return records.select("bronze_record_id", F.sha2(F.regexp_replace(text, "\x00", ""), 256).alias("row_hash"))


def snapshot_digest(rows: DataFrame, key: str, content: Column, buckets: int = 1024) -> DataFrame:
    """One digest of a whole table, whatever its partitioning.

    Rows are hashed into buckets by key, each bucket is digested in key order, and the bucket
    digests in bucket order; so no list grows beyond a bucket's share. ``buckets`` is part of the digest.
    """
    part = rows.select((F.pmod(F.xxhash64(key), F.lit(buckets))).alias("bucket"), F.struct(F.col(key).alias("k"), F.sha2(content.cast("string"), 256).alias("h")).alias("e"))
    each = part.groupBy("bucket").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.concat(e["k"].cast("string"), F.lit("|"), F.coalesce(e["h"], F.lit("")))), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("rows"))
    return each.agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda e: e["digest"]), "\n"), 256).alias("digest"))


def effective_end(start: Column, end: Column, word: Column) -> Column:
    """The stated end, or the end of the stated week, month, quarter or year, or the start."""
    w = F.lower(F.trim(word))
    return F.coalesce(
        end,
        F.when(w == "week", F.date_add(start, 6))
        .when(w == "month", F.last_day(start))
        .when(w == "quarter", F.date_sub(F.add_months(F.date_trunc("quarter", start).cast("date"), 3), 1))
        .when(w == "year", F.make_date(F.year(start), F.lit(12), F.lit(31)))
        .otherwise(start),
    )


def native_observations(observations: DataFrame, datasets: DataFrame) -> DataFrame:
    """Numeric observations with their dataset, effective period, span, and spatial level.

    The level is the stated one, else what the source calls its aggregation, else the deepest place
    column that is filled, else 'unspecified'.
    """
    source_level = F.coalesce(*[filled(F.lower(F.get_json_object("provenance", f"$.source_record.{k}"))) for k in ("aggregation_level", "admin_level")])
    deepest = F.when(filled("facility_name").isNotNull(), "facility")
    unit_type = F.when(filled("facility_name").isNotNull(), F.coalesce(filled(F.lower("facility_type")), F.lit("facility")))
    for c in reversed(ADMIN):
        deepest = deepest.when(filled(c).isNotNull(), f"adm{c[-1]}")
        unit_type = unit_type.when(filled(c).isNotNull(), f"adm{c[-1]}")
    known = F.lit(None).cast("string")
    for level, words in LEVEL_WORDS.items():
        known = F.when(source_level.isin(*words), level).otherwise(known)
    stated = filled("spatial_resolution")
    end = effective_end(F.col("period_start"), F.col("period_end"), F.col("temporal_resolution"))
    names = datasets.select("dataset_id", F.col("dataset_name").alias("source_dataset_name"))
    return (
        observations.where(F.col("value_numeric").isNotNull())
        .join(names, "dataset_id")
        .select(
            F.col("silver_observation_id").alias("observation_id"),
            "source_id",
            F.col("dataset_id").alias("source_dataset_id"),
            "source_dataset_name",
            "disease",
            "metric",
            F.col("value_numeric").alias("value"),
            "unit",
            "period_start",
            "period_end",
            "temporal_resolution",
            F.lower(filled(F.trim("temporal_resolution"))).alias("temporal_resolution_normalized"),
            end.alias("period_end_effective"),
            (F.datediff(end, "period_start") + 1).alias("temporal_span_days"),
            F.coalesce(stated, known, deepest, F.lit("unspecified")).alias("spatial_resolution"),
            F.coalesce(stated, source_level, unit_type, F.lit("unspecified")).alias("spatial_unit_type"),
            *ADMIN,
            "facility_name",
            "facility_type",
            "sex",
            "age_group",
            "species",
            "case_definition",
            "confirmation_status",
            filled(F.get_json_object("provenance", "$.source_record.subunit")).alias("source_subunit"),
            source_level.alias("source_aggregation_level"),
            filled(F.get_json_object("provenance", "$.source_record.source")).alias("upstream_source"),
        )
    )


def modeling_series(native: DataFrame) -> DataFrame:
    """Observations with a value and a period; filters reach the scan below."""
    return native.where("value is not null and period_start is not null")


def aggregated_series(native: DataFrame) -> DataFrame:
    """Sum, number and ordered ids of the observations that agree in AGGREGATE_KEYS (nulls agree)."""
    return modeling_series(native).groupBy(*AGGREGATE_KEYS).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("contributing_records"), F.array_sort(F.collect_list("observation_id")).alias("observation_ids"))


def _distincts(pairs: dict[str, str]) -> list[Column]:
    # sets of place names within one group: bounded by the number of places, and no row is expanded
    return [F.size(F.collect_set(c)).cast("long").alias(name) for name, c in pairs.items()]


def grain_inventory(native: DataFrame) -> DataFrame:
    """Observations, first and last period and number of places for each grain of each series family."""
    keys = ["source_id", "source_dataset_id", "source_dataset_name", "upstream_source", "disease", "metric", "spatial_resolution", "spatial_unit_type", F.col("temporal_resolution_normalized").alias("grain")]
    places = {"provinces": "admin_1", "districts": "admin_2", "subdistricts": "admin_3", "villages": "admin_4", "facilities": "facility_name", "source_subunits": "source_subunit"}
    return native.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.min("period_start").alias("first_period"), F.max("period_end_effective").alias("last_period"), *_distincts(places))


def source_coverage(observations: DataFrame) -> DataFrame:
    """Coverage of each source, disease, metric and resolution at its deepest filled place column."""
    level = F.when(F.col("facility_name").isNotNull(), "facility")
    for c in reversed(ADMIN):
        level = level.when(F.col(c).isNotNull(), f"adm{c[-1]}")
    keys = ["source_id", "disease", "metric", "temporal_resolution", level.otherwise("unspecified").alias("level")]
    places = {"facilities": "facility_name", "provinces": "admin_1", "districts": "admin_2"}
    return observations.where("value_numeric is not null").groupBy(*keys).agg(F.min("period_start").alias("first_period"), F.max("period_end").alias("last_period"), F.count(F.lit(1)).alias("observations"), *_distincts(places))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose ``key`` no row of ``parent`` has; null keys are orphans."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def lineage(observations: DataFrame, records: DataFrame, known: DataFrame) -> DataFrame:
    """(silver_observation_id, bronze_record_id, dataset_id) links that ``known`` does not hold yet."""
    links = observations.join(records.select("bronze_record_id"), "bronze_record_id").select("silver_observation_id", "bronze_record_id", "dataset_id")
    return links.join(known.select("silver_observation_id"), "silver_observation_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in: of each key the row with the largest ``newest``, ``new`` on ties."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, newest, "_turn")]
    best = both.groupBy(*keys).agg(F.max(F.struct(newest, "_turn", *rest)).alias("r"))
    return best.select(*keys, f"r.{newest}", *[f"r.{c}" for c in rest])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` with keys that ``old`` lacks, the first by ``order`` of each key."""
    first = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return old.unionByName(fresh)


def quality_gates(observations: DataFrame, records: DataFrame, datasets: DataFrame) -> DataFrame:
    """(check_name, failures): counts that should be zero."""
    checks = {
        "observation_without_record": orphans(observations, records, "bronze_record_id"),
        "observation_without_dataset": orphans(observations, datasets, "dataset_id"),
        "record_without_dataset": orphans(records, datasets, "dataset_id"),
        "reversed_period": observations.where("period_end < period_start"),
        "repeated_record_hash": observations.groupBy("record_hash").count().where("count > 1"),
        "value_not_finite": observations.where(F.isnan("value_numeric") | (F.abs("value_numeric") == float("inf"))),
    }
    out = None
    for name, failing in checks.items():
        row = failing.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check_name"), "failures")
        out = row if out is None else out.unionByName(row)
    return out


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value, with the number of values and rows; null values do not count, null keys agree."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("distinct_values"), F.count(F.lit(1)).alias("rows")).where("distinct_values > 1")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def best_representation(df: DataFrame, identity: list[str], rank: list[Column], where: list[str]) -> DataFrame:
    """One row per identity: the greatest by ``rank`` (first on ties by key columns), with the number and the list of representations."""
    return df.groupBy(*identity).agg(F.max(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], *where)).alias("best"), F.count(F.lit(1)).alias("representations"), F.array_sort(F.collect_set(F.struct(*where))).alias("coordinates"))
