"""Audits of tables and comparisons with what is already known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable_shares(df: DataFrame, dataset: str, checks: dict[str, Column]) -> DataFrame:
    """(dataset, dimension, records, usable_records, usable_proportion) for each of ``checks``, in one pass; the share of no records is null."""
    counted = df.agg(F.count(F.lit(1)).alias("records"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("usable_records")) for n in checks])).alias("c")
    return counted.select(F.lit(dataset).alias("dataset"), "records", listed).select("dataset", "c.dimension", "records", "c.usable_records", F.try_divide("c.usable_records", "records").alias("usable_proportion"))


def stated(column: str) -> Column:
    return F.coalesce(F.trim(column) != "", F.lit(False))


def quality_summary(df: DataFrame, keys: list[str], start: str, end: str, value: str, datasets: str, sources: str) -> DataFrame:
    """Per group (nulls are a group): rows, earliest, latest, numbers of datasets and sources, least and median value."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("measurements"), F.min(start).alias("earliest"), F.max(end).alias("latest"), F.count_distinct(datasets).alias("datasets"), F.count_distinct(sources).alias("sources"),
        F.min(value).alias("minimum"), F.median(value).alias("median"),
    )


def occurrence_summary(df: DataFrame, species: str, located: Column, start: str, dataset: str) -> DataFrame:
    """Per species: occurrences, located and dated ones, first and last date, number of datasets."""
    return df.groupBy(F.col(species).alias("species")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_if(located).alias("located"), F.count(start).alias("dated"), F.min(start).alias("first_date"), F.max(start).alias("last_date"), F.count_distinct(dataset).alias("datasets")
    )


def complete_totals(df: DataFrame, keys: list[str], part: Column, parts: list[str], value: str) -> DataFrame:
    """(keys, total) where each of ``parts`` is there exactly once with a value; groups with a missing or repeated part give no total."""
    of = df.withColumn("_part", part).where(F.col("_part").isin(*parts) & F.col(value).isNotNull())
    counted = of.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("_part").alias("_d"), F.sum(value).alias("total"))
    return counted.where((F.col("_n") == len(parts)) & (F.col("_d") == len(parts))).drop("_n", "_d")


def key_coverage(df: DataFrame, group: str, keys: list[str], start: str) -> DataFrame:
    """Per group: rows, distinct keys, rows beyond one of a key, first and last date; keys are counted before groups, so that no group meets in one task."""
    each = df.groupBy(group, *[k for k in keys if k != group]).agg(F.count(F.lit(1)).alias("n"), F.min(start).alias("a"), F.max(start).alias("z"))
    return each.groupBy(group).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.sum(F.col("n") - 1).alias("repeated"), F.min("a").alias("first_date"), F.max("z").alias("last_date"))


def verdicts(new: DataFrame, known: DataFrame, keys: list[str], value: str, same: str = "same_count_present", other: str = "different_count_present", none: str = "no_exact_match") -> DataFrame:
    """``new`` with baseline_match: whether ``known`` has its value under its keys, another value, or nothing.

    Two joins on counts instead of sets of values, so that a key with many values costs no array. Null keys and values match nothing.
    """
    seen = known.where(F.col(value).isNotNull())
    by_value = seen.select(*keys, value).distinct().withColumn("_same", F.lit(True))
    by_key = seen.select(*keys).distinct().withColumn("_any", F.lit(True))
    joined = new.join(by_value, [*keys, value], "left").join(by_key, keys, "left")
    return joined.withColumn("baseline_match", F.when(F.col("_same"), same).when(F.col("_any"), other).otherwise(none)).drop("_same", "_any")


def merge_one(df: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` left joined with ``right``, which must hold every key once: a repeated key stops the job."""
    counted = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    once = counted.where(F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit("repeated key:"), *[F.col(k).cast("string") for k in keys]))).otherwise(F.lit(True)))
    return df.join(once.drop("_n"), keys, "left")


def series_inputs(series: DataFrame, datasets: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per series of an eligible dataset: its id, label, dataset and source, number of readings and span; readings are summed before the joins."""
    label = F.concat_ws(" | ", "admin_0", "admin_1", "admin_2", "admin_3", "facility_name")
    usable = series.where("value is not null and not isnan(value) and period_start is not null")
    each = usable.groupBy("source_id", "source_subunit", "source_dataset_id", "metric", label.alias("label")).agg(F.count(F.lit(1)).alias("readings"), F.min("period_start").alias("first_date"), F.max("period_start").alias("last_date"))
    known = each.join(datasets.select(F.col("dataset_id").alias("source_dataset_id"), "dataset_name"), "source_dataset_id").join(sources.select("source_id", "source_name"), "source_id")
    return known.select(F.concat_ws("/", "source_id", "source_subunit", "metric").alias("series_id"), F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit("Unspecified")).alias("label"), "dataset_name", "source_name", "readings", "first_date", "last_date")


def candidate_cells(records: DataFrame, pattern: str = r"(?i)\b(dbd|dengue|malaria)\b") -> DataFrame:
    """(bronze_record_id, dataset_id, row_number, column_name, text): the cells of raw rows that match ``pattern`` in order of dataset, row and place."""
    cells = records.where(F.col("payload").rlike(pattern)).select("bronze_record_id", "dataset_id", "row_number", F.posexplode(F.map_entries(F.from_json("payload", "map<string,string>"))).alias("place", "c"))
    hit = cells.where(F.col("c.value").rlike(pattern)).select("bronze_record_id", "dataset_id", "row_number", "place", F.col("c.key").alias("column_name"), F.col("c.value").alias("text"))
    return hit.orderBy("dataset_id", "row_number", "bronze_record_id", "place").drop("place")


def largest(df: DataFrame, group: list[str], member: list[str]) -> DataFrame:
    """The member of each group with the most rows; of several the smallest."""
    counted = df.groupBy(*group, *member).agg(F.count(F.lit(1)).alias("rows"))
    return counted.groupBy(*group).agg(F.min(F.struct((-F.col("rows")).alias("m"), *member)).alias("b")).select(*group, *[F.col(f"b.{m}").alias(m) for m in member], (-F.col("b.m")).alias("rows"))


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with ``conflict``: whether its key holds different values. Distinct values are counted by key first, and joined back."""
    several = df.groupBy(*keys).agg((F.min(value) != F.max(value)).alias("_c"))
    same = [df[k].eqNullSafe(several[k]) for k in keys]
    return df.join(several, same, "left").select(df["*"], F.coalesce("_c", F.lit(False)).alias("conflict"))


def delivered(df: DataFrame, excluded: Column, hidden: list[str]) -> DataFrame:
    """The rows of a delivery: without those ``excluded`` (a null condition excludes nothing) and without ``hidden`` columns."""
    return df.where(~F.coalesce(excluded, F.lit(False))).drop(*hidden)

