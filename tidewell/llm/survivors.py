"""One surviving record per group of duplicates, chosen field by field in a single aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import clean
from tidewell.llm.places import match_values

# Trust in a quality_status, best first; null and other words come last.
STATUS_ORDER = ("valid", "review required", "conflict")


def survive(df: DataFrame, group: list[str], fields: list[str], priority: Column, recent: Column, key: str) -> DataFrame:
    """One row per group: rows, first_key, and for each field its best value and the key of its record (field_key).

    For each field the record with the maximum of (field present, priority, recent, key) supplies
    it: one partial aggregation of composite structs, so a group of any size never meets in one
    task before it is reduced. Null, NaN and blank fields are absent; if no record has a field its
    value and key are null. Null group columns form a group of their own.
    """

    def present(name: str) -> Column:
        kind = dict(df.dtypes)[name]
        if kind == "string":
            return F.coalesce(F.trim(name) != "", F.lit(False))
        return F.col(name).isNotNull() & ~F.isnan(name) if kind in ("double", "float") else F.col(name).isNotNull()

    best = [F.max(F.struct(present(f).alias("present"), priority.alias("priority"), recent.alias("recent"), F.col(key).alias("key"), F.col(f).alias("value"))).alias(f"best_{f}") for f in fields]
    out = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first_key"), *best)
    for f in fields:
        have = F.col(f"best_{f}.present")
        out = out.withColumn(f, F.when(have, F.col(f"best_{f}.value"))).withColumn(f"{f}_key", F.when(have, F.col(f"best_{f}.key"))).drop(f"best_{f}")
    return out


def panel_survivors(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Surviving research panel record per (deposit, province, year, metric).

    deposit is the eight-digit number in source_record, province the place_id of the admin_1 place
    the text means, or its own text where there is none. Rows without one of the four have no group.
    """
    status = F.regexp_replace(F.lower(clean("quality_status")), r"[\s\u00a0_\-]+", " ")
    priority = F.lit(0)
    for rank, word in enumerate(reversed(STATUS_ORDER), start=1):
        priority = F.when(status == word, rank).otherwise(priority)
    digits = F.regexp_extract(F.regexp_replace("source_record", r"(?<=\d)[\s\u00a0]+(?=\d)", ""), r"(?<!\d)(\d{8})(?!\d)", 1)
    provinces = match_values(df.select(F.lit("admin_1").alias("level"), F.col("province").alias("value")), reference).select(
        F.col("value").alias("province"), F.element_at("places", 1).cast("string").alias("place")
    )
    rows = df.select(
        "observation_key", "province", "year", F.lower(F.trim("metric")).alias("metric"), F.when(digits != "", digits).alias("deposit"),
        "value", "unit", F.col("source_url").alias("url"), priority.alias("priority"), "retrieved_at",
    )
    placed = rows.join(provinces, "province", "left").withColumn("province", F.coalesce("place", F.lower(F.trim("province"))))
    whole = placed.where("deposit is not null and province <> '' and year is not null and metric <> ''")
    return survive(whole, ["deposit", "province", "year", "metric"], ["value", "unit", "url"], F.col("priority"), F.col("retrieved_at"), "observation_key")


def duplicate_groups(df: DataFrame, reference: DataFrame) -> DataFrame:
    """(first_key, value_key, unit_key, url_key) of the groups of two or more records; empty text where no record has the field."""
    keys = [F.coalesce(k, F.lit("")).alias(k) for k in ("value_key", "unit_key", "url_key")]
    return panel_survivors(df, reference).where("rows > 1").select("first_key", *keys)
