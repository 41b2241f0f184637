"""Bronze rows to typed observations, and observations to published facts, with lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as t
from tidewell.operators import drift

# Names under which raw tables hold a column, English and Indonesian, the canonical one first.
COLUMN_NAMES = (
    ("larva_free_index", "abj", "angka_bebas_jentik"),
    ("admitted", "dirawat", "rawat_inap"),
    ("age_group", "kelompok_umur", "umur"),
    ("incidence_rate", "angka_kesakitan", "ir"),
    ("month", "bulan", "bln", "bulan_ke", "bulan_laporan"),
    ("longitude", "bujur", "lon"),
    ("latitude", "lintang", "lat"),
    ("fatality_rate", "case_fatality", "cfr"),
    ("cases", "jumlah_kasus", "jml_kasus", "total_kasus", "kasus"),
    ("note", "catatan", "keterangan"),
    ("confirmed", "konfirmasi", "positif_lab"),
    ("rainfall", "curah_hujan", "hujan_mm"),
    ("deaths", "meninggal", "kematian", "jml_meninggal"),
    ("disease", "penyakit", "nama_penyakit"),
    ("district", "kabupaten", "kab_kota", "nama_kabupaten"),
    ("week", "epiweek", "minggu", "minggu_ke"),
    ("facility", "faskes", "puskesmas", "nama_puskesmas"),
    ("fogging", "fogging_count", "jml_fogging"),
    ("sex", "gender", "jenis_kelamin", "jk"),
    ("species", "spesies", "jenis_vektor"),
    ("population", "penduduk", "jml_penduduk"),
    ("suspected", "suspek", "jml_suspek"),
    ("subdistrict", "kecamatan", "nama_kecamatan"),
    ("officer_code", "petugas_kode", "kode_petugas"),
    ("outbreak_flag", "klb", "status_klb"),
    ("onset_date", "tanggal_onset", "tgl_onset"),
    ("report_date", "tanggal_lapor", "tgl_lapor"),
    ("source", "origin", "sumber", "sumber_data"),
    ("province", "provinsi", "prov", "nama_provinsi"),
    ("verified", "terverifikasi", "sudah_verifikasi"),
    ("temperature", "suhu", "suhu_rata"),
    ("year", "tahun", "thn", "tahun_laporan"),
)
# Columns that measure something, by their first name in COLUMN_NAMES; the others describe the row.
MEASURES = (
    "cases", "deaths", "confirmed", "suspected", "admitted", "population", "rainfall", "temperature", "larva_free_index", "incidence_rate", "fatality_rate", "fogging",
)
DESCRIBES = ("disease", "province", "district", "subdistrict", "facility", "sex", "age_group", "species")


def meaning(name: Column) -> Column:
    """First name of the meaning a column name has, else the name itself in lower case with underscores."""
    pairs = {n: names[0] for names in COLUMN_NAMES for n in names}
    plain = drift.column_name(name)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), plain), plain)


def observations(records: DataFrame) -> DataFrame:
    """One row per filled measure of a raw row: metric, value, description, period, and a hash of all that.

    Dates come from report_date or onset_date, else the ISO week, else the month, else the year of the row; rows without any
    have no period. Numbers may have a decimal comma; unreadable ones give no observation. Of columns of one
    meaning the first filled one counts. Null and unreadable payloads give none.
    """
    cells = F.filter(F.map_entries(F.from_json("payload", "map<string,string>")), lambda c: F.trim(c["value"]) != "")
    named = records.select("bronze_record_id", "dataset_id", F.transform(cells, lambda c: F.struct(meaning(c["key"]).alias("name"), F.trim(c["value"]).alias("value"))).alias("cells"))

    def cell(name: str) -> Column:
        return F.get(F.filter("cells", lambda c: c["name"] == name), 0)["value"]

    day = F.coalesce(F.expr("try_cast(report_date as date)"), F.expr("try_cast(onset_date as date)"))
    year, month, week = (F.expr(f"try_cast({c} as int)") for c in ("year", "month", "week"))
    wide = named.select("bronze_record_id", "dataset_id", "cells", *[cell(c).alias(c) for c in (*DESCRIBES, "report_date", "onset_date", "year", "month", "week")])
    dated = wide.withColumn("day", day).withColumn("y", year).withColumn("m", F.when(month.between(1, 12), month)).withColumn("w", F.when(week.between(1, 53), week))
    grain = F.when(F.col("day").isNotNull(), "day").when(F.col("y").between(1900, 2100) & F.col("w").isNotNull(), "week").when(F.col("y").between(1900, 2100) & F.col("m").isNotNull(), "month").when(F.col("y").between(1900, 2100), "year")
    start = F.when(F.col("grain") == "day", F.col("day")).when(F.col("grain") == "week", t.iso_week_start(F.col("y"), F.col("w"))).when(F.col("grain") == "month", F.make_date("y", "m", F.lit(1))).when(F.col("grain") == "year", F.make_date("y", F.lit(1), F.lit(1)))
    measured = dated.withColumn("grain", grain).withColumn("period_start", start).select(
        "bronze_record_id", "dataset_id", *DESCRIBES, "grain", "period_start",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), t.loader_number(cell(m)).alias("value")) for m in MEASURES])).alias("o"),
    )
    rows = measured.select("bronze_record_id", "dataset_id", "o.metric", "o.value", *DESCRIBES, "grain", "period_start").where("value is not null")
    return rows.withColumn("observation_hash", F.sha2(F.to_json(F.struct("dataset_id", "metric", "value", *DESCRIBES, "grain", "period_start"), {"ignoreNullFields": "false"}), 256))


def publish(found: DataFrame) -> DataFrame:
    """Facts: one row per observation hash with a period, from the smallest bronze record, and how many records state it."""
    first = found.where("period_start is not null").groupBy("observation_hash").agg(F.min(F.struct("bronze_record_id", *[c for c in found.columns if c not in ("bronze_record_id", "observation_hash")])).alias("f"), F.count_distinct("bronze_record_id").alias("records"))
    return first.select("observation_hash", "f.*", "records")


def usable_shares(found: DataFrame) -> DataFrame:
    """Per metric: observations, and the shares with a period, a place, a disease, and a value of zero or more."""
    place = F.coalesce("facility", "subdistrict", "district", "province").isNotNull()
    shares = {"with_period": F.col("period_start").isNotNull(), "with_place": place, "with_disease": F.col("disease").isNotNull(), "not_negative": F.col("value") >= 0}
    return found.groupBy("metric").agg(F.count(F.lit(1)).alias("observations"), *[F.avg(c.cast("double")).alias(n) for n, c in shares.items()])
