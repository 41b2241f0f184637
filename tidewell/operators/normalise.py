"""Raw rows of any shape brought to canonical columns: columns by patterns, measures, places, periods, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.drift import column_name

# Patterns of column names by what they hold, in order of preference.
COLUMN_PATTERNS = {
    "admin_1": (r"nama_provinsi", r"^provinsi$", r"^province$", r"^prov$"),
    "admin_2": (r"nama_kabupaten_kota", r"nama_kabupatenkota", r"nama_kabupaten", r"^kabupaten$", r"^kota$", r"^kab_kota$", r"^district$"),
    "admin_3": (r"nama_kecamatan", r"^kecamatan$", r"^district_name$", r"^subdistrict$"),
    "admin_4": (r"^kelurahan$", r"^desa$", r"nama_kelurahan", r"nama_desa"),
    "facility_name": (r"nama_puskesmas", r"puskesmas", r"fasilitas", r"faskes", r"sarana_kesehatan", r"^facility$"),
    "day": (r"^report_date$", r"^tanggal_lapor$", r"^tgl_lapor$", r"^onset_date$", r"^tanggal_onset$", r"^tgl_onset$"),
    "year": (r"^(year|tahun|thn|tahun_laporan)$",),
    "month": (r"^(month|bulan|bln|bulan_ke|bulan_laporan)$",),
    "week": (r"^(week|epiweek|minggu|minggu_ke)$",),
    "sex": (r"^(sex|gender|jenis_kelamin|jk)$",),
    "species": (r"^(species|spesies|jenis_vektor)$",),
    "disease": (r"^(disease|penyakit|nama_penyakit)$",),
    "unit": (r"^satuan", r"^unit"),
}
# Columns that describe a row and measure nothing.
DESCRIPTORS = r"^(note|catatan|keterangan|officer_code|petugas_kode|kode_petugas|source|origin|sumber|sumber_data|verified|terverifikasi|sudah_verifikasi|outbreak_flag|klb|status_klb|age_group|kelompok_umur|umur|longitude|bujur|lon|latitude|lintang|lat)$"
# The metric of a column by the first pattern its name matches; {} is the disease.
METRIC_RULES = (
    ("cfr|crf|fatality", "case_fatality_rate"),
    ("meninggal|kematian|death", "deaths"),
    ("suspek|suspect", "suspected_cases"),
    ("falciparum", "plasmodium_falciparum"),
    ("vivax", "plasmodium_vivax"),
    ("knowlesi", "plasmodium_knowlesi"),
    ("malariae", "plasmodium_malariae"),
    ("ovale", "plasmodium_ovale"),
    ("konfirmasi.*mikroskop|mikroskop.*konfirmasi", "malaria_microscopy_confirmed"),
    ("konfirmasi.*rdt|rdt.*konfirmasi|konfirmasi.*rapid_diagnostic", "malaria_rdt_confirmed"),
    ("mikroskop", "malaria_microscopy_examinations"),
    ("rdt|rapid_diagnostic", "malaria_rdt_examinations"),
    ("pemeriksaan|diperiksa|exam", "{}_examinations"),
    ("pengobatan|pengaobatan|treatment", "{}_standard_treatment"),
    ("fogging", "fogging_locations"),
    (r"angka_bebas_jentik|\babj\b", "aedes_larva_free_index"),
    ("jentik|larva", "larval_surveillance_value"),
    ("anopheles.*habitat|habitat.*anopheles", "anopheles_habitat_index"),
    (r"incidence|angka_kesakitan|\bapi\b", "incidence_rate"),
    ("positif|postif|confirmed|konfirmasi", "confirmed_cases"),
    ("persentase|percent|cakupan", None),
    ("kasus|penderita|pasien|case", "cases"),
)
SPECIES = ("falciparum", "vivax", "knowlesi", "malariae", "ovale")
# Names of columns that count cases, and of those that don't although they look so.
MEASURE_NAMES = r"(dengue|dbd|demam_berdarah|jumlah_kasus|jumlah_penderita|cases?)"
NO_MEASURE_NAMES = r"(kematian|meninggal|death|fatal|rate|rasio|persen|cfr|ir)"


def canonical(df: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """``df`` with exactly ``columns`` (name to type) in their order: missing ones null, unreadable values null, nulls by ``defaults``."""

    def one(name: str, kind: str) -> Column:
        have = F.col(f"`{name}`").try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        default = (defaults or {}).get(name)
        return (have if default is None else F.coalesce(have, F.lit(default).cast(kind))).alias(name)

    return df.select(*[one(n, k) for n, k in columns.items()])


def entries(payload: Column) -> Column:
    """The cells of a JSON object as (name, text), names in lower case with underscores, in the order of the payload; blank texts are null."""
    cells = F.map_entries(F.from_json(payload, "map<string,string>"))
    return F.transform(cells, lambda c: F.struct(column_name(c["key"]).alias("name"), F.when(F.trim(c["value"]) != "", F.trim(c["value"])).alias("text")))


def first_of(cells: Column, patterns: tuple[str, ...]) -> Column:
    """The first text under a name that matches the earliest of ``patterns``; null if none does."""

    def under(pattern: str) -> Column:
        return F.get(F.filter(cells, lambda c: c["name"].rlike(pattern) & c["text"].isNotNull()), F.lit(0))["text"]

    return F.coalesce(*[under(p) for p in patterns])


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def metric_of(name: Column, disease: Column) -> Column:
    """The metric of a column by METRIC_RULES; names of shares keep theirs, others too, and an empty name is the disease's value."""
    out = F.when(name != "", name).otherwise(F.concat(disease, F.lit("_value")))
    for pattern, metric in reversed(METRIC_RULES):
        to = name if metric is None else F.concat(disease, F.lit(metric[2:])) if metric.startswith("{}") else F.lit(metric)
        out = F.when(name.rlike(pattern), to).otherwise(out)
    return out


def sex_of(text: Column) -> Column:
    t = F.lower(text)
    woman = t.rlike("perempuan|wanita|female")
    return F.when(t.rlike("total|seluruh|laki_laki_dan_perempuan"), "all").when(t.rlike("laki|pria|male") & ~woman, "male").when(woman, "female")


def species_of(text: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(text).contains(s), F.lit(f"Plasmodium {s}")) for s in SPECIES])


def unit_of(stated: Column, metric: Column) -> Column:
    return F.coalesce(stated, F.when(metric.rlike("rate|percent|persentase|index"), "percent").otherwise("count"))


def period_of(cells: Column) -> dict[str, Column]:
    """period_start, period_end and temporal_resolution from the date, or the year with its week or month, or the year alone."""
    day = F.regexp_extract(first_of(cells, COLUMN_PATTERNS["day"]), r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    year, month, week = (number(first_of(cells, COLUMN_PATTERNS[k])).cast("int") for k in ("year", "month", "week"))
    known = year.between(1900, 2100)
    weekly = F.when(known & week.between(1, 53), F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), 7 * (week - 1)))
    monthly = F.when(known & month.between(1, 12), F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1)))
    yearly = F.when(known, F.make_date(year, F.lit(1), F.lit(1)))
    grain = F.when(day.isNotNull(), "day").when(weekly.isNotNull(), "week").when(monthly.isNotNull(), "month").when(yearly.isNotNull(), "year")
    end = F.when(day.isNotNull(), day).when(weekly.isNotNull(), F.date_add(weekly, 6)).when(monthly.isNotNull(), F.last_day(monthly)).when(yearly.isNotNull(), F.make_date(year, F.lit(12), F.lit(31)))
    return {"period_start": F.coalesce(day, weekly, monthly, yearly), "period_end": end, "temporal_resolution": grain}


def measure_columns(records: DataFrame, include: str = MEASURE_NAMES, exclude: str = NO_MEASURE_NAMES, least: float = 0.25) -> DataFrame:
    """(dataset_id, column_name, numeric_share): the columns of each dataset that count something, by name and by ``least`` share of numbers among its rows."""
    rows = records.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"))
    cells = records.select("dataset_id", F.explode(entries(F.col("payload"))).alias("c")).where(F.col("c.name").rlike(include) & ~F.col("c.name").rlike(exclude))
    counted = cells.groupBy("dataset_id", F.col("c.name").alias("column_name")).agg(F.count(number(F.col("c.text"))).alias("numbers"))
    return counted.join(rows, "dataset_id").select("dataset_id", "column_name", (F.col("numbers") / F.col("rows")).alias("numeric_share")).where(F.col("numeric_share") >= least)


def measure_sums(records: DataFrame) -> DataFrame:
    """(bronze_record_id, total): the sum of the measure columns of each row that has a number in one."""
    chosen = measure_columns(records).select("dataset_id", "column_name")
    cells = records.select("bronze_record_id", "dataset_id", F.explode(entries(F.col("payload"))).alias("c")).select("bronze_record_id", "dataset_id", F.col("c.name").alias("column_name"), number(F.col("c.text")).alias("value"))
    return cells.where("value is not null").join(chosen, ["dataset_id", "column_name"], "left_semi").groupBy("bronze_record_id").agg(F.sum("value").alias("total"))


def canonical_rows(records: DataFrame, titles: DataFrame) -> DataFrame:
    """One row per raw row and measure: places, period, metric, sex, species, unit and value, whatever the columns are called.

    ``titles`` has (dataset_id, title); a district missing in the row is read from its title ("Kabupaten X Tahun ..."). Measures are the
    numeric cells that are neither places, periods nor descriptors. Rows without a payload give none; records without a dataset have no title.
    """
    base = records.join(titles.select("dataset_id", "title"), "dataset_id", "left").select("bronze_record_id", "dataset_id", "title", entries(F.col("payload")).alias("cells"))
    cells = F.col("cells")
    places = {k: first_of(cells, COLUMN_PATTERNS[k]) for k in ("admin_1", "admin_2", "admin_3", "admin_4", "facility_name")}
    named = F.regexp_extract("title", r"\b((?:Kabupaten|Kota)\s+[A-Za-z][A-Za-z .'-]+?)(?:\s+Tahun|\s+20\d{2}|$)", 1)
    places["admin_2"] = F.coalesce(places["admin_2"], F.when(named != "", F.trim(named)))
    taken = "|".join(f"({p})" for k in COLUMN_PATTERNS for p in COLUMN_PATTERNS[k])
    wide = base.select(
        "bronze_record_id", "dataset_id", *[v.alias(k) for k, v in places.items()], *[v.alias(k) for k, v in period_of(cells).items()],
        F.lower(F.coalesce(first_of(cells, COLUMN_PATTERNS["disease"]), F.lit("unknown"))).alias("disease"), first_of(cells, COLUMN_PATTERNS["sex"]).alias("row_sex"),
        first_of(cells, COLUMN_PATTERNS["species"]).alias("row_species"), first_of(cells, COLUMN_PATTERNS["unit"]).alias("stated_unit"),
        F.explode(F.filter(cells, lambda c: ~c["name"].rlike(taken) & ~c["name"].rlike(DESCRIPTORS))).alias("c"),
    )
    metric = metric_of(F.col("c.name"), F.col("disease"))
    out = wide.withColumn("value", number(F.col("c.text"))).where("value is not null").withColumn("metric", metric)
    return out.select(
        "bronze_record_id", "dataset_id", *places, "period_start", "period_end", "temporal_resolution", "disease", "metric",
        F.coalesce(sex_of(F.col("c.name")), sex_of(F.col("row_sex"))).alias("sex"), F.coalesce(species_of(F.col("c.name")), species_of(F.col("row_species"))).alias("species"),
        unit_of(F.col("stated_unit"), F.col("metric")).alias("unit"), "value",
    )


def admin_level(supplied: Column, levels: dict[str, Column]) -> Column:
    """admin0 to admin4: as supplied (a digit or a word beginning with admin), else the deepest of ``levels`` that is stated."""
    plain = F.regexp_replace(F.lower(supplied), r"[^0-9a-z]", "")
    given = F.when(plain.rlike(r"^[0-4]$"), F.concat(F.lit("admin"), plain)).when(plain.startswith("admin"), plain)
    deepest = F.lit("admin0")
    for name, column in levels.items():
        deepest = F.when(F.trim(column) != "", name).otherwise(deepest)
    return F.coalesce(given, deepest)


def count_fault(value: Column) -> Column:
    """What keeps a value from being a count: missing, infinite, negative or fractional; null if nothing."""
    return F.when(value.isNull() | F.isnan(value), "missing").when(F.abs(value) == float("inf"), "infinite").when(value < 0, "negative").when(value != F.floor(value), "fractional")


def checked_counts(df: DataFrame, value: str) -> DataFrame:
    """The rows of ``df`` whose ``value`` is a count; the first that isn't stops the job with its fault."""
    fault = count_fault(F.col(value))
    return df.where(F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("not a count: "), fault))).otherwise(F.lit(True)))


def restored_text(index: Column) -> Column:
    """The text of an inverted index (word to its places); an empty one gives an empty text, and a null one null."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " ")


def qualifiers(pairs: Column) -> Column:
    """A map from an array of (name, value): values of one name joined in their first order, each once."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.array_join(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"])), "; "))))


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_]+", "_")
