import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import audits as a
from tidewell.operators import normalise as n
from tidewell.operators import panel as p


def records(spark, payloads):
    return spark.createDataFrame([(i, d, i, json.dumps(x) if isinstance(x, dict) else x, "clash") for i, (d, x) in enumerate(payloads)], "bronze_record_id long, dataset_id long, row_number long, payload string, title string")


def test_canonical_rows(spark):
    titles = spark.createDataFrame([(1, "Kasus DBD Kabupaten Karimata Tahun 2021"), (2, None)], "dataset_id long, title string")
    df = records(spark, [
        (1, {"Provinsi": "Nusara Timur", "Tahun": 2021, "Bulan": 3, "Jumlah Kasus Laki Laki": "1,5", "Kematian": 2, "Catatan": "7", "Pemeriksaan": "x"}),
        (2, {"district": "Wolindra", "report_date": "2020-02-03 10:00", "cases": 4, "species": "vivax"}), (2, {"year": 2020, "week": 1, "rdt": 5}), (9, {"tahun": "soon", "kasus": 1}), (2, None), (2, "{}"), (2, "broken"),
    ]).drop("title")
    got = {(r.bronze_record_id, r.metric): r for r in n.canonical_rows(df, titles).collect()}
    assert set(got) == {(0, "cases"), (0, "deaths"), (1, "cases"), (2, "malaria_rdt_examinations"), (3, "cases")}
    first = got[0, "cases"]
    assert (first.admin_1, first.admin_2, first.value, first.sex, first.period_start, first.period_end) == ("Nusara Timur", "Kabupaten Karimata", 1.5, "male", dt.date(2021, 3, 1), dt.date(2021, 3, 31))
    assert (got[1, "cases"].admin_2, got[1, "cases"].temporal_resolution, got[1, "cases"].species) == ("Wolindra", "day", "Plasmodium vivax")
    assert got[2, "malaria_rdt_examinations"].period_start == dt.date(2019, 12, 30) and got[3, "cases"].period_start is None


def test_measures_need_numbers(spark):
    df = records(spark, [(1, {"cases": 3, "jumlah kasus": "n/a", "cases_rate": 5}), (1, {"cases": "", "jumlah kasus": "-"}), (1, {"cases": 2}), (1, None)]).drop("title")
    assert [(r.column_name, r.numeric_share) for r in n.measure_columns(df).collect()] == [("cases", 0.5)]
    assert {(r.bronze_record_id, r.total) for r in n.measure_sums(df).collect()} == {(0, 3.0), (2, 2.0)}


def test_counts_and_texts(spark):
    values = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (-1.0,), (0.5,), (float("inf"),)], "v double")
    assert [r.f for r in values.select(n.count_fault(F.col("v")).alias("f")).collect()] == [None, "missing", "missing", "negative", "fractional", "infinite"]
    assert n.checked_counts(values.where("v = 1"), "v").count() == 1
    with pytest.raises(Exception, match="not a count: negative"):
        n.checked_counts(values.where("v = -1"), "v").collect()
    one = spark.range(1).select(n.restored_text(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)))).alias("t"), n.restored_text(F.lit(None).cast("map<string,array<int>>")).alias("e"))
    assert tuple(one.first()) == ("a b a", None)
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in (("x", "1"), ("y", "2"), ("x", "3"), ("x", "1"))])
    assert spark.range(1).select(n.qualifiers(pairs).alias("m")).first().m == {"x": "1; 3", "y": "2"}


def test_verdicts_and_merge(spark):
    known = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), ("b", None)], "k string, v double")
    new = spark.createDataFrame([("a", 2.0), ("a", 5.0), ("b", 1.0), (None, 3.0), ("a", None)], "k string, v double")
    got = {(r.k, r.v): r.baseline_match for r in a.verdicts(new, known, ["k"], "v").collect()}
    assert got == {("a", 2.0): "same_count_present", ("a", 5.0): "different_count_present", ("b", 1.0): "no_exact_match", (None, 3.0): "no_exact_match", ("a", None): "different_count_present"}
    assert a.merge_one(new, known.where("v = 1"), ["k"]).count() == 5
    with pytest.raises(Exception, match="repeated key: a"):
        a.merge_one(new, known, ["k"]).collect()


def test_totals_only_where_complete(spark):
    df = spark.createDataFrame([(1, "m", 2.0), (1, "f", 3.0), (2, "m", 2.0), (3, "m", 1.0), (3, "f", None), (4, "m", 1.0), (4, "m", 1.0), (None, "m", 1.0), (None, "f", 1.0)], "k int, sex string, v double")
    assert {(r.k, r.total) for r in a.complete_totals(df, ["k"], F.col("sex"), ["m", "f"], "v").collect()} == {(1, 5.0), (None, 2.0)}


def test_hot_and_null_keys(spark):
    """A third of the rows in one key, and null keys: counters, conflicts and coverage keep every row."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), (F.col("id") % 7).cast("double").alias("v"), F.lit(dt.date(2024, 1, 1)).alias("period_start"))
    got = {r.check_name: (r.failing, r.rows) for r in p.quality_counters(df, ["k"], "v").collect()}
    assert got["key_repeated"] == (2000, 3000) and got["value_zero"] == (429, 3000)
    flags = a.conflicts(df, ["k"], "v")
    assert flags.count() == 3000 and flags.where("conflict").count() == 2000
    assert a.key_coverage(df, "k", ["period_start"], "period_start").agg(F.sum("rows")).first()[0] == 3000
    empty = df.where("false")
    assert p.quality_counters(empty, ["k"], "v").first().rows == 0 and a.conflicts(empty, ["k"], "v").count() == 0


def test_years_and_words_of_the_data(spark):
    df = spark.createDataFrame([("a", dt.date(1977, 5, 1), 2.0), ("a", dt.date(2031, 5, 1), 3.0), ("b", dt.date(1977, 1, 1), 1.0), ("b", None, 1.0)], "k string, period_start date, v double")
    assert {tuple(r) for r in p.melt_years(p.by_years(df, ["k"], "v"), ["k"], "v").collect()} == {("a", "1977", 2.0), ("a", "2031", 3.0), ("b", "1977", 1.0)}
    words = spark.createDataFrame([("a", "year"), ("a", None), ("b", "dekad"), (None, "year")], "m string, w string")
    assert p.coverage_cells(words, "m", "w").count() == 9


def test_canonical_columns(spark):
    df = spark.createDataFrame([("7", "x", "z")], "cases string, day string, more string")
    row = n.canonical(df, {"day": "date", "cases": "double", "native": "boolean"}, {"native": True}).first()
    assert tuple(row) == (None, 7.0, True)
    assert spark.range(1).select(n.admin_level(F.lit("Admin 2"), {}).alias("a"), n.admin_level(F.lit(None), {"admin1": F.lit("x"), "admin2": F.lit(" ")}).alias("b")).first() == ("admin2", "admin1")
