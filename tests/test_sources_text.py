import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.functions import periods
from tidewell.functions import text as t
from tidewell.operators import medallion as m
from tidewell.operators import panel as pn
from tidewell.operators import parse
from tidewell.sources import files, sinks
from tidewell.streaming import alarms


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_bytes("tahun;kasus\n2020;5\n2021;\n".encode())
    (tmp_path / "b.csv").write_bytes("nama,nilai\ncaf\xe9,1\n".encode("latin-1"))
    (tmp_path / "c.json").write_text(json.dumps([{"x": {"y": 1}}, {"x": {"y": None}, "z": "s"}]))
    (tmp_path / "e.csv").write_text("\n")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("in.csv", "p\tq\n1\t2\n")
        z.writestr("bad.json", "{")
    return tmp_path


def test_cells_and_status(spark, folder):
    got = {(r.path.rsplit("/", 1)[1], r.member, r.row_number, r.column_number): r.value for r in files.cells(spark, str(folder)).collect()}
    assert got["a.csv", "", 2, 2] == "5" and ("a.csv", "", 3, 2) not in got and got["b.csv", "", 2, 1] == "café" and got["d.zip", "in.csv", 2, 2] == "2" and got["c.json", "", 2, 1] == "1"
    status = {r.path.rsplit("/", 1)[1]: r.status for r in files.read_status(spark, str(folder)).collect()}
    assert status["a.csv"] == "read" and "Error" in status["e.csv"] and "Error" in status["d.zip"]
    known = files.inventory(spark, str(folder))
    assert known.count() == 5 and files.inventory(spark, str(folder), known.where("path like '%a.csv'")).count() == 4


def test_json(spark):
    df = spark.createDataFrame([(1, '{"summary": [{"cases": 3}, {"cases": 5}]}'), (2, "{"), (3, None)], "id long, j string")
    assert {tuple(r) for r in files.json_paths(df, "id", "j").collect()} == {(1, "summary[0].cases", "3"), (1, "summary[1].cases", "5")}
    df = spark.createDataFrame([(1, '[{"a": 1}, {"b": "x"}]')], "id long, j string")
    assert [r.position for r in files.json_records(df, "id", "j").orderBy("position").collect()] == [0, 1]
    assert files.table_cells(spark.createDataFrame([(1, "x", None)], "id long, a string, b string"), "id").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", None)], "id long, part string, list array<int>")
    sinks.export(df, str(tmp_path / "out"), "t")
    assert spark.read.parquet(str(tmp_path / "out/parquet/t")).where("id = 1").collect()[0]["list"] == "[1,2]"
    assert sinks.manifest(spark, str(tmp_path / "out/csv")).count() >= 1
    path = str(tmp_path / "parts")
    for _ in range(2):
        sinks.replace_partitions(df, path, ["part"])
    sinks.replace_partitions(df.where("id = 2").withColumn("id", F.lit(9).cast("long")), path, ["part"])
    assert {r.id for r in spark.read.parquet(path).collect()} == {1, 9}
    assert sinks.append_new(df, str(tmp_path / "log"), "id", spark) == 2 and sinks.append_new(df, str(tmp_path / "log"), "id", spark) == 0
    for status in ("started", "complete"):
        sinks.log_run(spark, str(tmp_path / "runs"), "r1", status)
    assert sinks.run_states(spark, str(tmp_path / "runs")).collect()[0].status == "complete"


def test_numbers_and_words(spark):
    df = spark.createDataFrame([("1,5",), ("1.234,5",), ("1,234",), ("nihil",), (" 12 % ",), (None,), ("abc",), ("1,234,567.8",)], "v string")
    rows = df.select(t.loader_number("v").alias("a"), t.table_number("v").alias("b"), t.portal_number("v").alias("c"), t.digits("v").alias("d")).collect()
    assert [r.a for r in rows] == [1.5, 1.2345, 1.234, None, None, None, None, 1234567.8]
    assert [r.b for r in rows] == [1.5, 1234.5, 1234.0, None, 12.0, None, None, 1234567.8]
    assert [r.c for r in rows] == [15, 12345, 1234, 0, None, None, None, 12345678] and rows[4].d == 12
    df = spark.createDataFrame([("Laporan Déngue, Agustus 2021",), (None,)], "v string")
    r = df.select(t.slug("v").alias("s"), t.year("v").alias("y"), t.month("v").alias("m"), t.fold("v").alias("f")).collect()
    assert tuple(r[0]) == ("laporan_dengue_agustus_2021", 2021, 8, "laporan dengue, agustus 2021") and tuple(r[1]) == (None, None, None, None)
    one = spark.range(1).select(t.iso_week_start(F.lit(2020), F.lit(53)).alias("w"), t.first_match(F.lit("dbd"), [("malaria", "mal"), ("dengue", "dbd")], "other").alias("d"), t.tags(F.lit("dbd mal"), [("m", "mal"), ("d", "dbd")]).alias("g")).collect()[0]
    assert tuple(one) == (dt.date(2020, 12, 28), "dengue", "m; d")


def test_period_numbers_round_trip():
    import numpy as np

    days = np.arange(-400, 30000, 7)
    for g in range(5):
        grain = np.full(len(days), g)
        start = periods.ordinal_start(periods.ordinal(days, grain), grain)
        assert (start <= days).all() and (periods.ordinal(start, grain) == periods.ordinal(days, grain)).all()


def test_lags_are_calendar_lags(spark):
    rows = [("a", dt.date(2023, 1, 1), 7.0), ("a", dt.date(2023, 3, 1), 9.0), ("a", dt.date(2023, 4, 1), 11.0), ("b", dt.date(2023, 1, 1), 1.0), ("b", dt.date(2023, 1, 1), 2.0), (None, dt.date(2023, 1, 1), 2.0)]
    out = {r.period_start: r for r in pn.calendar_lags(spark.createDataFrame(rows, "k string, period_start date, v double"), ["k"], "v").collect()}
    assert len(out) == 3 and out[rows[1][1]].lag_1 is None and out[rows[2][1]].lag_1 == 9 and out[rows[2][1]].prior_3 is None


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k long, at long, v string")
    new = spark.createDataFrame([(1, 5, "n"), (2, 4, "n"), (3, 1, "n")], "k long, at long, v string")
    assert {r.k: r.v for r in m.upsert(old, new, ["k"], "at").collect()} == {1: "n", 2: "b", 3: "n"}
    assert {r.k: r.v for r in m.insert_missing(old, new, ["k"], ["at"]).collect()} == {1: "a", 2: "b", 3: "n"}


def test_digest_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    digests = {m.snapshot_digest(df.repartition(n), "id", F.col("h")).collect()[0].digest for n in (1, 7)}
    assert len(digests) == 1 and m.snapshot_digest(df.where("id <> 3"), "id", F.col("h")).collect()[0].digest not in digests


def test_parsers(spark):
    docs = spark.createDataFrame([(1, "In week 3 of 2021, Puskesmas A reported 1,204 cases of typhoid fever, more. Pada minggu ke-60 tahun 2021, Klinik B melaporkan 5 kasus campak."), (2, None), (3, "Text\n| tahun | kasus |\n| --- | --- |\n| 2020 | 1.204 |\n| 2021 | x |")], "doc_id long, text string")
    assert [(r.place, r.cases, r.disease, r.week_start) for r in parse.weekly_reports(docs).collect()] == [("Puskesmas A", 1204, "typhoid fever", dt.date(2021, 1, 18))]
    assert [(r.label, r.measure, r.value) for r in parse.parse_tables(parse.markdown_cells(docs), "table_key").collect()] == [("2020", "kasus", 1204.0)]
    payload = spark.createDataFrame([(1, ["1", "3"], [3, 9]), (2, ["1"], [3, 9])], "id long, l array<string>, v array<int>")
    assert [(r.label, r.value) for r in parse.dashboard_series(payload, "id", "l", "v").orderBy("position").collect()] == [("1", 3), ("3", 9)]
    assert spark.range(1).select(files.personal_register(F.lit("No | Nama | Umur | Alamat"))).collect()[0][0]


def test_stream_alarms(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("k", start + dt.timedelta(hours=i), 10.0 + i % 2 if i != 20 else 500.0) for i in range(30)] + [("k", start + dt.timedelta(hours=31), None)]
    spark.createDataFrame(rows, "key string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    query = alarms.ewma_alarms(stream).writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.value for r in spark.table("alarms").where("alarm").collect()] == [500.0] and spark.table("alarms").count() == 30
