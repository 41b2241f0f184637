import datetime as dt
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.operators import drift, intervals, units

SILVER = "silver_observation_id long, metric string, value_numeric double, value_text string, unit string, provenance string, quantity string, units int"
REF = [("mean_temperature", "celsius", "celsius", 1.0, 0.0), ("mean_temperature", "fahrenheit", "celsius", 5 / 9, -160 / 9), ("mean_temperature", "kelvin", "celsius", 1.0, -273.15),
       ("population", "people", "people", 1.0, 0.0), ("population", "thousand_people", "people", 1e3, 0.0), ("population", "million_people", "people", 1e6, 0.0), ("cases", "cases", "cases", 1.0, 0.0), ("cases", "thousand_cases", "cases", 1e3, 0.0)]


def converted(spark, items):
    df = spark.createDataFrame([(i, m, v, t, u, json.dumps({"source_record": {"note": n}}) if n else None, "clash", 1) for i, (m, v, t, u, n) in enumerate(items)], SILVER)
    ref = spark.createDataFrame(REF, "quantity string, unit_code string, common_unit string, factor double, shift double")
    return [(r.unit_code, r.unit_origin, None if r.value_common is None else round(r.value_common, 3)) for r in units.harmonise(df, ref).orderBy("silver_observation_id").collect()]


def test_where_units_are_read(spark):
    assert converted(spark, [
        ("suhu_rata_rata", 77.0, None, " °F ", None), ("mean_temperature", 300.0, "300 K", None, None), ("mean_temperature_f", 50.0, None, "", None),
        ("population", 1.5, None, None, "satuan: juta jiwa"), ("jumlah_penduduk", 80.0, None, None, "late submission"), ("mean_temperature", 86.0, "about 86", None, None),
        ("cases", 0.012, None, None, None), ("cases", 12.0, "12", "furlongs", None), ("unknown", 3.0, None, None, None), (None, None, None, None, None), ("cases", None, "n/a", "kasus", None),
    ]) == [
        ("fahrenheit", "field", 25.0), ("kelvin", "text", 26.85), ("fahrenheit", "metric", 10.0), ("million_people", "note", 1500000.0), ("thousand_people", "size", 80000.0), ("fahrenheit", "size", 30.0),
        ("thousand_cases", "size", 12.0), ("cases", "default", 12.0), (None, None, None), (None, None, None), ("cases", "field", None),
    ]


def test_gaps_and_continuations(spark):
    d = dt.date
    rows = [(1, d(2024, 1, 1), d(2024, 1, 10), "custom"), (1, d(2024, 1, 5), d(2024, 1, 7), "custom"), (1, d(2024, 1, 11), d(2024, 1, 12), None), (1, d(2024, 1, 15), None, "week "), (1, d(2024, 1, 15), None, "week "),
            (1, d(2024, 2, 1), d(2024, 1, 1), "week"), (1, None, d(2024, 5, 1), "week"), (2, d(2024, 2, 10), None, "bulanan"), (2, d(2024, 4, 5), None, "quarter"), (None, d(2024, 1, 1), None, "day"), (None, d(2024, 1, 3), None, "Harian")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "dataset_id long, period_start date, period_end date, temporal_resolution string, step string")
    got = {tuple(r) for r in intervals.gaps(df).collect()}
    assert got == {(1, "2024-01-13", "2024-01-14"), (2, "2024-03-01", "2024-04-04"), (None, "2024-01-02", "2024-01-02")}
    assert intervals.gaps(df.where("false")).count() == 0


def test_number_and_unit_in_text_only(spark):
    schema = "silver_observation_id long, source_id string, metric string, unit string, value_numeric double, value_text string, provenance string"
    rows = [(1, "a", "cases", None, None, "37 cases", None), (2, "a", "curah_hujan", None, None, "5,5 inches", None), (3, "a", "rainfall", "''", 2.0, "2", None), (4, "a", "population", None, None, "1.234.567 jiwa", None), (5, "a", "rainfall", None, None, "nihil", None), (6, "a", "rainfall", None, None, "about 1,204.5 mm", None), (7, "a", "rainfall", "", 2.0, None, None), (8, None, "rainfall", None, 2.0, None, None)]
    df = spark.createDataFrame(rows, schema)
    reference = spark.createDataFrame([("cases", "cases", "cases", 1.0, 0.0), ("rainfall", "mm", "mm", 1.0, 0.0), ("rainfall", "inch", "mm", 25.4, 0.0), ("population", "people", "people", 1.0, 0.0)], "quantity string, unit_code string, common_unit string, factor double, shift double")
    got = {r.silver_observation_id: (r.unit_code, r.unit_origin, r.value_common) for r in units.harmonise(df, reference).collect()}
    assert got[1] == ("cases", "text", 37.0) and got[2] == ("inch", "text", pytest.approx(139.7)) and got[3] == ("inch", "field", 50.8)
    assert got[4][2] == 1234567.0 and got[5][2] is None and got[6][2] == 1204.5 and got[7] == ("mm", "default", 2.0)
    usual = units.source_defaults(df.where("silver_observation_id <> 6"), reference)
    by_source = {r.silver_observation_id: (r.unit_code, r.unit_origin) for r in units.harmonise(df, reference, defaults=usual).collect()}
    assert by_source[7] == ("inch", "source") and by_source[8] == ("mm", "default")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), min_size=1, max_size=25))
def test_sweep_against_brute_force(spark, spans):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, day + dt.timedelta(a), day + dt.timedelta(a + n), "x") for a, n in spans], "dataset_id long, period_start date, period_end date, temporal_resolution string")
    covered = {a + k for a, n in spans for k in range(n + 1)}
    open_ = [k for k in range(min(covered), max(covered)) if k not in covered]
    got = [(r.first_day - day).days + k for r in intervals.sweep(intervals.closed_intervals(df, "dataset_id")).where("kind = 'gap'").collect() for k in range((r.last_day - r.first_day).days + 1)]
    assert sorted(got) == open_


def drifted(spark, versions, payloads=()):
    datasets = spark.createDataFrame([(i, n, s, c, dt.datetime(2024, 1, 1) + dt.timedelta(days=day)) for i, n, s, c, day in versions], "dataset_id long, dataset_name string, schema_json string, column_count int, loaded_at timestamp")
    records = spark.createDataFrame([(k, i, k, json.dumps(p) if p is not None else None) for k, (i, p) in enumerate(payloads)], "bronze_record_id long, dataset_id long, row_number long, payload string")
    return datasets, records


def test_schema_changes(spark):
    typed = lambda **c: json.dumps({"columns": [{"name": k.replace("_", " ").upper(), "type": v} for k, v in c.items()]})
    datasets, records = drifted(spark, [
        (5, "f", typed(suhu="double", jumlah_kasus="int"), 2, 0), (3, "f", json.dumps({"fields": {"suhu": "text", "total_kasus": "bigint", "klb": "bool"}}), 3, 1),
        (9, "f", json.dumps({"columns": ["klb", "suhu", "week"]}), 4, 2), (10, "f", "{}", 2, 3), (11, None, "{}", None, 1), (12, "g", None, 0, 1),
    ], [(10, {"suhu": "21", "Week": 3}), (10, {"suhu": None, "Week": 4}), (99, {"x": 1}), (10, None)])
    got = {tuple(r) for r in drift.schema_changes(datasets, records).collect()}
    assert got == {(3, "retyped", "suhu", "suhu"), (3, "renamed", "jumlah_kasus", "total_kasus"), (3, "added", "", "klb"), (9, "removed", "total_kasus", ""), (9, "added", "", "week"), (9, "count_mismatch", "", ""), (10, "removed", "klb", "")}


def test_unified_rows(spark):
    datasets, records = drifted(spark, [(1, "f", json.dumps({"fields": {"cases": "int", "lat": "text"}}), 2, 0), (2, "f", json.dumps({"fields": {"jml_kasus": "int", "lat": "text"}}), 2, 1)], [(1, {"cases": 4, "lat": "1,25"}), (2, {"jml_kasus": 5, "lat": ""}), (7, {"z": 1})])
    got = {r.bronze_record_id: r["values"] for r in drift.unified_rows(datasets, records).collect()}
    assert got == {0: {"jml_kasus": "4", "lat": "1.25"}, 1: {"jml_kasus": "5", "lat": None}, 2: {"z": "1"}}


def test_renames_by_content_alone(spark):
    """Names without a common letter are matched by their values; columns of other content in the same place are not."""
    rng = np.random.default_rng(1)
    towns, sexes = [f"Town {c}" for c in "abcdef"], ["male", "female"]
    row = lambda: {"qqq": str(rng.choice(towns)), "vvv": int(rng.poisson(300)), "www": str(rng.choice(sexes))}
    first = [row() for _ in range(30)]
    second = [{"xyz": r["qqq"], "kk": r["vvv"], "www": r["www"]} for r in (row() for _ in range(30))]
    third = [{"date": f"2024-01-{k + 1:02d}", "kk": r["vvv"], "www": r["www"]} for k, r in enumerate(row() for _ in range(30))]
    datasets, records = drifted(spark, [(i, "f", "{}", 3, i) for i in (1, 2, 3)], [(i, p) for i, rows in ((1, first), (2, second), (3, third)) for p in rows])
    got = {tuple(r) for r in drift.schema_changes(datasets, records).collect()}
    assert got == {(2, "renamed", "qqq", "xyz"), (2, "renamed", "vvv", "kk"), (3, "removed", "xyz", ""), (3, "added", "", "date")}


def test_unified_rows_keep_everything(spark):
    """Kinds are unified, what can't be read stays as written, and no value is lost where two columns come to one name."""
    v = [(1, "f", json.dumps({"fields": {"n": "int", "d": "date"}}), 2, 0), (2, "f", json.dumps({"fields": {"n": "double", "d": "date"}}), 2, 1)]
    datasets, records = drifted(spark, v, [(1, {"n": "3", "d": "2024-02-01 10:00:00", "N": "4"}), (2, {"n": "2,5", "d": "soon"})])
    rows = {r.bronze_record_id: r for r in drift.unified_rows(datasets, records).collect()}
    assert rows[0]["values"] == {"n": "3.0", "d": "2024-02-01"} and rows[0]["others"] == {"n": ["4"]} and rows[0]["unread"] == {}
    assert rows[1]["values"] == {"n": "2.5", "d": None} and rows[1]["unread"] == {"d": "soon"}
    assert {tuple(r) for r in drift.unified_columns(datasets, records).collect()} == {("f", "n", "decimal", 2), ("f", "d", "date", 2)}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_matching_is_optimal(n, m, seed):
    from itertools import permutations

    score = np.random.default_rng(seed).random((n, m))
    best = max(sum(score[i, j] for i, j in zip(range(n), p)) for p in permutations(range(m), n)) if n <= m else max(sum(score[i, j] for j, i in enumerate(p)) for p in permutations(range(n), m))
    pairs = drift.assign(score)
    assert len(pairs) == min(n, m) and abs(sum(score[i, j] for i, j in pairs) - best) < 1e-9
