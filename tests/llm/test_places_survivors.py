import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import places, survivors

REF = "place_id long, place_level string, place_name string, parent_id long, aliases string"
PLACES = [
    (1, "admin_1", "Kepulauan Arundaya", None, None), (2, "admin_1", "Bromelia Timur", None, "Sinatoma|Varulen"),
    (11, "admin_2", "Kabupaten Kestramun", 1, None), (12, "admin_2", "Kota Kestramun", 1, None), (13, "admin_2", "Kabupaten Wolindra", 2, None), (14, "admin_2", "Kabupaten Wolindra", 1, None),
    (101, "facility", "Puskesmas Trevanuli", 11, None), (102, "facility", "Puskesmas Trevanuli", 13, "Puskesmas Lama"), (103, "facility", "Rumah Sakit Umum Daerah Gondaria", 13, None),
]
SILVER = "silver_observation_id long, admin_1 string, admin_2 string, facility_name string, key string, level string, places int"


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(PLACES, REF)


def mapped(spark, reference, rows):
    df = spark.createDataFrame([(i, *r, "clash", "clash", 0) for i, r in enumerate(rows)], SILVER)
    return {(r.silver_observation_id, r.field_name): r.place_id for r in places.free_entries(df, reference).collect()}


def test_spellings(spark, reference):
    got = mapped(spark, reference, [
        ("KEP. ARUNDAYA", "Kab Kestramun (revisi)", "PKM Trevanuli"), ("bromelia tmr", "wolindra, Kabup.", "puskesmastrevanúli *"), ("Sinatoma", "KOTA KESTRMAUN", "R.S.U.D. G0ndaria"),
        ("Arundaya ", " ", None), ("luar wilayah", None, "Klinik Xyzzy"), ("Bromelia Timur", "Kabupaten Wolindra", "Puskesmas Trevanuli"), (None, None, None),
    ])
    assert got == {
        (0, "admin_1"): 1, (0, "admin_2"): 11, (0, "facility_name"): 101, (1, "admin_1"): 2, (1, "admin_2"): 13, (1, "facility_name"): 102, (2, "admin_1"): 2, (2, "admin_2"): 12, (2, "facility_name"): 103,
        (3, "admin_1"): 1, (4, "admin_1"): 0, (4, "facility_name"): 0,
    }


def test_empty(spark, reference):
    assert mapped(spark, reference, []) == {}
    assert mapped(spark, reference.where("false"), [("Arundaya", None, None)]) == {(0, "admin_1"): 0}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10**6))
def test_no_pair_within_the_edits_is_lost(spark, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 11)))
    names, known = sorted({word() for _ in range(40)}), sorted({word() for _ in range(40)})
    limit = lambda k: 0 if len(k) <= 3 else 1 if len(k) <= 6 else 2
    left = spark.createDataFrame([("x", n) for n in names], "level string, core string")
    right = spark.createDataFrame([("x", "", k, i) for i, k in enumerate(known)], "level string, kind string, core string, place_id long")
    got = {(r.core, r.place_id, r.edits) for r in places.near_names(left, right).collect()}
    assert got == {(n, i, edits(n, k)) for n in names for i, k in enumerate(known) if edits(n, k) <= limit(k)}


PANEL = "observation_key string, source_record string, province string, year int, metric string, value double, unit string, source_url string, quality_status string, retrieved_at timestamp, rows int, first_key string"


def test_field_by_field(spark, reference):
    t = lambda day: dt.datetime(2024, 1, day)
    rows = [
        ("a", "zenodo:20000001", "Kep. Arundaya", 2020, "cases", None, "cases", None, "VALID", t(9)), ("b", "20 000 001", "ARUNDAYA", 2020, "cases", 5.0, None, "u1", "review-required", t(1)),
        ("c", "https://x/record/20000001", "Kepulauan Arundaya", 2020, "cases", 6.0, "people", "u2", "Review Required", t(2)), ("d", "20000001", "arundaya", 2020, "cases", 7.0, None, "u3", "conflict", t(20)),
        ("e", "20000002", "Nowhere", 2020, "cases", float("nan"), None, None, None, t(1)), ("f", "20000002", "nowhere ", 2020, "Cases", None, " ", None, "valid", None),
        ("g", "20000003", "Arundaya", 2020, "cases", 1.0, None, None, "valid", t(1)), ("h", None, None, None, None, None, None, None, None, None), ("i", None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, 3, "clash") for r in rows], PANEL)
    got = {tuple(r) for r in survivors.duplicate_groups(df, reference).collect()}
    assert got == {("a", "c", "a", "c"), ("e", "", "", "")}
    assert survivors.duplicate_groups(df.where("false"), reference).count() == 0
