import datetime as dt

import numpy as np
import pytest

from tidewell.operators import regular_grid as g

SCHEMA = "observation_id long, source_id string, source_subunit string, metric string, temporal_resolution_normalized string, period_start date, value double, published_at timestamp, resolution string, is_filled int"


def rows(spark, items):
    """(source, subunit, word, date, value, published day) with clashing extra columns."""
    made = [(i, s, u, "cases", w, d, v, dt.datetime(2024, 1, p) if p else None, "clash", 7) for i, (s, u, w, d, v, p) in enumerate(items)]
    return spark.createDataFrame(made, SCHEMA)


def test_weeks_with_gap_revision_and_nan(spark):
    d = dt.date
    df = rows(spark, [
        ("a", "1", "weekly", d(2024, 1, 3), 10.0, 5), ("a", "1", "week", d(2024, 1, 7), 12.0, 9), ("a", "1", "Mingguan ", d(2024, 1, 10), float("nan"), 9),
        ("a", "1", None, d(2024, 1, 17), None, 9), ("a", "1", "month", d(2024, 1, 25), 20.0, 9), ("a", "1", "week", d(2024, 2, 9), float("nan"), 9),
    ])
    out = {r.period_start: r for r in g.regular_grid(df).collect()}
    assert sorted(out) == [d(2024, 1, 1), d(2024, 1, 8), d(2024, 1, 15), d(2024, 1, 22)]
    assert out[d(2024, 1, 1)].value == 12.0 and not out[d(2024, 1, 1)].is_filled
    assert out[d(2024, 1, 8)].is_filled and out[d(2024, 1, 15)].is_filled
    assert {r.period_start for r in g.missing_periods(df).collect()} == {"2024-01-08", "2024-01-15"}


def test_months_quarters_null_keys_and_ties(spark):
    d = dt.date
    df = rows(spark, [
        (None, "1", "bulanan", d(2023, 11, 30), 1.0, 5), (None, "1", "monthly", d(2024, 2, 1), 3.0, 5),
        ("b", None, "triwulan", d(2023, 12, 31), 1.0, None), ("b", None, "quarter", d(2024, 8, 1), 3.0, None),
        ("c", "x", "day", d(2024, 1, 1), 1.0, 1), ("c", "x", "week", d(2024, 1, 3), 1.0, 1), ("d", "x", "week", None, 4.0, 1), ("e", "x", "week", d(2024, 1, 1), None, 1),
    ])
    got = {(r.source_id, r.source_subunit, r.period_start) for r in g.missing_periods(df).collect()}
    assert got == {(None, "1", "2023-12-01"), (None, "1", "2024-01-01"), ("b", None, "2024-01-01"), ("b", None, "2024-04-01"), ("c", "x", "2024-01-02")}


def test_empty(spark):
    assert g.regular_grid(rows(spark, [])).count() == 0


def test_imputation_recovers_a_season():
    t = np.arange(120)
    y = 50 + 20 * np.sin(2 * np.pi * t / 12)
    present = np.ones((2, 120), bool)
    present[0, [17, 40, 41, 77]] = False
    values = np.array([y, y]) * present
    out = g.impute(values, present, np.array([120, 120]))
    assert np.abs(out[0] - y).max() < 1.0 and np.array_equal(out[1], y)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_short_series_are_interpolated(n):
    present = np.ones((1, n), bool)
    if n > 2:
        present[0, 1] = False
    out = g.impute(np.arange(n, dtype=float)[None] * present, present, np.array([n]))
    assert np.allclose(out[0], np.arange(n))


def test_week_season_of_days_and_short_series():
    """A weekly season of days is embedded by the window of its resolution; series of three periods and more are imputed, infinite ones too."""
    t = np.arange(150)
    y = 40 + 10 * np.sin(2 * np.pi * t / 7)
    present = np.ones((1, 150), bool)
    present[0, [30, 31, 32, 88, 120]] = False
    out = g.impute(y[None] * present, present, np.array([150]), longest=np.array([g.WINDOWS["day"]]))
    assert np.abs(out[0] - y).max() < 1.0
    short = g.impute(np.array([[4.0, 0.0, 4.0, 4.0]]), np.array([[True, False, True, True]]), np.array([4]))
    assert np.isfinite(short).all() and abs(short[0, 1] - 4.0) < 1e-6


def test_infinite_readings(spark):
    d = dt.date
    df = rows(spark, [("a", "x", "month", d(2024, m, 3), v, 1) for m, v in ((1, 5.0), (2, float("inf")), (3, 5.0), (5, 5.0))])
    got = {r.period_start.month: (r.value, r.is_filled) for r in g.regular_grid(df).collect()}
    assert got[2] == (float("inf"), False) and got[4] == (5.0, True)
    alone = rows(spark, [("a", "x", "month", d(2024, m, 3), float("inf"), 1) for m in (1, 3)])
    assert [(r.is_filled, np.isfinite(r.value)) for r in g.regular_grid(alone).orderBy("period_start").collect()] == [(False, False), (True, True), (False, False)]
