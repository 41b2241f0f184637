import datetime as dt

import numpy as np

from tidewell.operators.spikes import implausible_readings

SCHEMA = "observation_id long, source_id string, source_subunit string, metric string, temporal_resolution_normalized string, period_start date, value double, published_at timestamp, day int, reason string"


def frame(spark, series):
    made, k = [], 0
    for (source, sub, metric), values in series.items():
        for i, v in enumerate(values):
            for x in v if isinstance(v, tuple) else (v,):
                made.append((k, source, sub, metric, "day", dt.date(2024, 1, 1) + dt.timedelta(days=i), None if x is None else float(x), dt.datetime(2024, 1, 1), 0, "clash"))
                k += 1
    df = spark.createDataFrame(made, SCHEMA)
    return df, {r[0]: r[6] for r in made}


def found(spark, series):
    df, values = frame(spark, series)
    return sorted((values[r.observation_id], r.reason) for r in implausible_readings(df).collect())


def noise(n, level, seed=0):
    return list(np.round(level + np.random.default_rng(seed).normal(0, 0.05 * level, n)))


def test_spikes_pairs_and_repeats(spark):
    y = noise(60, 200)
    y[20], y[40], y[41], y[59] = (2100.0, 2100.0), 1900.0, 2000.0, 3.0
    assert found(spark, {("a", "1", "cases"): y}) == [(3.0, "spike"), (1900.0, "spike"), (2000.0, "spike"), (2100.0, "spike"), (2100.0, "spike")]


def test_outbreaks_and_level_changes_are_none(spark):
    y = noise(90, 100)
    y[30:34] = [600.0, 640.0, 610.0, 580.0]
    assert found(spark, {("a", "1", "cases"): y}) == []
    assert found(spark, {("a", "1", "cases"): noise(40, 100) + noise(40, 900, 1)}) == []
    season = list(np.round(200 + 150 * np.sin(2 * np.pi * np.arange(96) / 12)))
    assert found(spark, {("a", "1", "cases"): season}) == []


def test_impossible_values(spark):
    y = noise(30, 50)
    y[3], y[9] = -999.0, 49.5
    out = found(spark, {("a", None, "cases"): y, (None, "b", "tests_positive"): [30.0, 31.0, 131.0, 29.0, 30.0, 32.0]})
    assert out == [(-999.0, "impossible"), (49.5, "impossible"), (131.0, "impossible")]


def test_stuck_runs_but_no_small_counts(spark):
    y = noise(60, 300)
    y[10:19] = [317.0] * 9
    small = list(np.random.default_rng(1).poisson(0.3, 60).astype(float))
    assert found(spark, {("a", "1", "cases"): y, ("a", "2", "cases"): small}) == [(317.0, "stuck")] * 9


def test_nulls_nan_and_empty(spark):
    df, _ = frame(spark, {("a", "1", "cases"): [None, float("nan"), 5.0], ("a", "2", None): [None]})
    assert implausible_readings(df).count() == 0 and implausible_readings(df.where("false")).count() == 0
