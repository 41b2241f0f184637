import datetime as dt

from tidewell.operators import spatial


def test_trajectories(spark):
    months = [dt.date(2020 + k // 12, k % 12 + 1, 1) for k in range(12)]
    series = {
        "rising": [0, 0, 1, 1, 1.5, 2.1, 2.2, 2.3, 2.5, 2.6, 1.9, 2.8], "falling": [2.9, 2.8, 2.7, 2.6, 2.5, 2.4, 2.3, 1.5, 1, 0.5, 0.4, 0.3], "always": [3] * 12, "late": [0] * 11 + [2.5],
        "last three": [2.5, 0, 0, 0, 0, 0, 0, 0, 0, 2.1, 2.1, 2.1], "once": [0, 2.5] + [0] * 10, "cold": [-2.5] * 8 + [0] * 4, "flat": [1.96] * 12, "unknown": [None] * 12,
    }
    df = spark.createDataFrame([(k, m, None if v is None else float(v)) for k, values in series.items() for m, v in zip(months, values)], "place string, period_start date, z double")
    got = {r.place: r.trajectory for r in spatial.hotspot_classes(df, "place", "z").collect()}
    assert got == {"rising": "intensifying", "falling": "diminishing", "always": "persistent", "late": "new", "last three": "consecutive", "once": "sporadic", "cold": "coldspot", "flat": "no_pattern", "unknown": "no_pattern"}


def test_range_of_the_variogram(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, 2.0, 9.6), ("a", 2, 3.0, 10.0), ("b", 0, 1.0, 4.0)], "g string, bin int, distance double, semivariance double")
    assert {tuple(r) for r in spatial.variogram_range(df, ["g"]).collect()} == {("a", 10.0, 2.0), ("b", 4.0, 1.0)}
