import datetime as dt
import json

import numpy as np

from tidewell.operators import forecasts as fc
from tidewell.operators import silver as sv
from tidewell.operators import units


def test_observations_and_facts(spark):
    payloads = [{"Jml Kasus": "1,5", "tahun": 2020, "minggu": 53, "provinsi": " X "}, {"cases": 7, "meninggal": "-", "report_date": "2021-03-05"}, {"cases": 7, "report_date": "2021-03-05", "z": 1}, {"kasus": "2"}, None, {}]
    rows = [(i, 1, json.dumps(p) if p is not None else None) for i, p in enumerate(payloads)]
    found = sv.observations(spark.createDataFrame(rows, "bronze_record_id long, dataset_id long, payload string"))
    got = {(r.bronze_record_id, r.metric, r.value, r.grain, r.period_start, r.province) for r in found.collect()}
    assert got == {(0, "cases", 1.5, "week", dt.date(2020, 12, 28), "X"), (1, "cases", 7.0, "day", dt.date(2021, 3, 5), None), (2, "cases", 7.0, "day", dt.date(2021, 3, 5), None), (3, "cases", 2.0, None, None, None)}
    facts = {(r.bronze_record_id, r.records) for r in sv.publish(found).collect()}
    assert facts == {(0, 1), (1, 2)}
    assert sv.usable_shares(found).collect()[0].with_period == 0.75


def test_pooled_ridge_uses_only_earlier_targets(spark):
    rng = np.random.default_rng(0)
    months = [dt.date(2015 + k // 12, k % 12 + 1, 1) for k in range(60)]
    def rows(late):
        return [(s, m, float(v), float(v), True) for s in "abc" for k, m in enumerate(months) for v in [20 + 5 * np.sin(k / 2) + rng.random() + (late if k >= 50 else 0)]]

    schema = "k string, period_start date, value double, forward_filled double, present boolean"
    rng = np.random.default_rng(0)
    a = {(r.k, r.period_start): r.predicted for r in fc.pooled_ridge(spark.createDataFrame(rows(0), schema), ["k"]).collect()}
    rng = np.random.default_rng(0)
    b = {(r.k, r.period_start): r.predicted for r in fc.pooled_ridge(spark.createDataFrame(rows(500), schema), ["k"]).collect()}
    early = [k for k in a if k[1] <= months[50]]
    assert len(early) > 60 and all(abs(a[k] - b[k]) < 1e-9 for k in early)
    assert np.mean([abs(a[k] - 20) for k in a]) < 8


def test_units_without_their_reference_rows(spark):
    df = spark.createDataFrame([(1, "cases", 0.5, None, None, None), (2, "population", 0.02, None, "orang", None)], "silver_observation_id long, metric string, value_numeric double, value_text string, unit string, provenance string")
    ref = spark.createDataFrame([("cases", "cases", "cases", 1.0, 0.0)], "quantity string, unit_code string, common_unit string, factor double, shift double")
    got = {r.silver_observation_id: (r.unit_code, r.value_common) for r in units.harmonise(df, ref).collect()}
    assert got == {1: ("cases", 0.5), 2: (None, None)}
    assert units.harmonise(df, ref.where("false")).count() == 2 and units.recorded_otherwise(df.where("false"), ref).count() == 0
