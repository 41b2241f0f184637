import numpy as np

from tidewell.operators import diagnostics as d


def test_panels_over_a_hundred_places_keep_every_method(spark):
    t = np.arange(12)
    made = [("all", f"p{k:03d}", [float(v) for v in 5 + np.sin(t + k % 4) + k % 7]) for k in range(104)]
    packed = spark.createDataFrame(made, "panel string, series string, values array<double>")
    got = d.panel_diagnostics(packed, "panel", [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(103)]).toPandas()
    assert (got.method == "dtw_cluster").sum() == 104
    assert set(got.statistic[got.method == "space_time_scan"]) == {"score", "place", "start", "length", "p"}
