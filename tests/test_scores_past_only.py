from pyspark.sql import functions as F

from tidewell.operators import scoring

KEYS = ["k"]


def folds(spark, last):
    rows = [("a", 1, o, o, float(10 + o % 4), "m", 10.0) for o in range(20, 30)] + [("a", 1, 30, 30, last, "m", 10.0)]
    return spark.createDataFrame(rows, "k string, horizon int, origin int, target int, actual double, model string, predicted double")


def test_later_folds_do_not_change_earlier_quantiles(spark):
    for strict in (True, False):
        got = [{r.origin: r.quantiles for r in scoring.quantile_forecasts(folds(spark, x), KEYS, strict=strict).collect()} for x in (10.0, 9999.0)]
        assert got[0] == got[1] and set(got[0]) == set(range(25, 31))


def test_only_targets_before_the_origin_are_known(spark):
    """Of folds three periods ahead, those not yet observed at an origin tell nothing."""
    rows = [("a", 3, o, o + 2, 10.0 + o, "m", 10.0) for o in range(20, 32)]
    df = spark.createDataFrame(rows, "k string, horizon int, origin int, target int, actual double, model string, predicted double")
    got = {r.origin: r.quantiles[2] for r in scoring.quantile_forecasts(df, KEYS).collect()}
    # at origin 27 the targets 22 to 26 are known, which are the residuals 20 to 24
    assert min(got) == 27 and got[27] == 32.0


def test_fallback_deviation(spark):
    spine = spark.range(30).select(F.lit("a").alias("k"), F.col("id").alias("period_start"), F.lit(8.0).alias("forward_filled"), F.lit(True).alias("present"), F.lit(8.0).alias("value"))
    sigma = scoring.fallback_sigma(spine, KEYS)
    assert {round(r.sigma, 9) for r in sigma.collect()} == {3.0}
    first = scoring.quantile_forecasts(folds(spark, 1.0), KEYS, sigma).where("origin = 20").collect()
    assert [round(x, 4) for x in first[0].quantiles] == [6.1553, 7.9765, 10.0, 12.0235, 13.8447]
