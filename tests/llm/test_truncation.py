import numpy as np
import pytest

from tidewell.llm import truncation

SCHEMA = "doc_id long, text string, source string, n_chars long, kind string, limits int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, n, "clash", 0) for i, (t, s, n) in enumerate(rows)], SCHEMA)


def judged(spark, rows):
    return [r.truncated for r in truncation.judge(frame(spark, rows)).orderBy("doc_id").collect()]


def test_endings(spark):
    whole = ["The unit closed.", "Was it useful?", "Counts.\n| a | 3 |", "Done.\n- fogging: Puskesmas Wolindra", "Done.\nSurveillance unit, Puskesmas Wolindra", "See.\nhttps://x.example/set/123", "Done.\n(n = 349)", 'He said "no."', "More will follow next week...", "Also here. More will follow next week...", "Done.  \n"]
    cut = ["The unit in Puskesmas Wol", "The unit closed, <br", "Rainfall of 92&nbs", "The rate stood at 7 per", "Larvae fou�", "The larva-f [more]", "The year befo...", "Most patients ca…", "x" * 40000]
    assert judged(spark, [(t, "s", None) for t in whole + cut]) == [False] * len(whole) + [True] * len(cut)


def test_null_blank_and_empty(spark):
    df = frame(spark, [(None, "s", 3), ("", "s", 0), (" \n", None, 0), ("Fine.", None, None)])
    assert truncation.judge(df).count() == 1 and truncation.cut_texts(df).count() == 0
    assert truncation.rates(df.where("false")).count() == 0


def test_limits_and_rates(spark):
    rng = np.random.default_rng(0)
    rows = []
    for n in (rng.lognormal(5.5, 0.7, 400).astype(int) + 5).tolist():
        text = "w" * (n - 1) + "."
        rows.append((text[:255], "short", n) if n > 255 else (text, "short", n))
        rows.append((text, "free", n))
    df = frame(spark, rows)
    limits = {(r.source, r.unit, r.length): r for r in truncation.length_limits(df).collect()}
    assert limits["short", "chars", 255].posterior > 0.95 and not [k for k in limits if k[0] == "free"]
    assert limits["short", "chars", 255].mu == pytest.approx(np.log([len(r[0]) for r in rows if r[1] == "free"]).mean(), abs=0.15)
    got = {r.source: r for r in truncation.rates(df).collect()}
    assert got["free"].truncated == 0 and got["short"].share == pytest.approx(np.mean([r[2] > 255 for r in rows if r[1] == "short"]))


def test_censored_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(6, 1, 20000)
    mu, sigma = truncation.fit_censored(np.minimum(x, 6.5), np.ones(len(x)), x > 6.5)
    assert mu == pytest.approx(6, abs=0.05) and sigma == pytest.approx(1, abs=0.05)
