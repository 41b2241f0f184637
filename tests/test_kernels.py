import math

import numpy as np
import pytest

from tidewell.kernels import diagnose as d
from tidewell.kernels import forecast as f
from tidewell.kernels import panel as p
from tidewell.operators import forecasts as fo

T = np.arange(128)


@pytest.mark.parametrize("name", sorted(f.MODELS))
def test_models_are_finite_and_not_negative(name):
    for y in (np.array([0, 1, 7, 2, 12, 3] * 8, float), np.array([5.0]), np.array([1.0, 4.0, 2.0]), np.zeros(24)):
        out = f.MODELS[name](y, 3, 12)
        assert out.shape == (3,) and np.isfinite(out).all() and (out >= 0).all()
    assert np.allclose(f.MODELS[name](np.zeros(24), 3, 12), 0, atol=1e-5)


def test_known_forecasts():
    assert list(f.seasonal_naive(np.arange(1.0, 25), 3, 12)) == [13, 14, 15]
    assert list(f.seasonal_window_average(T[:48] % 12.0, 3, 12)) == [0, 1, 2]
    assert list(f.drift(np.arange(5.0), 2, 12)) == [5, 6]
    assert np.allclose(f.holt_linear(np.arange(30.0), 3, 12), [30, 31, 32])
    assert np.allclose(f.theta(np.full(20, 3.0), 2, 12), 3)
    assert np.abs(f.holt_winters_additive(10 + T[:60] % 12.0, 12, 12) - (10 + np.arange(60, 72) % 12)).max() < 0.5
    assert np.abs(f.harmonic_ridge(10 + np.sin(2 * np.pi * T / 12), 4, 12) - (10 + np.sin(2 * np.pi * (128 + np.arange(4)) / 12))).max() < 0.05


@pytest.mark.parametrize("name", sorted(f.DETECTORS))
def test_alarms_rise_with_the_last_value(name):
    base = np.array([5.0, 6, 4, 5, 6, 5, 4, 6] * 4)
    assert f.DETECTORS[name](base, 12) < f.DETECTORS[name](np.append(base, [60, 70, 80]), 12) <= 1


def test_tails():
    assert d.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and d.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert d.student_sf2(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-8)


def test_profile_and_trend():
    out = d.profile(np.array([1.0, 2, 4, 10]))
    assert out["skewness"] == pytest.approx(1.469, abs=1e-3) and out["kurtosis"] == pytest.approx(2.031, abs=1e-3)
    out = d.trend(np.arange(20.0))
    assert out["slope"] == pytest.approx(1) and out["tau"] == pytest.approx(1) and out["mann_kendall_p"] < 1e-6


def test_stationarity_tells_noise_from_a_walk():
    rng = np.random.default_rng(0)
    noise = rng.normal(size=300)
    assert d.stationarity(noise)["adf_p"] < 0.01 and d.stationarity(np.cumsum(noise))["adf_p"] > 0.05
    assert d.stationarity(noise)["kpss_p"] >= 0.05 and d.stationarity(np.cumsum(noise))["kpss_p"] <= 0.05


def test_decompositions():
    y = np.sin(T) + 0.3 * np.sin(4 * T) + 0.01 * T
    modes, rest = d.emd(y)
    assert modes and np.allclose(sum(modes) + rest, y)
    season = 10 * np.sin(2 * np.pi * T / 12)
    trend, seasonal, left = d.stl(0.2 * T + season, 12)
    assert np.allclose(trend + seasonal + left, 0.2 * T + season) and np.abs(seasonal[12:-12] - season[12:-12]).max() < 0.5
    assert d.spectrum(season)["dominant_period"] == pytest.approx(12, abs=1)
    assert d.pacf(y, 5)[1] == pytest.approx(d.acf(y, 5)[1])


def test_change_points():
    y = np.concatenate([np.full(30, 1.0), np.full(30, 9.0)]) + np.random.default_rng(0).normal(0, 0.3, 60)
    assert d.change_points(y, 12) == [30] and d.change_points(np.ones(40), 12) == []


def test_complexity():
    assert d.entropies(np.arange(50.0))["permutation_entropy_3"] == 0
    assert d.scaling(np.cumsum(np.random.default_rng(0).normal(size=2000)))["hurst"] == pytest.approx(0.5, abs=0.1)
    assert d.recurrence(np.tile([1.0, 5, 2, 8], 20))["determinism"] == pytest.approx(1)


@pytest.mark.parametrize("name", sorted(d.METHODS))
def test_methods_take_any_series(name):
    for y in (np.ones(40), np.zeros(9), np.array([1.0] * 8), np.arange(30.0), np.random.default_rng(0).poisson(2, 60).astype(float)):
        assert all(isinstance(v, float) for v in d.METHODS[name](y, 12).values())


def test_panels():
    wave = np.array([10 + 5 * np.sin(2 * np.pi * (T[:60] + s) / 12) for s in (0, 0, 0, 6, 6, 6)])
    assert p.factors(wave)["factor_1"] > 0.9 and p.synchrony(wave)["median_r"] < 0
    label = p.clusters(wave)
    assert len(set(label[:3])) == 1 and len(set(label[3:])) == 1 and label[0] != label[3]
    a = np.random.default_rng(0).normal(size=200)
    assert p.lead_lag(a, np.roll(a, 3))[0] == 3 and p.transfer_entropy(a, np.roll(a, 1)) > p.transfer_entropy(np.roll(a, 1), a)
    turned = np.array([10 + 5 * np.sin(2 * np.pi * (T[:60] + s) / 12) for s in (0, 2, 3, 5, 7)])
    assert any(abs(abs(freq) - 1 / 12) < 0.01 for _, freq in p.dynamic_modes(turned))
    assert p.warp(a, a) == 0
    counts = np.full((9, 20), 5.0)
    counts[4, 10:13] = 60
    score, place, start, length, chance = p.scan(counts, [[j for j in range(9) if abs(i - j) == 1] for i in range(9)])
    assert (start, length) == (10, 3) and place in (3, 4, 5) and chance < 0.05 and score > 10


def test_folds_never_look_ahead():
    y = np.random.default_rng(0).poisson(8, 60).astype(float)
    a = fo.folds_of("s", y, np.ones(60, bool), "month", ["naive", "ses_optimized", "ears_c1"])
    changed = y.copy()
    changed[40:] += 100
    b = fo.folds_of("s", changed, np.ones(60, bool), "month", ["naive", "ses_optimized", "ears_c1"])
    assert [r for r in a if r[4] < 40] == [r for r in b if r[4] < 40] and {r[3] for r in a if r[2] == 1} == set(fo.chosen_origins(60, 1, 18, 24))
    assert all(r[10] == sorted(r[10]) and min(r[10]) >= 0 for r in a) and not math.isnan(sum(r[9] for r in a))
