"""Forecasting models and alarm detectors: (values, horizon, season) -> horizon forecasts, never below zero.

Smoothing models run over their whole parameter grid at once, as arrays with one entry per grid
point, and keep the first point of least squared one-step error.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np

Model = Callable[[np.ndarray, int, int], np.ndarray]
# The parameter grids of the benchmark.
SES_GRID = np.arange(1, 20) / 20
HOLT_GRID = [(a, b) for a in (0.2, 0.4, 0.6, 0.8) for b in (0.05, 0.15, 0.3, 0.5)]
WINTERS_GRID = [(a, b, c) for a in (0.2, 0.5, 0.8) for b in (0.05, 0.2) for c in (0.1, 0.3, 0.6)]
INGARCH_GRID = [(a, b) for a in (0.1, 0.3, 0.5, 0.7) for b in (0.1, 0.3, 0.5) if a + b < 0.95]
CROSTON_GRID = (0.05, 0.1, 0.2, 0.3, 0.5)
AR_ORDERS = (1, 2, 3, 5)


def _positive(x) -> np.ndarray:
    return np.maximum(np.asarray(x, float), 0.0)


def _flat(level: float, horizon: int) -> np.ndarray:
    return np.full(horizon, max(float(level), 0.0))


def ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients of penalised least squares; the first column is the intercept and is not penalised."""
    gram = x.T @ x + penalty * np.diag([0.0, *np.ones(x.shape[1] - 1)])
    return np.linalg.lstsq(gram, x.T @ y, rcond=None)[0]


def _recursive(y: np.ndarray, horizon: int, step: Callable[[list[float]], float]) -> np.ndarray:
    state = list(y)
    for _ in range(horizon):
        state.append(max(0.0, step(state)))
    return np.array(state[len(y) :])


def naive(y, horizon, season):
    return _flat(y[-1], horizon)


def seasonal_naive(y, horizon, season):
    if season <= 1 or len(y) < season:
        return naive(y, horizon, season)
    return _positive(y[len(y) - season + np.arange(horizon) % season])


def historical_mean(y, horizon, season):
    return _flat(y.mean(), horizon)


def historical_median(y, horizon, season):
    return _flat(np.median(y), horizon)


def moving_average(y, horizon, season):
    width = min(len(y), max(3, min(season, 12)))
    return _recursive(y, horizon, lambda s: float(np.mean(s[-width:])))


def drift(y, horizon, season):
    slope = (y[-1] - y[0]) / (len(y) - 1) if len(y) > 1 else 0.0
    return _positive(y[-1] + slope * np.arange(1, horizon + 1))


def seasonal_window_average(y, horizon, season):
    n = len(y)
    out = []
    for step in range(horizon):
        same = y[(np.arange(n) % season) == (n + step) % season][-5:] if season > 1 else y[-5:]
        out.append(same.mean() if len(same) else y[-1])
    return _positive(out)


def _ses(y: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    level, loss = np.full(len(alpha), float(y[0])), np.zeros(len(alpha))
    for v in y[1:]:
        error = v - level
        loss += error**2
        level = level + alpha * error
    return level, loss


def ses_optimized(y, horizon, season):
    level, loss = _ses(y, SES_GRID)
    return _flat(level[loss.argmin()], horizon)


def _holt(y: np.ndarray, horizon: int, damping: float) -> np.ndarray:
    alpha, beta = np.array(HOLT_GRID).T
    level = np.full(len(alpha), float(y[0]))
    trend = np.full(len(alpha), float(y[1] - y[0]) if len(y) > 1 else 0.0)
    loss = np.zeros(len(alpha))
    for v in y[1:]:
        expected = level + damping * trend
        loss += (v - expected) ** 2
        raised = alpha * v + (1 - alpha) * expected
        trend = beta * (raised - level) + (1 - beta) * damping * trend
        level = raised
    best = loss.argmin()
    return _positive(level[best] + trend[best] * np.cumsum(damping ** np.arange(1, horizon + 1)))


def holt_linear(y, horizon, season):
    return _holt(y, horizon, 1.0)


def holt_damped(y, horizon, season):
    return _holt(y, horizon, 0.9)


def holt_winters_additive(y, horizon, season):
    n = len(y)
    if season <= 1 or n < season + 4:
        return holt_damped(y, horizon, season)
    alpha, beta, gamma = np.array(WINTERS_GRID).T
    k = len(alpha)
    level = np.full(k, y[:season].mean())
    next_year = y[season : 2 * season].mean() if n >= 2 * season else level[0]
    trend = np.full(k, (next_year - level[0]) / season)
    cycle = np.tile(y[:season] - level[0], (k, 1))
    loss = np.zeros(k)
    for t, v in enumerate(y):
        s = cycle[:, t % season]
        loss += (v - level - trend - s) ** 2
        raised = alpha * (v - s) + (1 - alpha) * (level + trend)
        trend = beta * (raised - level) + (1 - beta) * trend
        cycle[:, t % season] = gamma * (v - raised) + (1 - gamma) * s
        level = raised
    b = loss.argmin()
    steps = np.arange(1, horizon + 1)
    return _positive(level[b] + steps * trend[b] + cycle[b, (n + steps - 1) % season])


def theta(y, horizon, season):
    t = np.arange(len(y))
    spread = ((t - t.mean()) ** 2).sum()
    slope = ((t - t.mean()) * (y - y.mean())).sum() / max(spread, 1e-9)
    line = y.mean() + slope * (t - t.mean())
    level = _ses(y - line, np.array([0.2]))[0][0]
    return _positive(y.mean() + slope * (len(y) + np.arange(horizon) - t.mean()) + level)


def _autoregress(y: np.ndarray, horizon: int, season: int, order: int, logged: bool = False) -> np.ndarray:
    seasonal = season > 1 and len(y) > 2 * season and season >= order
    lags = np.array([*range(1, order + 1), *([season] if seasonal else [])])
    first = int(max(order, season if seasonal else order))
    z = np.log1p(y) if logged else y
    rows = len(y) - first
    if rows < len(lags) + 3:
        return ses_optimized(y, horizon, season)
    at = np.arange(first, len(y))
    x = np.column_stack([np.ones(rows), z[at[:, None] - lags]])
    weights = ridge(x, z[at], 0.1)

    def step(state: list[float]) -> float:
        past = np.array([state[-k] for k in lags])
        value = float(weights[0] + weights[1:] @ (np.log1p(past) if logged else past))
        return math.expm1(min(value, 50.0)) if logged else value

    return _recursive(y, horizon, step)


def autoregression_ridge(y, horizon, season):
    return _autoregress(y, horizon, season, 3)


def log_autoregression(y, horizon, season):
    return _autoregress(y, horizon, season, 3, True)


def auto_autoregression(y, horizon, season):
    held = min(6, max(2, len(y) // 5))
    scored = []
    for order in AR_ORDERS:
        errors = [abs(y[end] - _autoregress(y[:end], 1, season, order)[0]) for end in range(len(y) - held, len(y)) if end >= max(10, order + 5)]
        if errors:
            scored.append((float(np.mean(errors)), order))
    return _autoregress(y, horizon, season, min(scored)[1] if scored else 1)


def harmonic_ridge(y, horizon, season):
    def design(t: np.ndarray) -> np.ndarray:
        waves = [2 * math.pi * k * t / season for k in range(1, (2 if season >= 12 else 1) + 1)] if season > 1 else []
        return np.column_stack([np.ones(len(t)), t, *[f(w) for w in waves for f in (np.sin, np.cos)]])

    n = len(y)
    return _positive(design(np.arange(n, n + horizon)) @ ridge(design(np.arange(n)), y, 0.1))


def local_linear(y, horizon, season):
    width = min(len(y), max(8, min(2 * season, 24)))
    w, t, v = np.arange(1, width + 1) / width, np.arange(width), y[-width:]
    tm, vm = (w * t).sum() / w.sum(), (w * v).sum() / w.sum()
    slope = (w * (t - tm) * (v - vm)).sum() / max((w * (t - tm) ** 2).sum(), 1e-9)
    return _positive(vm + slope * (width - tm + np.arange(horizon)))


def _ingarch(y: np.ndarray, horizon: int, negative_binomial: bool) -> np.ndarray:
    mean = max(float(y.mean()), 1e-6)
    variance = float(y.var()) if len(y) > 1 else mean
    size = max(1.0, mean * mean / max(variance - mean, 1e-6))
    alpha, beta = np.array(INGARCH_GRID).T
    omega, level, loss = mean * (1 - alpha - beta), np.full(len(alpha), mean), np.zeros(len(alpha))
    for before, v in zip(y[:-1], y[1:]):
        level = np.maximum(1e-6, omega + alpha * before + beta * level)
        if negative_binomial:
            loss -= math.lgamma(v + size) - math.lgamma(size) - math.lgamma(v + 1) + size * np.log(size / (size + level)) + v * np.log(level / (size + level))
        else:
            loss += level - v * np.log(level) + math.lgamma(v + 1)
    b = loss.argmin()
    out, state, now = [], float(y[-1]), float(level[b])
    for _ in range(horizon):
        now = max(0.0, omega[b] + alpha[b] * state + beta[b] * now)
        state = now
        out.append(now)
    return _positive(out)


def poisson_ingarch(y, horizon, season):
    return _ingarch(y, horizon, False)


def negative_binomial_ingarch(y, horizon, season):
    return _ingarch(y, horizon, True)


def hurdle_occurrence(y, horizon, season):
    chance = float((y[:6] > 0).mean())
    size = float(y[y > 0].mean()) if (y > 0).any() else 0.0
    for v in y:
        chance += 0.2 * (float(v > 0) - chance)
        size += 0.2 * (v - size) if v > 0 else 0.0
    return _flat(chance * size, horizon)


def markov_switching(y, horizon, season):
    cut = float(np.median(y))
    high = (y > cut).astype(int)
    moves = np.ones((2, 2))
    np.add.at(moves, (high[:-1], high[1:]), 1)
    up = moves[:, 1] / moves.sum(axis=1)
    means = [float(y[high == k].mean()) if (high == k).any() else cut for k in (0, 1)]
    out, p = [], float(high[-1])
    for _ in range(horizon):
        p = (1 - p) * up[0] + p * up[1]
        out.append((1 - p) * means[0] + p * means[1])
    return _positive(out)


def _croston(y: np.ndarray, alpha: float) -> float:
    at = np.flatnonzero(y > 0)
    if not len(at):
        return 0.0
    size, interval = float(y[at[0]]), max(1.0, at[0] + 1.0)
    for before, i in zip(at[:-1], at[1:]):
        size += alpha * (y[i] - size)
        interval += alpha * (i - before - interval)
    return size / interval


def croston_classic(y, horizon, season):
    return _flat(_croston(y, 0.1), horizon)


def croston_sba(y, horizon, season):
    return _flat(0.95 * _croston(y, 0.1), horizon)


def croston_optimized(y, horizon, season):
    held = min(8, max(3, len(y) // 4))
    ends = range(max(2, len(y) - held), len(y))
    scored = [(float(np.mean([abs(y[i] - _croston(y[:i], a)) for i in ends])) if len(ends) else 0.0, a) for a in CROSTON_GRID]
    return _flat(_croston(y, min(scored)[1]), horizon)


def tsb(y, horizon, season):
    if not (y > 0).any():
        return np.zeros(horizon)
    size, chance = float(y[y > 0][0]), float(y[0] > 0)
    for v in y[1:]:
        chance += 0.1 * (float(v > 0) - chance)
        size += 0.1 * (v - size) if v > 0 else 0.0
    return _flat(chance * size, horizon)


def _aggregated(y: np.ndarray, level: int) -> float:
    width = max(1, min(level, len(y) // 4))
    blocks = y[: len(y) // width * width].reshape(-1, width).sum(axis=1)
    return ses_optimized(blocks, 1, 1)[0] / width


def adida(y, horizon, season):
    return _flat(_aggregated(y, 3), horizon)


def imapa(y, horizon, season):
    return _flat(float(np.mean([_aggregated(y, k) for k in range(1, min(6, max(2, len(y) // 6)) + 1)])), horizon)


def analog_knn(y, horizon, season):
    width = min(6, max(2, len(y) // 8))
    ends = np.arange(width, len(y) - horizon + 1)
    if not len(ends):
        return seasonal_naive(y, horizon, season)
    windows = y[ends[:, None] - width + np.arange(width)]
    distance = np.sqrt((((windows - y[-width:]) / max(float(y.std()), 1.0)) ** 2).mean(axis=1))
    near = np.argsort(distance, kind="stable")[:7]
    weight = 1 / np.maximum(distance[near], 1e-6)
    return _positive((weight[:, None] * y[ends[near][:, None] + np.arange(horizon)]).sum(axis=0) / weight.sum())


def _windows(y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    width = min(5, max(2, len(y) // 10))
    if len(y) <= width:
        return width, np.zeros((0, width)), np.zeros(0)
    return width, np.lib.stride_tricks.sliding_window_view(y, width)[:-1], y[width:]


def kernel_ridge_rbf(y, horizon, season):
    width, rows, target = _windows(y)
    if len(rows) < 8:
        return analog_knn(y, horizon, season)
    centers = rows[:: max(1, len(rows) // 12)][-12:]
    scale = max(float(y.std()), 1.0)

    def features(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.exp(-(((x[:, None] - centers) / scale) ** 2).mean(axis=2))])

    weights = ridge(features(rows), target, 0.5)
    return _recursive(y, horizon, lambda s: float((features(np.array([s[-width:]])) @ weights)[0]))


def _stump(rows: np.ndarray, target: np.ndarray) -> tuple[int, float, float, float]:
    best = (math.inf, 0, 0.0, float(target.mean()), float(target.mean()))
    for k in range(rows.shape[1]):
        ordered = np.sort(rows[:, k])
        for cut in ordered[[len(ordered) // 4, len(ordered) // 2, 3 * len(ordered) // 4]]:
            left = rows[:, k] <= cut
            if left.any() and not left.all():
                a, b = target[left], target[~left]
                best = min(best, (float(((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()), k, float(cut), float(a.mean()), float(b.mean())))
    return best[1:]


def gradient_boosted_stumps(y, horizon, season):
    width, rows, target = _windows(y)
    if len(rows) < 8:
        return moving_average(y, horizon, season)
    base = float(target.mean())
    fitted, trees = np.full(len(target), base), []
    for _ in range(12):
        tree = _stump(rows, target - fitted)
        trees.append(tree)
        fitted = fitted + 0.15 * np.where(rows[:, tree[0]] <= tree[1], tree[2], tree[3])
    return _recursive(y, horizon, lambda s: base + sum(0.15 * (a if s[-width + k] <= cut else b) for k, cut, a, b in trees))


def extra_trees(y, horizon, season):
    width, rows, target = _windows(y)
    if len(rows) < 8:
        return analog_knn(y, horizon, season)
    rng = random.Random(len(y) * 7919 + round(float(y.sum())))

    def step(state: list[float]) -> float:
        votes = []
        for _ in range(11):
            k = rng.randrange(width)
            cut = rng.choice(rows[:, k].tolist())
            same = (rows[:, k] <= cut) == (state[-width + k] <= cut)
            votes.append(float(target[same].mean()) if same.any() else float(target.mean()))
        return float(np.median(votes))

    return _recursive(y, horizon, step)


def haar_multiscale(y, horizon, season):
    widths = sorted({1, 2, 4, 8, min(12, season), min(24, len(y))})
    level = float(np.median([y[-w:].mean() for w in widths if w <= len(y)]))
    return _positive((level + seasonal_naive(y, horizon, season)) / 2)


#: Every base model by name.
MODELS: dict[str, Model] = {
    f.__name__: f
    for f in (
        naive, seasonal_naive, historical_mean, historical_median, moving_average, drift, seasonal_window_average, ses_optimized, holt_linear, holt_damped,
        holt_winters_additive, theta, autoregression_ridge, log_autoregression, auto_autoregression, harmonic_ridge, local_linear, poisson_ingarch,
        negative_binomial_ingarch, hurdle_occurrence, markov_switching, croston_classic, croston_sba, croston_optimized, tsb, adida, imapa, analog_knn,
        kernel_ridge_rbf, gradient_boosted_stumps, extra_trees, haar_multiscale,
    )
}
#: Models for series with many zeros only.
INTERMITTENT = ("hurdle_occurrence", "croston_classic", "croston_sba", "croston_optimized", "tsb", "adida", "imapa")


def tail(z: float) -> float:
    """Normal probability below z, kept off 0 and 1."""
    return min(1 - 1e-9, max(1e-9, 0.5 * math.erfc(-z / math.sqrt(2))))


def _score(now: float, base: np.ndarray) -> float:
    return (now - float(base.mean())) / max(float(base.std()), 1.0)


def ears_c1(y, season):
    base = y[-8:-1] if len(y) >= 8 else y[:-1]
    return tail(_score(y[-1], base) - 3) if len(base) else 0.5


def ears_c2(y, season):
    base = y[-10:-3] if len(y) >= 10 else y[:-3]
    return tail(_score(y[-1], base) - 3) if len(base) else ears_c1(y, season)


def ears_c3(y, season):
    return min(1 - 1e-9, float(np.mean([ears_c2(y[:end], season) for end in range(max(min(4, len(y)), len(y) - 2), len(y) + 1)])))


def ewma_alarm(y, season):
    level, rest = float(y[0]), []
    for v in y[1:]:
        rest.append(v - level)
        level += 0.2 * (v - level)
    return tail((y[-1] - level) / max(float(np.std(rest)) if len(rest) > 1 else 1.0, 1.0) - 2)


def cusum_alarm(y, season):
    score = 0.0
    for v in y[-12:]:
        score = max(0.0, score + (v - float(np.median(y))) / max(float(y.std()), 1.0) - 0.5)
    return tail(score - 4)


def farrington_alarm(y, season):
    past = y[:-1]
    same = past[np.arange(len(past)) % season == (len(y) - 1) % season] if season > 1 and len(y) >= season + 2 else past
    base = same if len(same) else past
    if not len(base):
        return 0.5
    mean = float(base.mean())
    return tail((y[-1] - mean) / math.sqrt(max(float(base.var()) if len(base) > 1 else mean, mean, 1.0)) - 2.5)


def bayesian_change(y, season):
    width = min(4, max(2, len(y) // 5))
    before = y[-2 * width : -width] if len(y) >= 2 * width else (y[:-width] if len(y) > width else y)
    return tail((float(y[-width:].mean()) - float(before.mean())) / math.sqrt(max(float(before.mean()), 1.0) / width) - 2)


DETECTORS = {f.__name__: f for f in (ears_c1, ears_c2, ears_c3, ewma_alarm, cusum_alarm, farrington_alarm, bayesian_change)}
