"""Diagnostics of one regular series: each function returns {statistic: value}; undefined values are left out.

Only numpy and the standard library are used; tests that other packages provide are written from
their published definitions.
"""

from __future__ import annotations

import math

import numpy as np

Result = dict[str, float]


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-squared distribution (regularised incomplete gamma by series or continued fraction)."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-14:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return min(1.0, math.exp(-x + a * math.log(x) - math.lgamma(a)) * h)


def student_sf2(t: float, df: int) -> float:
    """Two-sided tail of Student's t by numerical integration of its density (Simpson in the angle)."""
    if df <= 0:
        return math.nan
    angle = math.atan(abs(t) / math.sqrt(df))
    u = np.linspace(0, angle, 2001)
    f = np.cos(u) ** (df - 1)
    area = (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * (u[1] - u[0]) / 3
    scale = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return float(min(1.0, max(0.0, 1 - scale * area)))


def profile(y: np.ndarray) -> Result:
    n, mean = len(y), float(y.mean())
    sd = float(y.std(ddof=1)) if n > 1 else 0.0
    q = np.quantile(y, [0.25, 0.5, 0.75])
    out = {"n": n, "mean": mean, "std": sd, "min": y.min(), "q25": q[0], "median": q[1], "q75": q[2], "max": y.max(), "zero_rate": (y == 0).mean()}
    if mean:
        out["cv"] = sd / mean
    c = y - mean
    m2, m3, m4 = (c**2).mean(), (c**3).mean(), (c**4).mean()
    if n > 3 and m2 > 0:
        out["skewness"] = m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)
        out["kurtosis"] = ((n + 1) * (m4 / m2**2 - 3) + 6) * (n - 1) / ((n - 2) * (n - 3))
    return {k: float(v) for k, v in out.items()}


def trend(y: np.ndarray) -> Result:
    n, t = len(y), np.arange(len(y))
    if n < 3:
        return {}
    sxx, sxy, syy = ((t - t.mean()) ** 2).sum(), ((t - t.mean()) * (y - y.mean())).sum(), ((y - y.mean()) ** 2).sum()
    slope = sxy / sxx
    out = {"slope": slope, "intercept": y.mean() - slope * t.mean()}
    if syy > 0:
        r = sxy / math.sqrt(sxx * syy)
        out |= {"r": r, "slope_p": student_sf2(r * math.sqrt((n - 2) / max(1 - r * r, 1e-300)), n - 2)}
        s = np.sign(y[None, :] - y[:, None])[np.triu_indices(n, 1)].sum()
        ties = np.unique(y, return_counts=True)[1]
        pairs = n * (n - 1) / 2
        out["tau"] = s / math.sqrt(pairs * (pairs - (ties * (ties - 1) / 2).sum()))
        var = (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18
        out["mann_kendall_p"] = min(1.0, 2 * normal_sf((abs(s) - 1) / math.sqrt(var))) if var > 0 and s else 1.0
    return {k: float(v) for k, v in out.items()}


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta, float(((y - x @ beta) ** 2).sum()), np.linalg.pinv(x.T @ x)


def stationarity(y: np.ndarray) -> Result:
    """Augmented Dickey-Fuller (constant, lags by AIC, MacKinnon's p) and KPSS (level, automatic bandwidth)."""
    n = len(y)
    out: Result = {}
    if n < 12 or y.std() == 0:
        return out
    d, most = np.diff(y), min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    best = None
    for lags in range(most + 1):
        rows = np.arange(most, n - 1)
        x = np.column_stack([np.ones(len(rows)), y[rows], *[d[rows - k] for k in range(1, lags + 1)]])
        if len(rows) <= x.shape[1] + 1:
            break
        _, rss, _ = _ols(x, d[rows])
        aic = len(rows) * math.log(max(rss, 1e-300) / len(rows)) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lags)
    lags = best[1]
    rows = np.arange(lags, n - 1)
    x = np.column_stack([np.ones(len(rows)), y[rows], *[d[rows - k] for k in range(1, lags + 1)]])
    beta, rss, inverse = _ols(x, d[rows])
    se = math.sqrt(max(rss / max(len(rows) - x.shape[1], 1) * inverse[1, 1], 1e-300))
    tau = float(beta[1] / se)
    # fixed values: MacKinnon's response surface for one series with a constant
    if tau > 2.74:
        p = 1.0
    elif tau < -18.83:
        p = 0.0
    else:
        c = (2.1659, 1.4412, 0.038269) if tau <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
        p = 1 - normal_sf(sum(k * tau**i for i, k in enumerate(c)))
    out |= {"adf": tau, "adf_p": p, "adf_lags": float(lags)}
    e = y - y.mean()
    width = int(n ** (2 / 9))
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, width + 1):
        g = 2 * float(e[i:] @ e[:-i]) / n
        s0, s1 = s0 + g, s1 + i * g
    band = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 else 0, n - 1)
    long_run = float(e @ e) / n + 2 * sum((1 - i / (band + 1)) * float(e[i:] @ e[:-i]) / n for i in range(1, band + 1))
    if long_run > 0:
        eta = float((np.cumsum(e) ** 2).sum() / n**2 / long_run)
        # fixed values: critical values of KPSS for a level
        out |= {"kpss": eta, "kpss_p": float(np.interp(eta, [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]))}
    return out


def acf(y: np.ndarray, lags: int) -> np.ndarray:
    e = y - y.mean()
    total = float(e @ e)
    return np.array([1.0] + [float(e[k:] @ e[:-k]) / total if total else 0.0 for k in range(1, lags + 1)])


def pacf(y: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelations by Durbin and Levinson's recursion."""
    r, phi, out = acf(y, lags), np.zeros(0), [1.0]
    for k in range(1, lags + 1):
        below = 1 - float(phi @ r[1:k]) if k > 1 else 1.0
        last = (r[k] - (float(phi @ r[1:k][::-1]) if k > 1 else 0.0)) / below if below else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        out.append(last)
    return np.array(out)


def correlations(y: np.ndarray) -> Result:
    n = len(y)
    lags = min(24, n // 4)
    if lags < 1 or y.std() == 0:
        return {}
    out = {f"acf_{k}": float(v) for k, v in enumerate(acf(y, lags)) if k} | {f"pacf_{k}": float(v) for k, v in enumerate(pacf(y, min(lags, n // 2 - 1))) if k}
    m = max(1, min(10, n // 5))
    r = acf(y, m)[1:]
    q = float(n * (n + 2) * (r**2 / (n - np.arange(1, m + 1))).sum())
    return out | {"ljung_box": q, "ljung_box_p": chi2_sf(q, m)}


def arch(y: np.ndarray) -> Result:
    k = min(5, len(y) // 5)
    e2 = (y - y.mean()) ** 2
    if len(y) < 16 or e2.std() == 0:
        return {}
    x = np.column_stack([np.ones(len(y) - k), *[e2[k - i : len(y) - i] for i in range(1, k + 1)]])
    target = e2[k:]
    _, rss, _ = _ols(x, target)
    total = float(((target - target.mean()) ** 2).sum())
    lm = len(target) * (1 - rss / total) if total else 0.0
    return {"arch_lm": lm, "arch_p": chi2_sf(lm, k)}


def _loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: int, weight: np.ndarray) -> np.ndarray:
    """Local linear fits with tricube weights over the ``span`` nearest points."""
    distance = np.abs(at[:, None] - x[None, :])
    k = min(span, len(x))
    reach = np.sort(distance, axis=1)[:, k - 1] * max(1.0, span / len(x))
    w = np.clip(1 - (distance / np.maximum(reach, 1e-9)[:, None]) ** 3, 0, 1) ** 3 * weight
    s = np.maximum(w.sum(axis=1), 1e-12)
    xm, ym = (w * x).sum(axis=1) / s, (w * y).sum(axis=1) / s
    sxx = (w * (x - xm[:, None]) ** 2).sum(axis=1)
    sxy = (w * (x - xm[:, None]) * (y - ym[:, None])).sum(axis=1)
    return ym + np.where(sxx > 1e-12, sxy / np.maximum(sxx, 1e-12), 0.0) * (at - xm)


def stl(y: np.ndarray, season: int, outer: int = 5, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, remainder) by robust seasonal-trend decomposition with LOESS."""
    n, t = len(y), np.arange(len(y), dtype=float)
    odd = lambda v: int(v) + 1 - int(v) % 2
    span_t, span_l = odd(1.5 * season / (1 - 1.5 / 7)), odd(season)
    trend_, seasonal, robust = np.zeros(n), np.zeros(n), np.ones(n)
    for _ in range(outer):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * season)
            for p in range(season):
                at = np.arange(p, n, season)
                k = np.arange(len(at), dtype=float)
                cycle[p : n + 2 * season : season][: len(at) + 2] = _loess(k, (y - trend_)[at], np.arange(-1, len(at) + 1, dtype=float), 7, robust[at])
            low = cycle
            for width in (season, season, 3):
                low = np.convolve(low, np.ones(width) / width, "valid")
            seasonal = cycle[season : season + n] - _loess(t, low[:n], t, span_l, np.ones(n))
            trend_ = _loess(t, y - seasonal, t, span_t, robust)
        rest = np.abs(y - trend_ - seasonal)
        limit = 6 * float(np.median(rest))
        robust = np.clip(1 - (rest / limit) ** 2, 0, 1) ** 2 if limit > 0 else np.ones(n)
    return trend_, seasonal, y - trend_ - seasonal


def decomposition(y: np.ndarray, season: int) -> Result:
    if season < 2 or len(y) < 2 * season:
        return {}
    trend_, seasonal, rest = stl(y, season)
    strength = lambda part: max(0.0, 1 - float(rest.var()) / max(float((rest + part).var()), 1e-12))
    z = 0.67448975 * (rest - np.median(rest)) / max(float(np.median(np.abs(rest - np.median(rest)))), 1e-9)
    smooth = np.zeros(len(y))
    for i in range(len(y)):
        smooth[i] = 0.2 * z[i] + 0.8 * (smooth[i - 1] if i else z[0])
    return {"trend_strength": strength(trend_), "seasonal_strength": strength(seasonal), "anomalies": float((np.abs(z) >= 3.5).sum()), "severe_anomalies": float((np.abs(z) >= 5).sum()), "ewma_alarms": float((np.abs(smooth) >= 2.5).sum())}


def multivariate_anomalies(y: np.ndarray) -> Result:
    """Points whose value, change and local level lie far off in units of the median deviation."""
    if len(y) < 8:
        return {}
    f = np.column_stack([y, np.diff(y, prepend=y[0]), np.convolve(np.pad(y, 1, mode="edge"), np.ones(3) / 3, "valid")])
    mid = np.median(f, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(f - mid), axis=0), 1e-9)
    return {"multivariate_anomalies": float((np.sqrt((((f - mid) / spread) ** 2).sum(axis=1)) >= 3.7324821).sum())}


def change_points(y: np.ndarray, season: int) -> list[int]:
    """Exact penalised segmentation with a Gaussian-kernel cost (width by the median heuristic), pruned."""
    n, least = len(y), max(3, season // 4)
    if n < 2 * least or y.std() == 0:
        return []
    gaps = (y[:, None] - y[None, :]) ** 2
    middle = float(np.median(gaps[np.triu_indices(n, 1)]))
    gram = np.exp(-gaps / (middle if middle > 0 else 1.0))
    block = np.pad(gram.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    penalty = max(math.log(n), 1e-9)

    def cost(a: int, b: int) -> float:
        return (b - a) - float(block[b, b] - block[a, b] - block[b, a] + block[a, a]) / (b - a)

    best, last, open_ = {0: -penalty}, {}, [0]
    for b in range(least, n + 1):
        tries = [(best[a] + cost(a, b) + penalty, a) for a in open_ if b - a >= least]
        if not tries:
            continue
        best[b], last[b] = min(tries)
        open_ = [a for a in open_ if b - a < least or best[a] + cost(a, b) <= best[b]] + [b]
    out, b = [], n
    while b in last and last[b]:
        b = last[b]
        out.append(b)
    return sorted(out)


def spectrum(y: np.ndarray) -> Result:
    if len(y) < 8 or y.std() == 0:
        return {}
    power = np.abs(np.fft.rfft(y - y.mean()))[1:] ** 2
    freq = np.fft.rfftfreq(len(y))[1:]
    p = power / power.sum()
    entropy = -float((p[p > 0] * np.log(p[p > 0])).sum())
    return {"dominant_period": float(1 / freq[power.argmax()]), "dominant_power": float(p.max()), "spectral_entropy": entropy / math.log(len(p)) if len(p) > 1 else 0.0}


def wavelet(y: np.ndarray) -> Result:
    """Scale of most energy under the complex Morlet wavelet with bandwidth 1.5 and centre frequency 1."""
    n = len(y)
    if n < 16 or y.std() == 0:
        return {}
    e, energy = y - y.mean(), []
    scales_ = np.arange(2, min(128, n // 2) + 1)
    for s in scales_:
        t = np.arange(-4 * s, 4 * s + 1) / s
        psi = np.exp(2j * math.pi * t - t**2 / 1.5) / math.sqrt(math.pi * 1.5 * s)
        energy.append(float((np.abs(np.convolve(e, psi, "full")[4 * s : 4 * s + n]) ** 2).mean()))
    e_ = np.array(energy)
    return {"wavelet_scale": float(scales_[e_.argmax()]), "wavelet_share": float(e_.max() / e_.sum())}


def _spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline."""
    n, h = len(x), np.diff(x)
    if n < 3:
        return np.interp(at, x, y)
    a = np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    rhs = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 3 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    c = np.linalg.solve(a, rhs)
    b = np.diff(y) / h - h * (2 * c[:-1] + c[1:]) / 3
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    dx = at - x[i]
    return y[i] + b[i] * dx + c[i] * dx**2 + (c[i + 1] - c[i]) / (3 * h[i]) * dx**3


def emd(y: np.ndarray, most: int = 6, sifts: int = 30) -> tuple[list[np.ndarray], np.ndarray]:
    """Intrinsic mode functions and the residue; they sum to the series."""
    t, rest, modes = np.arange(len(y), dtype=float), y.astype(float).copy(), []
    for _ in range(most):
        h = rest.copy()
        for _ in range(sifts):
            inner = np.arange(1, len(h) - 1)
            tops = inner[(h[inner] > h[inner - 1]) & (h[inner] >= h[inner + 1])]
            lows = inner[(h[inner] < h[inner - 1]) & (h[inner] <= h[inner + 1])]
            if len(tops) < 2 or len(lows) < 2:
                break
            ends = [0, len(h) - 1]
            up, down = np.unique([*ends, *tops]), np.unique([*ends, *lows])
            mean = (_spline(up.astype(float), h[up], t) + _spline(down.astype(float), h[down], t)) / 2
            new = h - mean
            moved = float(((h - new) ** 2).sum() / max(float((h**2).sum()), 1e-12))
            h = new
            if moved < 0.05:
                break
        if np.allclose(h, rest):
            break
        modes.append(h)
        rest = rest - h
    return modes, rest


def hilbert_modes(y: np.ndarray) -> Result:
    if len(y) < 24 or y.std() == 0:
        return {}
    modes, _ = emd(y)
    out: Result = {"modes": float(len(modes))}
    total = sum(float((m**2).sum()) for m in modes) or 1.0
    for k, m in enumerate(modes, 1):
        f = np.fft.fft(m)
        f[1 : (len(m) + 1) // 2] *= 2
        f[len(m) // 2 + 1 :] = 0
        phase = np.unwrap(np.angle(np.fft.ifft(f)))
        speed = np.diff(phase) / (2 * math.pi)
        out |= {f"mode_{k}_energy": float((m**2).sum()) / total, f"mode_{k}_frequency": float(np.median(speed))}
    return out


def scaling(y: np.ndarray) -> Result:
    """Hurst exponent by lagged differences and Higuchi's fractal dimension."""
    n = len(y)
    if n < 20 or y.std() == 0:
        return {}
    lags = np.arange(2, max(4, min(20, n // 2)))
    spread = np.array([max(float((y[k:] - y[:-k]).std()), 1e-12) for k in lags])
    lengths = []
    ks = np.arange(1, max(3, min(8, n // 4)) + 1)
    for k in ks:
        each = [np.abs(np.diff(y[m::k])).sum() * (n - 1) / (len(y[m::k]) - 1) / k / k for m in range(k) if len(y[m::k]) > 1]
        lengths.append(max(float(np.mean(each)), 1e-12))
    return {"hurst": float(np.polyfit(np.log(lags), np.log(spread), 1)[0]), "higuchi_fd": float(-np.polyfit(np.log(ks), np.log(lengths), 1)[0])}


def entropies(y: np.ndarray) -> Result:
    n, out = len(y), {}
    for order in (3, 4):
        if n >= order + 1:
            patterns = np.argsort(np.lib.stride_tricks.sliding_window_view(y, order), axis=1, kind="stable")
            p = np.unique(patterns, axis=0, return_counts=True)[1] / len(patterns)
            out[f"permutation_entropy_{order}"] = float(-(p * np.log(p)).sum() / math.log(math.factorial(order)))
    r = 0.2 * float(y.std())
    if n >= 10 and r > 0:

        def matches(m: int) -> int:
            w = np.lib.stride_tricks.sliding_window_view(y, m)[: n - 2]
            return sum(int((np.abs(w[i + 1 :] - w[i]).max(axis=1) <= r).sum()) for i in range(len(w) - 1))

        b, a = matches(2), matches(3)
        if a and b:
            out["sample_entropy"] = -math.log(a / b)
    return out


def recurrence(y: np.ndarray) -> Result:
    """Recurrence rate, determinism and laminarity of the series embedded in three dimensions."""
    if len(y) < 12 or y.std() == 0 or len(y) > 5000:
        return {}
    w = np.lib.stride_tricks.sliding_window_view(y, 3)
    d = np.sqrt(((w[:, None] - w[None]) ** 2).sum(axis=2))
    near = d <= np.quantile(d[np.triu_indices(len(w), 1)], 0.1)
    np.fill_diagonal(near, False)
    total = int(near.sum())

    def lined(rows) -> int:
        count = 0
        for row in rows:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(int), [0]])))
            runs = edge[1::2] - edge[::2]
            count += int(runs[runs >= 2].sum())
        return count

    k = len(w)
    diagonal = lined(np.diagonal(near, o) for o in range(1, k)) * 2
    return {"recurrence_rate": total / (k * (k - 1)), "determinism": diagonal / total if total else 0.0, "laminarity": lined(near.T) / total if total else 0.0}


def lag_information(y: np.ndarray) -> Result:
    """Mutual information of neighbours over four quantile bins, as a share of the entropy."""
    if len(y) < 16:
        return {}
    bins = np.searchsorted(np.quantile(y, [0.25, 0.5, 0.75]), y, "right")
    joint = np.zeros((4, 4))
    np.add.at(joint, (bins[:-1], bins[1:]), 1)
    p = joint / joint.sum()
    a, b = p.sum(axis=1), p.sum(axis=0)
    use = p > 0
    mi = float((p[use] * np.log(p[use] / np.outer(a, b)[use])).sum())
    h = -float((a[a > 0] * np.log(a[a > 0])).sum())
    return {"lag_information": mi / h if h > 0 else 0.0}


#: Diagnostic methods by name: (values, season) -> statistics.
METHODS = {
    "series_profile": lambda y, s: profile(y),
    "trend": lambda y, s: trend(y),
    "stationarity": lambda y, s: stationarity(y),
    "acf_pacf_ljung_box": lambda y, s: correlations(y),
    "arch_lm": lambda y, s: arch(y),
    "stl": decomposition,
    "multivariate_anomaly": lambda y, s: multivariate_anomalies(y),
    "pelt": lambda y, s: {f"change_{i}": float(c) for i, c in enumerate(change_points(y, s), 1)},
    "periodogram": lambda y, s: spectrum(y),
    "wavelet": lambda y, s: wavelet(y),
    "emd_hht": lambda y, s: hilbert_modes(y),
    "scaling": lambda y, s: scaling(y),
    "entropy": lambda y, s: entropies(y),
    "recurrence": lambda y, s: recurrence(y),
    "lag_information": lambda y, s: lag_information(y),
}
