"""Kernels on a matrix of places by periods: factors, synchrony, lead-lag, transfer entropy, dynamic modes, clusters, scan."""

from __future__ import annotations

import math

import numpy as np


def standardised(x: np.ndarray) -> np.ndarray:
    z = np.log1p(np.maximum(x, 0))
    spread = z.std(axis=1, keepdims=True)
    return (z - z.mean(axis=1, keepdims=True)) / np.where(spread > 0, spread, 1.0)


def factors(x: np.ndarray) -> dict[str, float]:
    """Variance shares of the leading factors, effective rank and participation ratio; loadings are oriented to a positive sum."""
    s = np.linalg.svd(standardised(x), compute_uv=False)
    share = s**2 / max(float((s**2).sum()), 1e-12)
    use = share[share > 0]
    return {f"factor_{i}": float(v) for i, v in enumerate(share[:5], 1)} | {"effective_rank": math.exp(-float((use * np.log(use)).sum())), "participation_ratio": 1 / float((share**2).sum()) if len(use) else 0.0}


def synchrony(x: np.ndarray) -> dict[str, float]:
    z = standardised(x)
    r = (z @ z.T / x.shape[1])[np.triu_indices(len(x), 1)]
    q = np.quantile(r, [0.25, 0.5, 0.75])
    return {"median_r": float(q[1]), "iqr_r": float(q[2] - q[0]), "negative_share": float((r < 0).mean())}


def lead_lag(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """Lag (b behind a if positive) of the largest absolute correlation within min(12, T // 4)."""
    best = (0, 0.0)
    for k in range(-min(12, len(a) // 4), min(12, len(a) // 4) + 1):
        u, v = (a[: len(a) - k], b[k:]) if k >= 0 else (a[-k:], b[:k])
        if u.std() > 0 and v.std() > 0:
            r = float(np.corrcoef(u, v)[0, 1])
            if abs(r) > abs(best[1]):
                best = (k, r)
    return best


def transfer_entropy(a: np.ndarray, b: np.ndarray, bins: int = 4) -> float:
    """Bits that the past of a adds to what the past of b tells about b."""
    cut = lambda v: np.searchsorted(np.quantile(v, np.arange(1, bins) / bins), v, "right")
    p, q = cut(a), cut(b)
    joint = np.zeros((bins, bins, bins))
    np.add.at(joint, (q[1:], q[:-1], p[:-1]), 1)
    joint /= joint.sum()
    now_past, past_both, past = joint.sum(axis=2), joint.sum(axis=0), joint.sum(axis=(0, 2))
    i, j, k = np.nonzero(joint)
    return float((joint[i, j, k] * np.log2(joint[i, j, k] * past[j] / (past_both[j, k] * now_past[i, j]))).sum())


def dynamic_modes(x: np.ndarray, rank: int = 10) -> list[tuple[float, float]]:
    """(growth, frequency) of the modes of the best linear step from one period to the next."""
    z = standardised(x)
    u, s, vt = np.linalg.svd(z[:, :-1], full_matrices=False)
    r = max(1, min(rank, int((s > 1e-9 * s[0]).sum()))) if s[0] > 0 else 1
    step = u[:, :r].T @ z[:, 1:] @ vt[:r].T / np.maximum(s[:r], 1e-12)
    values = np.linalg.eigvals(step)
    return [(float(np.log(max(abs(v), 1e-12))), float(np.angle(v) / (2 * math.pi))) for v in values]


def warp(a: np.ndarray, b: np.ndarray, band: float = 0.1) -> float:
    """Dynamic time warping distance within a Sakoe-Chiba band."""
    n, w = len(a), max(1, int(band * len(a)))
    before = np.full(n + 1, np.inf)
    before[0] = 0.0
    for i in range(1, n + 1):
        now = np.full(n + 1, np.inf)
        for j in range(max(1, i - w), min(n, i + w) + 1):
            now[j] = abs(a[i - 1] - b[j - 1]) + min(before[j], now[j - 1], before[j - 1])
        before = now
    return float(before[n])


def clusters(x: np.ndarray, most: int = 6) -> np.ndarray:
    """Average-linkage clusters of the warped distances; their number, 2 to ``most``, by the silhouette."""
    z = standardised(x)
    n = len(z)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            d[i, j] = d[j, i] = warp(z[i], z[j])
    groups, kept = [[i] for i in range(n)], {}
    while len(groups) > 1:
        if 2 <= len(groups) <= most:
            label = np.zeros(n, int)
            for k, g in enumerate(groups):
                label[g] = k
            kept[len(groups)] = label
        pairs = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]

    def silhouette(label: np.ndarray) -> float:
        out = []
        for i in range(n):
            own = label == label[i]
            if own.sum() < 2:
                out.append(0.0)
                continue
            a = d[i][own].sum() / (own.sum() - 1)
            b = min(d[i][label == k].mean() for k in set(label) if k != label[i])
            out.append((b - a) / max(a, b, 1e-12))
        return float(np.mean(out))

    return max(kept.values(), key=silhouette) if kept else np.zeros(n, int)


def scan(x: np.ndarray, near: list[list[int]], longest: int = 4, draws: int = 99, seed: int = 20250828) -> tuple[float, int, int, int, float]:
    """Most unusual (neighbourhood, first period, length) by Poisson likelihood ratio, with a Monte-Carlo p-value."""
    total = float(x.sum())
    expected = np.outer(x.sum(axis=1), x.sum(axis=0)) / max(total, 1e-12)
    member = np.zeros((len(x), len(x)))
    for i, others in enumerate(near):
        member[i, [i, *others]] = 1

    def best(counts: np.ndarray) -> tuple[float, int, int, int]:
        top = (0.0, 0, 0, 0)
        o, e = np.cumsum(np.pad(member @ counts, ((0, 0), (1, 0))), axis=1), np.cumsum(np.pad(member @ expected, ((0, 0), (1, 0))), axis=1)
        for w in range(1, longest + 1):
            a, b = o[:, w:] - o[:, :-w], e[:, w:] - e[:, :-w]
            ok = (a > b) & (a > 0) & (a < total) & (b > 0) & (b < total)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(ok, a * np.log(a / b) + (total - a) * np.log((total - a) / (total - b)), 0.0)
            i, t = np.unravel_index(score.argmax(), score.shape)
            top = max(top, (float(score[i, t]), int(i), int(t), w))
        return top

    seen = best(x)
    rng = np.random.default_rng(seed)
    share = (expected / max(expected.sum(), 1e-12)).ravel()
    above = sum(best(rng.multinomial(int(round(total)), share).reshape(x.shape).astype(float))[0] >= seen[0] for _ in range(draws))
    return (*seen, (above + 1) / (draws + 1))
