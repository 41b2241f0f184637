"""Implausible readings of a series: impossible values, short spikes and stuck runs.

A local-level state-space model is filtered forward and backward over every series. Readings whose
standardised innovation is too large are withheld from the update; a reading is a spike if it is
so against both filters. A series is stuck where the variance of the innovations of the same filter without observation noise
(so that the state follows every reading) vanishes over a window; runs of equal readings there are then checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.series import Batch, linear, pack

# What a metric can take as (scale, least, most). Counts are whole numbers.
METRIC_RANGES = {
    "cases": ("count", 0.0, np.inf),
    "deaths": ("count", 0.0, np.inf),
    "hospital_admissions": ("count", 0.0, np.inf),
    "vector_trap_count": ("count", 0.0, np.inf),
    "population": ("count", 0.0, np.inf),
    "rainfall": ("amount", 0.0, np.inf),
    "incidence_rate": ("amount", 0.0, np.inf),
    "larvicide_used": ("amount", 0.0, np.inf),
    "area": ("amount", 0.0, np.inf),
    "response_delay": ("amount", 0.0, np.inf),
    "bed_occupancy": ("share", 0.0, 100.0),
    "larva_free_index": ("share", 0.0, 100.0),
    "tests_positive": ("share", 0.0, 100.0),
    "mean_temperature": ("level", -60.0, 60.0),
}
SCALES = ("count", "amount", "share", "level")
# Least deviation of a spike by scale: a factor e (more for rare counts), ten points, four degrees.
LEAST_SIZE = (1.0, 1.0, 10.0, 4.0)
SCHEMA = "source_id string, source_subunit string, day int, value double, reason string, score double"
REASONS = ("impossible", "spike", "stuck")


def impossible(value: np.ndarray, scale: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Readings outside the range of their metric, infinite, or fractional where it counts things."""
    with np.errstate(invalid="ignore"):
        return ~np.isfinite(value) | (value < least) | (value > most) | ((scale == 0) & (value != np.floor(value)))


def _spread(x: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Robust variance about zero of the rows of ``x`` where ``have``."""
    size = np.where(have, np.abs(x), np.nan)
    size[~have.any(axis=1), 0] = 0.0
    return (1.4826 * np.nanmedian(size, axis=1)) ** 2


def noise(y: np.ndarray, n: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state variance per step, observation variance) from one- and two-step differences."""
    width = y.shape[1]
    inside = np.arange(width) < n[:, None]

    def step(k: int) -> np.ndarray:
        if width <= k:
            return np.zeros(len(y))
        return _spread(y[:, k:] - y[:, :-k], inside[:, k:])

    one, two = step(1), step(2)
    observed = np.maximum(np.maximum(one - two / 2, 0.25 * one), floor)
    return np.maximum(two - one, 0.05 * observed), observed


def kalman(y: np.ndarray, gap: np.ndarray, n: np.ndarray, q: np.ndarray, r: np.ndarray, counts: np.ndarray, limit: float, patience: int) -> tuple[np.ndarray, np.ndarray]:
    """One-step predictions (mean, variance with observation noise) of a stack of series.

    The state starts at the median of the first seven readings, so that the first can be judged.
    ``gap`` is the number of periods since the reading before. An innovation beyond ``limit``
    standard deviations is withheld; the ``patience``-th in a row is taken for a new level.
    """
    width = y.shape[1]
    mean, var = np.empty_like(y), np.empty_like(y)
    early = np.where(np.arange(min(width, 7)) < n[:, None], y[:, :7], np.nan)
    state, error, held = np.nanmedian(early, axis=1), 4 * q + r, np.zeros(len(y), int)
    for t in range(width):
        error = error + q * gap[:, t]
        level = np.maximum(np.expm1(np.minimum(state, 50.0)), 0.3)
        noise_t = np.where(counts, np.maximum(r, level / (level + 1) ** 2), r)
        mean[:, t], var[:, t] = state, error + noise_t
        innovation = y[:, t] - state
        far = np.abs(innovation) > limit * np.sqrt(var[:, t])
        held = np.where(far, held + 1, 0)
        renew = held >= patience
        gain = np.where(renew, 1.0, np.where(far, 0.0, error / var[:, t]))
        state = state + gain * innovation
        error = np.where(renew, noise_t, (1 - gain) * error)
        held = np.where(renew, 0, held)
    return mean, var


def vanishing(y: np.ndarray, again: np.ndarray, n: np.ndarray, scale: np.ndarray, run: int) -> np.ndarray:
    """Readings in a window of ``run`` in which the innovation variance is zero, to a millionth of the variance ``scale`` of the series.

    The filter has no observation noise, so its gain is one and the innovation is the step from the state to the reading; where a
    period has several readings, and one of them is that of the period before (``again``), the state finds it there.
    """
    width = y.shape[1]
    inside = np.arange(width) < n[:, None]
    if width < run:
        return np.zeros_like(inside)
    mean, _ = kalman(y, np.ones_like(y), n, np.ones(len(y)), np.full(len(y), 1e-12), np.zeros(len(y), bool), np.inf, 1)
    innovation = np.where(again, 0.0, y - mean)
    innovation[:, 0] = np.inf
    still = np.where(inside, innovation**2 <= 1e-6 * scale[:, None], False)
    # mean square over run - 1 innovations: it vanishes only where each of them does
    total = np.cumsum(np.concatenate([np.zeros((len(y), 1)), ~still], axis=1), axis=1)
    last = np.zeros_like(inside)
    last[:, run - 1 :] = total[:, run:] - total[:, 1 : width - run + 2] == 0
    out = np.zeros_like(inside)
    for k in range(run):
        out[:, : width - k] |= last[:, k:]
    return out & inside


def _backward(y: np.ndarray, gap: np.ndarray, n: np.ndarray, *rest) -> tuple[np.ndarray, np.ndarray]:
    width = y.shape[1]
    turned = (n[:, None] - 1 - np.arange(width)) % width
    back_gap = np.take_along_axis(np.concatenate([gap[:, 1:], np.zeros((len(y), 1))], axis=1), turned, 1)
    mean, var = kalman(np.take_along_axis(y, turned, 1), back_gap, n, *rest)
    return np.take_along_axis(mean, turned, 1), np.take_along_axis(var, turned, 1)


def judge(b: Batch, metric: list[str | None], limit: float, stuck_run: int, stuck_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reading, reason, score) of the implausible readings of a batch; score is the smaller of both filters' innovations."""
    total = len(b.value)
    known = [METRIC_RANGES.get((m or "").strip().lower()) for m in metric]
    scale = np.array([SCALES.index(k[0]) if k else 3 for k in known])
    least = np.array([k[1] if k else -np.inf for k in known])
    most = np.array([k[2] if k else np.inf for k in known])
    reason = np.full(total, -1)
    score = np.zeros(total)
    own = b.owner
    bad = impossible(b.value, scale[own], least[own], most[own])
    reason[bad], score[bad] = 0, np.inf

    usable = np.flatnonzero(~bad)
    if not len(usable):
        hit = np.flatnonzero(reason >= 0)
        return hit, reason[hit], score[hit]
    logged = scale[own] <= 1
    y_all = np.where(logged, np.log1p(np.where(logged & ~bad, b.value, 0.0)), b.value)

    # the latest published usable reading of a period stands for it in the filters
    last = np.append((own[usable][1:] != own[usable][:-1]) | (b.period[usable][1:] != b.period[usable][:-1]), True)
    lead = usable[last]
    cell_of = np.zeros(total, int)
    cell_of[usable] = np.concatenate([[0], np.cumsum(last[:-1])])
    owner, period, y = own[lead], b.period[lead], y_all[lead]
    first = np.append(True, owner[1:] != owner[:-1])
    heads = np.flatnonzero(first)
    place = np.arange(len(lead)) - np.repeat(heads, np.diff(np.append(heads, len(lead))))
    count = np.diff(np.append(heads, len(lead)))
    series = owner[heads]
    step = np.where(first, 0, np.append(0, np.diff(period)))

    # periods in which some reading repeats one of the period before
    at_value = np.lexsort((cell_of[usable], b.value[usable], own[usable]))
    sorted_cell, sorted_own, sorted_value = cell_of[usable][at_value], own[usable][at_value], b.value[usable][at_value]
    repeats = np.zeros(len(lead), bool)
    repeats[sorted_cell[1:][(sorted_own[1:] == sorted_own[:-1]) & (sorted_value[1:] == sorted_value[:-1]) & (sorted_cell[1:] - sorted_cell[:-1] == 1)]] = True

    mean_f, var_f, mean_b, var_b, middle_of, reach_of = (np.zeros(len(lead)) for _ in range(6))
    stopped = np.zeros(len(lead), bool)
    for rows in _blocks(count):
        width = int(count[rows].max())
        line = np.full(len(heads), -1)
        line[rows] = np.arange(len(rows))
        of = line[np.cumsum(first) - 1]
        mine = of >= 0
        at = of[mine], place[mine]
        grid, gap = np.zeros((len(rows), width)), np.zeros((len(rows), width))
        grid[at], gap[at] = y[mine], step[mine]
        kind = scale[series[rows]]
        middle = np.where(np.arange(width) < count[rows][:, None], np.abs(grid), np.nan)
        floor = np.where(kind <= 1, 0.03**2, np.maximum(0.005 * np.nanmedian(middle, axis=1), 0.1) ** 2)
        inside = np.where(np.arange(width) < count[rows][:, None], grid, np.nan)
        center = np.nanmedian(inside, axis=1)
        reach = np.nanquantile(np.abs(inside - center[:, None]), 0.9, axis=1)
        middle_of[mine], reach_of[mine] = center[of[mine]], reach[of[mine]]
        q, r = noise(grid, count[rows], floor)
        again = np.zeros((len(rows), width), bool)
        again[at] = repeats[mine]
        stopped[mine] = vanishing(grid, again, count[rows], np.maximum(q + r, 1e-12), stuck_run)[at]
        more = (q, r, kind == 0, limit, 3)
        for (mean, var), (to_mean, to_var) in ((kalman(grid, gap, count[rows], *more), (mean_f, var_f)), (_backward(grid, gap, count[rows], *more), (mean_b, var_b))):
            to_mean[mine], to_var[mine] = mean[at], var[at]

    cell = cell_of[usable]
    z_f = (y_all[usable] - mean_f[cell]) / np.sqrt(var_f[cell])
    z_b = (y_all[usable] - mean_b[cell]) / np.sqrt(var_b[cell])
    least_z = np.where(np.sign(z_f) == np.sign(z_b), np.minimum(np.abs(z_f), np.abs(z_b)), 0.0)
    usual = (mean_f[cell] / var_f[cell] + mean_b[cell] / var_b[cell]) / (1 / var_f[cell] + 1 / var_b[cell])
    deviation = y_all[usable] - usual
    kind = scale[own[usable]]
    rare = np.where(kind == 0, 1.5 / (1 + np.maximum(np.expm1(np.minimum(usual, 50.0)), 0.0)), 0.0)
    size = np.abs(deviation) / (np.array(LEAST_SIZE)[kind] + rare)
    outside = np.abs(y_all[usable] - middle_of[cell]) > 2 * reach_of[cell]
    spike = (size > 1) & ((least_z > limit) | ((least_z > limit / 2) & (size > 1.3) & outside))

    # part of an excursion of three or more periods: a neighbour beyond the (at most two) spikes goes the same way
    hot = np.zeros(len(lead), bool)
    hot[cell[spike]] = True
    idx = np.arange(len(lead))
    start_of, end_of = idx.copy(), idx.copy()
    joined = np.append(False, hot[1:] & hot[:-1] & ~first[1:])
    group = np.cumsum(~joined)
    edges = np.flatnonzero(~joined)
    start_of = edges[group - 1]
    end_of = np.append(edges[1:], len(lead))[group - 1] - 1
    length = end_of - start_of + 1
    before, after = start_of[cell] - 1, end_of[cell] + 1
    for side in (before, after):
        ok = (side >= 0) & (side < len(lead))
        near = np.where(ok, side, 0)
        ok &= owner[near] == owner[cell]
        spike &= ~(ok & ((y[near] - usual) * np.sign(deviation) > 0.5 * np.abs(deviation)))
    spike &= length[cell] <= 2
    hit = usable[spike]
    reason[hit], score[hit] = 1, least_z[spike]

    # stuck: where innovations vanish, one value over stuck_run or more observed periods, in a series that seldom repeats a value otherwise
    by_value = np.lexsort((cell, b.value[usable], own[usable]))
    u, c = usable[by_value], cell[by_value]
    new = np.append(True, (own[u][1:] != own[u][:-1]) | (b.value[u][1:] != b.value[u][:-1]) | (c[1:] - c[:-1] > 1))
    run = np.cumsum(new) - 1
    cells_in = np.bincount(run, weights=np.append(True, c[1:] != c[:-1]) | new)
    long = ((cells_in >= stuck_run) & (np.bincount(run, weights=stopped[c]) > 0))[run]
    inside = np.zeros(len(lead), bool)
    inside[c[long]] = True
    pair = np.append(False, ~first[1:] & ~(inside[1:] & inside[:-1]))
    value = b.value[lead]
    same = pair & np.append(False, value[1:] == value[:-1])
    pairs = np.bincount(owner, weights=pair, minlength=b.n)
    share = np.bincount(owner, weights=same, minlength=b.n) / np.maximum(pairs, 1)
    moving = (pairs >= stuck_run) & (share < stuck_share)
    stuck = u[long & moving[own[u]]]
    stuck = stuck[reason[stuck] < 0]
    reason[stuck], score[stuck] = 2, share[own[stuck]]
    hit = np.flatnonzero(reason >= 0)
    return hit, reason[hit], score[hit]


def _blocks(count: np.ndarray, most: int = 1_000_000) -> Iterator[np.ndarray]:
    order = np.argsort(count, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * count[order[stop]] <= most:
            stop += 1
        yield order[start:stop]
        start = stop


def _kernel(limit: float, stuck_run: int, stuck_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                b = Batch(batch)
                if not len(b.owner):
                    continue
                hit, reason, score = judge(b, batch.column("metric").to_pylist(), limit, stuck_run, stuck_share)
                yield pa.RecordBatch.from_arrays(
                    [
                        linear(batch.column("source_id"), b.owner[hit]),
                        linear(batch.column("source_subunit"), b.owner[hit]),
                        pa.array(b.day[hit].astype(np.int32)),
                        pa.array(b.value[hit]),
                        pa.array(REASONS).take(pa.array(reason)),
                        pa.array(score),
                    ],
                    names=["source_id", "source_subunit", "day", "value", "reason", "score"],
                )

    return run


def implausible_readings(df: DataFrame, limit: float = 3.0, stuck_run: int = 7, stuck_share: float = 0.15) -> DataFrame:
    """(observation_id, reason, score) of the implausible rows of a table of readings.

    reason is impossible (outside METRIC_RANGES, infinite, or a fractional count), spike (one or
    two neighbouring periods beyond ``limit`` standardised innovations of the forward and the
    backward filter, or half of it where the reading also leaves twice the usual reach of the
    series, and of a least size; see LEAST_SIZE) or stuck (innovations of vanishing variance, and exactly the
    same value, over ``stuck_run`` or more periods with readings, in a series in which less than
    ``stuck_share`` of the other neighbouring periods repeat a value). Outbreaks, seasons and
    lasting changes of level span three periods or more and are none. All rows that repeat a
    flagged reading (same series, date and value) come out. Null and NaN values and rows without a
    date are no cases; unknown metrics have no impossible values but infinite ones; null keys are
    a series of their own. Only day-and-value aggregates are collected per series.
    """
    flagged = pack(df, by_value=True).mapInArrow(_kernel(limit, stuck_run, stuck_share), SCHEMA)
    rows = df.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("period_start").isNotNull()).select(
        "observation_id", "source_id", "source_subunit", F.unix_date("period_start").alias("day"), (F.col("value") + F.lit(0.0)).alias("value")
    )
    same = [rows[k].eqNullSafe(flagged[k]) for k in ("source_id", "source_subunit")] + [rows[k] == flagged[k] for k in ("day", "value")]
    return rows.join(flagged, same, "inner").select(rows["observation_id"], flagged["reason"], flagged["score"])
