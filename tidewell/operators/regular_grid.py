"""Irregular readings onto a regular grid, missing periods imputed by singular-spectrum analysis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import periods
from tidewell.operators.series import GRAINS, Batch, linear, pack

#: Rounds before slow series are extrapolated.
PLAIN = 400
#: Longest window by resolution: a season and more of months and quarters, two weeks of days, a quarter of weeks (a year's wave is smooth there).
WINDOWS = {"day": 14, "week": 13, "month": 12, "quarter": 8, "year": 12}
SCHEMA = "source_id string, source_subunit string, resolution string, period_start date, value double, is_filled boolean"


def impute(values: np.ndarray, present: np.ndarray, length: np.ndarray, rank: int = 3, tolerance: float = 1e-3, longest: np.ndarray | int = 12) -> np.ndarray:
    """Fill the absent entries of a stack of series by iterative singular-spectrum imputation.

    ``values`` and ``present`` are (series, periods) padded on the right, ``length`` the true
    lengths. Gaps start from linear interpolation; each round embeds every series in a Hankel
    trajectory matrix, keeps its ``rank`` leading singular vectors, averages the anti-diagonals and
    replaces only the absent entries, until these move by less than ``tolerance`` standard
    deviations. There is no bound on the rounds: each is a step of alternating least squares, so the
    squared moves add up to no more than the first misfit and fall below any tolerance; only the
    series still moving go on. After ``PLAIN`` rounds one in three is extrapolated where that leaves no
    larger misfit, so that slow series end sooner, by the same test on a plain round. The window is a quarter of the length, at least 2 and at most ``longest``.
    """
    out = values.copy()
    for i in range(len(out)):
        n, have = length[i], np.flatnonzero(present[i, : length[i]])
        if 0 < len(have) < n:
            out[i, :n] = np.interp(np.arange(n), have, out[i, have])
    seen = present.sum(axis=1)
    need = np.flatnonzero((length >= 3) & (seen < length) & (seen > 0))
    window = np.clip(length[need] // 4, 2, np.broadcast_to(longest, len(length))[need])
    order = np.lexsort((length[need], window))
    need, window = need[order], window[order]
    start = 0
    while start < len(need):
        w = int(window[start])
        same = start + int(np.searchsorted(window[start:], w, side="right"))
        # as many series at a time as give some 2 million trajectory entries
        stop = start + 1
        while stop < same and (stop - start + 1) * length[need[stop]] * w < 2_000_000 and length[need[stop]] < 1.3 * length[need[start]] + 8:
            stop += 1
        _spectrum(out, present, length, need[start:stop], w, min(rank, w - 1), tolerance)
        start = stop
    return out


def _spectrum(out: np.ndarray, present: np.ndarray, length: np.ndarray, rows: np.ndarray, window: int, rank: int, tolerance: float) -> None:
    size = int(length[rows].max())
    inside = np.arange(size) < length[rows][:, None]
    absent = inside & ~present[rows, :size]
    x = np.where(inside, out[rows, :size], 0.0)
    mean = x.sum(axis=1, keepdims=True) / length[rows][:, None]
    scale = np.sqrt((np.where(inside, x - mean, 0.0) ** 2).sum(axis=1, keepdims=True) / length[rows][:, None])
    scale[scale == 0] = 1.0
    x = np.where(inside, (x - mean) / scale, 0.0)
    columns = size - window + 1
    whole = (np.arange(columns) < (length[rows] - window + 1)[:, None])[:, :, None]
    shares = np.zeros_like(x)
    for k in range(window):
        shares[:, k : k + columns] += whole[:, :, 0]
    shares[shares == 0] = 1.0
    def step(part: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One round for the series ``who``: (values, misfit of the low-rank trajectories before it)."""
        n = part.shape[1] - window + 1
        path = np.lib.stride_tricks.sliding_window_view(part, window, axis=1) * whole[who, :n]
        roots, basis = np.linalg.eigh(path.transpose(0, 2, 1) @ path)
        basis = basis[:, :, -rank:]
        low = path @ (basis @ basis.transpose(0, 2, 1))
        again = np.zeros_like(part)
        for k in range(window):
            again[:, k : k + n] += low[:, :, k]
        again /= shares[who, : part.shape[1]]
        return np.where(absent[who, : part.shape[1]], again, part), roots[:, :-rank].sum(axis=1)

    active = np.arange(len(rows))
    done = 0
    while len(active):
        wide = int(length[rows][active].max())
        old = x[active, :wide]
        new, misfit = step(old, active)
        if done >= PLAIN and done % 3 == 0:
            # two rounds extrapolated; kept where the misfit is no larger than after the two
            newer, _ = step(new, active)
            first, second = new - old, newer - 2 * new + old
            far = np.sqrt((first**2).sum(axis=1) / np.maximum((second**2).sum(axis=1), 1e-300))[:, None]
            jump = np.where(absent[active, :wide], old + 2 * far * first + far**2 * second, old)
            fine = np.isfinite(jump).all(axis=1) & (far[:, 0] > 1)
            jump[~fine] = newer[~fine]
            after, there = step(jump, active)
            usual, here = step(newer, active)
            better = fine & (there <= here)
            old, new = np.where(better[:, None], jump, newer), np.where(better[:, None], after, usual)
        done += 1
        x[active, :wide] = new
        active = active[np.abs(new - old).max(axis=1) > tolerance]
    filled = x * scale + mean
    block = out[rows, :size]
    block[absent] = filled[absent]
    out[rows, :size] = block


def _kernel(only_filled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                b = Batch(batch)
                if not len(b.owner):
                    continue
                last = np.append((b.owner[1:] != b.owner[:-1]) | (b.period[1:] != b.period[:-1]), True)
                owner, period, value = b.owner[last], b.period[last], b.value[last]
                heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                series, begin = owner[heads], period[heads]
                length = np.append(period[heads[1:] - 1], period[-1]) - begin + 1
                for chunk in _chunks(length):
                    lines = np.full(b.n, -1)
                    lines[series[chunk]] = np.arange(len(chunk))
                    mine = lines[owner] >= 0
                    size = int(length[chunk].max())
                    values, present = np.zeros((len(chunk), size)), np.zeros((len(chunk), size), bool)
                    at = lines[owner[mine]], period[mine] - begin[chunk][lines[owner[mine]]]
                    values[at], present[at] = value[mine], True
                    usable = present & np.isfinite(values)
                    longest = np.array([WINDOWS[g] for g in GRAINS])[b.grain[series[chunk]]]
                    full = np.where(present, values, impute(np.where(usable, values, 0.0), usable, length[chunk], longest=longest))
                    show = np.arange(size) < length[chunk][:, None]
                    if only_filled:
                        show &= ~present
                    i, t = np.nonzero(show)
                    rows = series[chunk][i]
                    grain = b.grain[rows]
                    starts = periods.ordinal_start(begin[chunk][i] + t, grain)
                    yield pa.RecordBatch.from_arrays(
                        [
                            linear(batch.column("source_id"), rows),
                            linear(batch.column("source_subunit"), rows),
                            pa.array(GRAINS).take(pa.array(grain)),
                            pa.array(starts.astype(np.int32), pa.date32()),
                            pa.array(full[i, t]),
                            pa.array(~present[i, t]),
                        ],
                        names=["source_id", "source_subunit", "resolution", "period_start", "value", "is_filled"],
                    )

    return run


def _chunks(length: np.ndarray, most: int = 4_000_000) -> Iterator[np.ndarray]:
    """Series of like length together, each block of a bounded padded size."""
    order = np.argsort(length, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * length[order[stop]] <= most:
            stop += 1
        yield order[start:stop]
        start = stop


def regular_grid(df: DataFrame, only_filled: bool = False) -> DataFrame:
    """One row per (source_id, source_subunit) and period from its first to its last usable reading.

    The resolution of a series is the one most of its rows state (the finer on a tie; if none
    states one, the usual step between dates). Of several readings in a period the latest
    published counts, then the later date, then the larger value. A period without a reading
    other than null or NaN is marked ``is_filled`` and its value imputed (see ``impute``);
    infinite readings stay but are as absent in the imputation. Series without a usable reading and
    rows without a date give no rows; null keys are a series of their own; extra columns are
    ignored. ``only_filled`` returns the marked rows alone.
    """
    return pack(df, by_value=False).mapInArrow(_kernel(only_filled), SCHEMA)


def missing_periods(df: DataFrame) -> DataFrame:
    """Marked periods of ``regular_grid`` as (source_id, source_subunit, period_start text)."""
    return regular_grid(df, only_filled=True).select("source_id", "source_subunit", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"))
