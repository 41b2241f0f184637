"""Diagnostics of packed series and panels as rows of (series or panel, method, statistic, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.kernels import diagnose as dg
from tidewell.kernels import panel as pk
from tidewell.operators.forecasts import spread

ROWS = "series string, method string, statistic string, value double"


def series_diagnostics(packed: DataFrame, season: int = 12, least: int = 8, methods: list[str] | None = None) -> DataFrame:
    """Statistics of every method for packed series of ``least`` or more values (see forecasts.packed); undefined ones are left out."""
    names = [*(methods or dg.METHODS)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                y = np.asarray(row.values, float)
                y = y[np.isfinite(y)]
                if len(y) < least:
                    continue
                for name in names:
                    out += [(row.series, name, k, float(v)) for k, v in dg.METHODS[name](y, season).items() if np.isfinite(v)]
            yield pd.DataFrame(out, columns=["series", "method", "statistic", "value"])

    return spread(packed).mapInPandas(run, ROWS)


def panel_diagnostics(packed: DataFrame, panel: str, edges: list[tuple[str, str]] | None = None, most_places: int = 500) -> DataFrame:
    """Statistics of panels of packed series that share their periods: one matrix of places by periods per value of ``panel``.

    A panel is one matrix in one task: places are a reference list, and a panel of more than
    ``most_places`` is refused (an error) rather than cut. Series shorter than the longest are aligned at their end.
    """
    near = edges or []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, out = str(pdf[panel].iloc[0]), []
        if len(pdf) > most_places:
            raise ValueError(f"panel {name} has {len(pdf)} places; the matrix kernels take {most_places}")
        pdf = pdf.sort_values("series")
        rows = [np.asarray(v, float) for v in pdf["values"]]
        width = min(len(r) for r in rows)
        if len(rows) < 4 or width < 8:
            return pd.DataFrame(out, columns=["series", "method", "statistic", "value"])
        x, places = np.nan_to_num(np.array([r[-width:] for r in rows])), pdf["series"].tolist()
        out += [(name, "factors", k, v) for k, v in pk.factors(x).items()]
        out += [(name, "synchrony", k, v) for k, v in pk.synchrony(x).items()]
        for i, (growth, frequency) in enumerate(pk.dynamic_modes(x), 1):
            out += [(name, "dynamic_modes", f"growth_{i}", growth), (name, "dynamic_modes", f"frequency_{i}", frequency)]
        z = pk.standardised(x)
        r = z @ z.T / width
        pairs = sorted(((-abs(r[i, j]), i, j) for i in range(len(x)) for j in range(i + 1, len(x))))[:100]
        for _, i, j in pairs:
            lag, best = pk.lead_lag(x[i], x[j])
            pair = f"{places[i]}~{places[j]}"
            out += [(name, "lead_lag", f"lag:{pair}", float(lag)), (name, "lead_lag", f"r:{pair}", best)]
            if width >= 16:
                out += [(name, "transfer_entropy", f"{places[i]}>{places[j]}", pk.transfer_entropy(x[i], x[j])), (name, "transfer_entropy", f"{places[j]}>{places[i]}", pk.transfer_entropy(x[j], x[i]))]
        out += [(name, "dtw_cluster", p, float(c)) for p, c in zip(places, pk.clusters(x))]
        if near:
            at = {p: i for i, p in enumerate(places)}
            lists: list[list[int]] = [[] for _ in places]
            for a, b in near:
                if a in at and b in at:
                    lists[at[a]].append(at[b])
                    lists[at[b]].append(at[a])
            score, i, t, w, p = pk.scan(x, lists)
            out += [(name, "space_time_scan", k, float(v)) for k, v in (("score", score), ("place", i), ("start", t), ("length", w), ("p", p))]
        return pd.DataFrame(out, columns=["series", "method", "statistic", "value"])

    return packed.groupBy(panel).applyInPandas(run, ROWS)


def permutation_moran(values: DataFrame, group: str, place: str, value: str, edges: list[tuple[str, str]], draws: int = 199, seed: int = 20250828) -> DataFrame:
    """Permutation p-value of Moran's I of each group, reproducible by its name; groups are reference lists of places."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(place)[value].to_numpy(float)
        at = {p: i for i, p in enumerate(sorted(pdf[place]))}
        w = np.zeros((len(x), len(x)))
        for a, b in edges:
            if a in at and b in at:
                w[at[a], at[b]] = w[at[b], at[a]] = 1
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1)
        z = x - x.mean()
        below = float(z @ z)
        if below <= 0 or w.sum() == 0:
            return pd.DataFrame([], columns=["series", "method", "statistic", "value"])
        stat = lambda v: len(v) / w.sum() * float(v @ w @ v) / below
        rng = np.random.default_rng([seed, sum(map(ord, str(pdf[group].iloc[0])))])
        seen = stat(z)
        above = sum(stat(rng.permutation(z)) >= seen for _ in range(draws))
        name = str(pdf[group].iloc[0])
        p = (min(above, draws - above) + 1) / (draws + 1)
        return pd.DataFrame([(name, "moran", "i", seen), (name, "moran", "p", p)], columns=["series", "method", "statistic", "value"])

    return values.where(F.col(value).isNotNull()).groupBy(group).applyInPandas(run, ROWS)
