"""Rolling-origin folds of every forecasting model and detector, one Arrow-packed series at a time."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.kernels import forecast as fc
from tidewell.operators.scoring import GRAIN_SETTINGS

FOLDS = "series string, model string, horizon int, origin int, target int, actual double, predicted double, threshold double, outbreak int, probability double, quantiles array<double>"


def packed(spine: DataFrame, keys: list[str]) -> DataFrame:
    """(series, values, present): one row per series of a regular spine, its name the joined keys; as long as the calendar."""
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    listed = spine.groupBy(name.alias("series")).agg(F.array_sort(F.collect_list(F.struct("period_start", "forward_filled", "present"))).alias("s"))
    return listed.select("series", F.transform("s", lambda x: x["forward_filled"].cast("double")).alias("values"), F.transform("s", lambda x: x["present"]).alias("present"))


def spread(series: DataFrame) -> DataFrame:
    """Packed series over all cores: they are small rows with long work, which the optimiser would put into one task."""
    context = series.sparkSession.sparkContext
    return series.repartition(max(context.defaultParallelism, int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * 2, "series")


def chosen_origins(n: int, horizon: int, least: int, most: int) -> list[int]:
    """Training lengths, thinned evenly with half-to-even rounding."""
    count = n - horizon - least + 1
    if count <= 0:
        return []
    if count <= most:
        return list(range(least, least + count))
    return sorted({least + round(i * (count - 1) / (most - 1)) for i in range(most)})


def outbreak_limit(train: np.ndarray, target: int, season: int) -> float:
    """Mean + 2 deviations of the target's phase in training if there are three values of it, else their 90th percentile."""
    same = train[np.arange(len(train)) % season == target % season]
    return float(same.mean() + 2 * same.std()) if len(same) >= 3 else float(np.quantile(train, 0.9))


def folds_of(name: str, values: np.ndarray, present: np.ndarray, grain: str, models: list[str]) -> list[tuple]:
    season, least, horizons, most = GRAIN_SETTINGS[grain]
    out = []
    zero_rate = float((values == 0).mean())
    for horizon in horizons:
        rest: dict[str, list[tuple[int, float]]] = {m: [] for m in models}
        for origin in chosen_origins(len(values), horizon, least, most):
            target = origin + horizon - 1
            if not present[target]:
                continue
            train, actual = values[:origin], float(values[target])
            limit = outbreak_limit(train, target, season)
            outbreak = int(actual > limit)
            alarms = {d: f(train, season) for d, f in fc.DETECTORS.items() if d in models}
            for model in models:
                if model in fc.INTERMITTENT and zero_rate < 0.2:
                    continue
                kind = "seasonal_naive" if model in fc.DETECTORS else model
                predicted = float(fc.MODELS[kind](train, horizon, season)[horizon - 1])
                # only errors known by the origin
                known = np.array([e for at, e in rest[model] if at < origin])
                if len(known) >= 5:
                    spread = np.quantile(known, [0.1, 0.25, 0.5, 0.75, 0.9])
                    probability = float(np.clip((predicted + known > limit).mean(), 1e-9, 1 - 1e-9))
                else:
                    lag = season if len(train) > season else 1
                    steps = train[lag:] - train[:-lag]
                    sigma = max(float(steps.std()) if len(steps) > 1 else 0.0, float(np.sqrt(max(train.mean(), 0) + 1)), 1.0)
                    spread = sigma * np.array([-1.2815515655, -0.6744897502, 0.0, 0.6744897502, 1.2815515655])
                    probability = 1 - fc.tail((limit - predicted) / sigma)
                rest[model].append((target, actual - predicted))
                out.append((name, model, horizon, origin, target, actual, predicted, limit, outbreak, alarms.get(model, probability), np.sort(np.maximum(predicted + spread, 0)).tolist()))
    return out


def rolling_folds(series: DataFrame, grain: str = "month", models: list[str] | None = None) -> DataFrame:
    """Folds of all (or the named) models and detectors for packed series.

    Training ends before the origin, targets must be present, and predictive distributions use only errors
    known by the origin. Models for intermittent series run where a fifth of the values is zero. Detectors keep
    the seasonal naive forecast and give their own probability. Series shorter than the grain's minimum give no rows.
    """
    names = [*(models or [*fc.MODELS, *fc.DETECTORS])]
    columns = [c.split()[0] for c in FOLDS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                values = np.nan_to_num(np.asarray(row.values, float))
                yield pd.DataFrame(folds_of(row.series, values, np.asarray(row.present, bool), grain, names), columns=columns)

    return spread(series).mapInPandas(run, FOLDS)


def bootstrap_skill(errors: DataFrame, repeats: int = 400) -> DataFrame:
    """Skill of a model against a baseline with a circular block-bootstrap interval, per series and horizon.

    ``errors`` has (series, horizon, origin, model_error, baseline_error); folds per group are bounded by the origins of the grain.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin")
        a, b = pdf["model_error"].to_numpy(float), pdf["baseline_error"].to_numpy(float)
        name, horizon, n = pdf["series"].iloc[0], int(pdf["horizon"].iloc[0]), len(pdf)
        rng = random.Random(int(hashlib.sha256(f"{name}|{horizon}".encode()).hexdigest()[:8], 16))
        width = max(1, round(n ** (1 / 3)))
        skills = []
        for _ in range(repeats):
            at = np.concatenate([(rng.randrange(n) + np.arange(width)) % n for _ in range(-(-n // width))])[:n]
            skills.append(1 - a[at].mean() / max(b[at].mean(), 1e-9))
        low, high = np.quantile(skills, [0.025, 0.975])
        return pd.DataFrame([(name, horizon, n, 1 - a.mean() / max(b.mean(), 1e-9), float(low), float(high))], columns=["series", "horizon", "folds", "skill", "low", "high"])

    return errors.groupBy("series", "horizon").applyInPandas(run, "series string, horizon int, folds int, skill double, low double, high double")


def pooled_ridge(spine: DataFrame, keys: list[str], lags: tuple[int, ...] = (1, 2, 3, 12), penalty: float = 0.1) -> DataFrame:
    """One-step forecasts of all series by one ridge regression on lags of log values, fitted anew for each cutoff.

    A forecast for a period is fitted on the targets of all series before that period. Targets enter as sums of products per
    period, added up over time, so the fit of a cutoff needs one row of lags x lags numbers and not the rows before it.
    Periods with fewer than 30 earlier targets and series without all lags give none.
    """
    month = F.year("period_start") * 12 + F.month("period_start")
    order = Window.partitionBy(*keys).orderBy(month)
    x = F.log1p(F.col("forward_filled").cast("double"))
    made = spine.select(*keys, "period_start", "present", F.col("value").cast("double").alias("actual"), x.alias("y"), *[F.max(x).over(order.rangeBetween(-k, -k)).alias(f"x{k}") for k in lags])
    whole = made.where(" and ".join(f"x{k} is not null" for k in lags))
    names = ["one", *[f"x{k}" for k in lags]]
    rows = whole.withColumn("one", F.lit(1.0))
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(F.col(a) * F.col("y")).alias(f"{a}_y") for a in names]
    sums = rows.where("present").groupBy("period_start").agg(*products)
    earlier = Window.orderBy("period_start").rowsBetween(Window.unboundedPreceding, -1)  # one row per calendar period
    columns = [c for c in sums.columns if c != "period_start"]
    before = sums.select("period_start", *[F.sum(c).over(earlier).alias(c) for c in columns]).where("one_one >= 30")
    size = len(names)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                gram, right = np.zeros((size, size)), np.array([row[f"{a}_y"] for a in names])
                for i, a in enumerate(names):
                    for j in range(i, size):
                        gram[i, j] = gram[j, i] = row[f"{a}_{names[j]}"]
                out.append((row["period_start"], np.linalg.solve(gram + penalty * np.diag([1e-9, *np.ones(size - 1)]), right).tolist()))
            yield pd.DataFrame(out, columns=["period_start", "weights"])

    weights = before.mapInPandas(fit, "period_start date, weights array<double>")
    value = sum((F.col("weights")[i] * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    return rows.where("present").join(weights, "period_start").select(*keys, "period_start", "actual", F.greatest(F.expm1(value), F.lit(0.0)).alias("predicted"))


def learning_curves(series: DataFrame, windows: tuple[int, ...] = (12, 24, 36, 60, 120), models: tuple[str, ...] = ("naive", "seasonal_naive", "historical_median", "auto_autoregression", "gradient_boosted_stumps", "negative_binomial_ingarch", "holt_winters_additive"), season: int = 12, origins: int = 12) -> DataFrame:
    """Mean absolute one-step error of each model by the length of its training window, over the last ``origins`` present targets (three or more)."""
    columns = ["series", "model", "window", "origins", "mae"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                y, there = np.nan_to_num(np.asarray(row.values, float)), np.asarray(row.present, bool)
                for width in windows:
                    at = [o for o in range(width, len(y)) if there[o]][-origins:]
                    if len(at) < 3:
                        continue
                    for model in models:
                        errors = [abs(y[o] - float(fc.MODELS[model](y[o - width : o], 1, season)[0])) for o in at]
                        out.append((row.series, model, width, len(at), float(np.mean(errors))))
            yield pd.DataFrame(out, columns=columns)

    return spread(series).mapInPandas(run, "series string, model string, window int, origins int, mae double")
