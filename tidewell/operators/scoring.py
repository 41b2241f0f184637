"""Forecast benchmark in SQL: simple models on a month spine, errors, probabilistic scores, selection and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the benchmark: season, least training length, horizons, most origins, by grain.
GRAIN_SETTINGS = {
    "week": (52, 52, (1, 2, 4, 8, 13), 24),
    "month": (12, 18, (1, 2, 3, 6, 12), 24),
    "year": (1, 5, (1, 2, 3), 10),
}
LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9)


def numbered(spine: DataFrame, keys: list[str]) -> DataFrame:
    """The spine with t from 0 and n, the length of each series."""
    order = Window.partitionBy(*keys).orderBy("period_start")
    return spine.withColumn("t", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def origins(series: DataFrame, keys: list[str], grain: str = "month") -> DataFrame:
    """(keys, horizon, origin): training lengths for each horizon, thinned evenly with half-to-even rounding."""
    _, least, horizons, most = GRAIN_SETTINGS[grain]
    lengths = series.groupBy(*keys).agg(F.max("n").alias("n"))
    each = lengths.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    each = each.withColumn("count", F.col("n") - F.col("horizon") - least + 1).where("count > 0")
    places = F.when(F.col("count") <= most, F.sequence(F.lit(0), F.col("count") - 1)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("count") - 1) / F.lit(most - 1)).cast("int")))
    )
    return each.select(*keys, "horizon", F.explode(places).alias("place")).select(*keys, "horizon", (F.col("place") + least).alias("origin"))


def simple_folds(spine: DataFrame, keys: list[str], grain: str = "month") -> DataFrame:
    """One row per series, horizon, origin and model: naive, seasonal_naive, historical_mean, drift, seasonal_window.

    Training uses the values before the origin, filled forward; targets must be present. All values a fold needs come by
    equality joins on (series, t) and from running windows, so folds do not multiply the training data.
    """
    season = GRAIN_SETTINGS[grain][0]
    base = numbered(spine, keys)
    order = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    phase = Window.partitionBy(*keys, F.col("t") % season).orderBy("t").rowsBetween(-4, 0)
    v = F.col("forward_filled")
    trained = base.select(*keys, "t", v.alias("v"), F.avg(v).over(order).alias("mean"), F.first(v).over(order).alias("first"), F.avg(v).over(phase).alias("window"))
    plan = origins(base, keys, grain)
    target = base.where("present").select(*keys, F.col("t").alias("target"), F.col("value").alias("actual"))
    folds = plan.withColumn("target", F.col("origin") + F.col("horizon") - 1).join(target, [*keys, "target"])
    last = trained.select(*keys, (F.col("t") + 1).alias("origin"), F.col("v").alias("last"), "mean", "first")
    folds = folds.join(last, [*keys, "origin"])
    # the last period of the target's phase before the origin
    back = F.col("target") - season * (F.floor((F.col("target") - F.col("origin")) / season) + 1)
    seasonal = trained.select(*keys, F.col("t").alias("same"), F.col("v").alias("seasonal"), "window")
    folds = folds.withColumn("same", back.cast("int")).join(seasonal, [*keys, "same"], "left")
    drift = F.col("last") + F.col("horizon") * (F.col("last") - F.col("first")) / (F.col("origin") - 1)
    models = {"naive": F.col("last"), "seasonal_naive": F.coalesce("seasonal", "last"), "historical_mean": F.col("mean"), "drift": F.greatest(drift, F.lit(0.0)), "seasonal_window": F.coalesce("window", "last")}
    listed = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.greatest(p, F.lit(0.0)).alias("predicted")) for m, p in models.items()]))
    return folds.select(*keys, "horizon", "origin", "target", "actual", listed.alias("m")).select(*keys, "horizon", "origin", "target", "actual", "m.model", "m.predicted")


def scales(spine: DataFrame, keys: list[str], season: int = 12) -> DataFrame:
    """Mean absolute seasonal difference of each series (of neighbours if it is shorter than a season and one), at least 1."""
    base = numbered(spine, keys)
    order = Window.partitionBy(*keys).orderBy("t")
    v = F.col("forward_filled")
    d = base.select(*keys, F.abs(v - F.lag(v, season).over(order)).alias("s"), F.abs(v - F.lag(v, 1).over(order)).alias("l"))
    return d.groupBy(*keys).agg(F.greatest(F.coalesce(F.avg("s"), F.avg("l"), F.lit(1.0)), F.lit(1.0)).alias("scale"))


def metrics(folds: DataFrame, scale: DataFrame, keys: list[str]) -> DataFrame:
    """MASE, RMSE, sMAPE, bias and Poisson deviance of each series, horizon and model."""
    error = F.col("predicted") - F.col("actual")
    total = F.abs("predicted") + F.abs("actual")
    mu = F.greatest("predicted", F.lit(1e-9))
    deviance = 2 * (F.when(F.col("actual") > 0, F.col("actual") * F.log(F.col("actual") / mu)).otherwise(0.0) - (F.col("actual") - mu))
    return (
        folds.join(scale, keys)
        .groupBy(*keys, "horizon", "model")
        .agg(
            F.count(F.lit(1)).alias("folds"), F.avg(F.abs(error) / F.col("scale")).alias("mase"), F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg(F.when(total > 0, 200 * F.abs(error) / total).otherwise(0.0)).alias("smape"), F.avg(error).alias("bias"), F.avg(deviance).alias("poisson_deviance"),
        )
    )


def ensembles(folds: DataFrame, keys: list[str], trim: float = 0.1) -> DataFrame:
    """Median and trimmed mean of the models at each fold, naive and seasonal naive left out."""
    used = folds.where(~F.col("model").isin("naive", "seasonal_naive"))
    values = F.array_sort(F.collect_list("predicted"))  # one value per model
    at = used.groupBy(*keys, "horizon", "origin", "target", "actual").agg(values.alias("v"), F.median("predicted").alias("median"))
    cut = F.floor(F.size("v") * trim).cast("int")
    kept = F.slice("v", cut + 1, F.size("v") - 2 * cut)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)
    out = F.explode(F.array(F.struct(F.lit("median_ensemble").alias("model"), F.col("median").alias("predicted")), F.struct(F.lit("trimmed_mean").alias("model"), mean.alias("predicted"))))
    return at.select(*keys, "horizon", "origin", "target", "actual", out.alias("m")).select(*keys, "horizon", "origin", "target", "actual", "m.model", "m.predicted")


def online(folds: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """At each fold the model with the least mean past error (seasonal_naive until two errors are known) and the mean weighted by past errors.

    ``strict`` uses only errors whose target lies before the origin; otherwise those of all earlier origins, which for horizons
    beyond one look ahead.
    """
    by = Window.partitionBy(*keys, "horizon", "model")
    error = F.abs(F.col("predicted") - F.col("actual"))
    if strict:
        known = folds.withColumn("e", error)
        past = known.select(*keys, "horizon", "model", F.col("target").alias("at"), "e")
        # errors known by an origin: a running mean over targets, met at the largest target before the origin
        events = past.select(*keys, "horizon", "model", F.col("at").alias("when"), "e", F.lit(None).cast("double").alias("predicted"), F.lit(None).cast("int").alias("origin"), F.lit(None).cast("int").alias("target"), F.lit(None).cast("double").alias("actual")).unionByName(
            known.select(*keys, "horizon", "model", (F.col("origin") - 1).alias("when"), F.lit(None).cast("double").alias("e"), F.col("predicted").cast("double").alias("predicted"), F.col("origin").cast("int").alias("origin"), F.col("target").cast("int").alias("target"), F.col("actual").cast("double").alias("actual"))
        )
        run = by.orderBy("when").rangeBetween(Window.unboundedPreceding, 0)
        marked = events.withColumn("past", F.round(F.avg("e").over(run), 9)).withColumn("known", F.count("e").over(run)).where("origin is not null")
    else:
        run = by.orderBy("origin").rowsBetween(Window.unboundedPreceding, -1)
        marked = folds.withColumn("e", error).withColumn("past", F.round(F.avg("e").over(run), 9)).withColumn("known", F.count("e").over(run))
    ready = F.col("known") >= 2
    at = marked.groupBy(*keys, "horizon", "origin", "target", "actual").agg(
        F.min(F.when(ready, F.struct("past", "model", "predicted"))).alias("best"),
        F.max(F.when(F.col("model") == "seasonal_naive", F.col("predicted"))).alias("fallback"),
        (F.sum(F.when(ready, F.col("predicted") / F.greatest("past", F.lit(0.05)))) / F.sum(F.when(ready, 1 / F.greatest("past", F.lit(0.05))))).alias("weighted"),
    )
    return at.select(*keys, "horizon", "origin", "target", "actual", F.coalesce("best.model", F.lit("seasonal_naive")).alias("selected"), F.coalesce("best.predicted", "fallback").alias("selector"), F.coalesce("weighted", "fallback").alias("weighted"))


#: Multiples of the fallback deviation at LEVELS: quantiles of the normal distribution.
NORMAL = (-1.2815515655, -0.6744897502, 0.0, 0.6744897502, 1.2815515655)


def fallback_sigma(spine: DataFrame, keys: list[str], grain: str = "month") -> DataFrame:
    """(keys, origin, sigma): the deviation of the seasonal differences before each origin (of neighbours up to one season), at least the root of the mean and one, and 1."""
    season = GRAIN_SETTINGS[grain][0]
    base = numbered(spine, keys)
    order = Window.partitionBy(*keys).orderBy("t")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("forward_filled")
    steps = base.select(*keys, "t", v.alias("v"), (v - F.lag(v, season).over(order)).alias("s"), (v - F.lag(v, 1).over(order)).alias("l"))
    # a training set longer than a season has a seasonal difference
    spread = F.when((F.col("t") + 1 > season) & F.lit(season > 1), F.when(F.count("s").over(past) > 1, F.stddev_pop("s").over(past))).otherwise(F.when(F.count("l").over(past) > 1, F.stddev_pop("l").over(past)))
    least = F.sqrt(F.greatest(F.avg("v").over(past), F.lit(0.0)) + 1)
    return steps.select(*keys, (F.col("t") + 1).alias("origin"), F.greatest(F.coalesce(spread, F.lit(0.0)), least, F.lit(1.0)).alias("sigma"))


def quantile_forecasts(folds: DataFrame, keys: list[str], sigma: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Predictive quantiles at LEVELS around the prediction, floored at 0: those of the model's known residuals of its series and horizon.

    Known at an origin are the residuals of folds whose target lies before it; with ``strict`` off, those of all folds of
    earlier origins. With fewer than five the quantiles are normal ones of the deviation in ``sigma`` (see ``fallback_sigma``); without it, such folds are left out.
    """
    by = Window.partitionBy(*keys, "horizon", "model")
    levels = [*LEVELS]
    told = folds.withColumn("r", F.col("actual") - F.col("predicted"))
    if strict:
        none = [F.lit(None).cast(folds.schema[c].dataType).alias(c) for c in folds.columns if c not in (*keys, "horizon", "model")]
        rest = [c for c in folds.columns if c not in (*keys, "horizon", "model")]
        events = told.select(*keys, "horizon", "model", F.col("target").alias("when"), "r", *none).unionByName(
            told.select(*keys, "horizon", "model", (F.col("origin") - 1).alias("when"), F.lit(None).cast("double").alias("r"), *rest)
        )
        known = by.orderBy("when").rangeBetween(Window.unboundedPreceding, 0)
        marked = events.withColumn("q", F.percentile("r", levels).over(known)).withColumn("known", F.count("r").over(known)).where("origin is not null")
    else:
        known = by.orderBy("origin").rowsBetween(Window.unboundedPreceding, -1)
        marked = told.withColumn("q", F.percentile("r", levels).over(known)).withColumn("known", F.count("r").over(known))
    if sigma is None:
        marked = marked.where("known >= 5").withColumn("sigma", F.lit(None).cast("double"))
    else:
        marked = marked.join(sigma, [*keys, "origin"], "left")
    around = F.when(F.col("known") >= 5, F.col("q")).otherwise(F.array(*[F.lit(x) * F.col("sigma") for x in NORMAL]))
    return marked.select(*folds.columns, F.array_sort(F.transform(around, lambda x: F.greatest(x + F.col("predicted"), F.lit(0.0)))).alias("quantiles"))


def pinball(actual: Column, quantile: Column, level: float) -> Column:
    return F.when(actual >= quantile, (actual - quantile) * level).otherwise((quantile - actual) * (1 - level))


def interval_score(actual: Column, low: Column, high: Column, alpha: float) -> Column:
    return (high - low) + F.when(actual < low, (low - actual) * 2 / alpha).otherwise(0.0) + F.when(actual > high, (actual - high) * 2 / alpha).otherwise(0.0)


def distribution_scores(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted interval score, quantile CRPS and 80 % coverage of each series, horizon and model."""
    y, q = F.col("actual"), [F.col("quantiles")[i] for i in range(5)]
    wis = (0.5 * F.abs(y - q[2]) + 0.1 * interval_score(y, q[0], q[4], 0.2) + 0.25 * interval_score(y, q[1], q[3], 0.5)) / 0.85
    crps = 2 * sum((pinball(y, q[i], level) for i, level in enumerate(LEVELS)), F.lit(0.0)) / len(LEVELS)
    return forecasts.groupBy(*keys, "horizon", "model").agg(F.avg(wis).alias("wis"), F.avg(crps).alias("crps"), F.avg(F.when(y.between(q[0] - 1e-9, q[4] + 1e-9), 1.0).otherwise(0.0)).alias("coverage_80"))


def outbreak_threshold(spine: DataFrame, keys: list[str], season: int = 12) -> DataFrame:
    """For each period: mean + 2 population deviations of the same phase before it, if there are three or more of them."""
    base = numbered(spine, keys)
    past = Window.partitionBy(*keys, F.col("t") % season).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("forward_filled")
    limit = F.when(F.count(v).over(past) >= 3, F.avg(v).over(past) + 2 * F.stddev_pop(v).over(past))
    return base.select(*keys, "period_start", "t", "value", "present", limit.alias("threshold"))


def binary_scores(scored: DataFrame, group: list[str], label: str, score: str, cut: float = 0.5) -> DataFrame:
    """AUROC by average ranks, AUPRC with positives first on ties, Brier score, and the confusion counts at ``cut``.

    Ranks come from counts per distinct score, so windows run over scores and not over rows.
    """
    y = F.col(label).cast("int")
    per = scored.groupBy(*group, F.col(score).alias("s")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*group).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*group).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("rank", F.coalesce(F.sum("n").over(up), F.lit(0)) + (F.col("n") + 1) / 2).withColumn("tp", F.coalesce(F.sum("pos").over(down), F.lit(0))).withColumn("seen", F.coalesce(F.sum("n").over(down), F.lit(0)))
    # within a tie the positives come first: precision after the i-th of them is (tp + i) / (seen + i)
    precision = F.when(F.col("pos") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("pos"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + (F.col("tp") + i) / (F.col("seen") + i))).otherwise(0.0)
    totals = ranked.groupBy(*group).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(precision).alias("ap"))
    auroc = F.when((F.col("p") > 0) & (F.col("n") > F.col("p")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))))
    ranks = totals.select(*group, auroc.alias("auroc"), F.when(F.col("p") > 0, F.col("ap") / F.col("p")).alias("auprc"))
    said = F.col(score) >= cut
    counts = scored.groupBy(*group).agg(
        F.avg(F.pow(F.col(score) - y, 2)).alias("brier"), F.count_if(said & (y == 1)).alias("tp"), F.count_if(said & (y == 0)).alias("fp"), F.count_if(~said & (y == 1)).alias("fn"), F.count_if(~said & (y == 0)).alias("tn")
    )
    if not group:
        return counts.join(ranks, F.lit(True))
    return counts.join(ranks, group)


def class_scores(df: DataFrame, group: list[str], actual: str, predicted: str, classes: int = 3) -> DataFrame:
    """Accuracy, macro F1 and mean absolute distance of ordered classes 0..classes-1."""
    a, p = F.col(actual), F.col(predicted)
    sums = [F.count_if((a == k) & (p == k)).alias(f"tp{k}") for k in range(classes)] + [(F.count_if(a == k) + F.count_if(p == k)).alias(f"all{k}") for k in range(classes)]
    out = df.groupBy(*group).agg(F.avg((a == p).cast("double")).alias("accuracy"), F.avg(F.abs(a - p).cast("double")).alias("distance"), *sums)
    f1 = sum((F.when(F.col(f"all{k}") > 0, 2 * F.col(f"tp{k}") / F.col(f"all{k}")).otherwise(0.0) for k in range(classes)), F.lit(0.0)) / classes
    return out.select(*group, "accuracy", f1.alias("macro_f1"), "distance")


def probability_scores(df: DataFrame, group: list[str], actual: str, shares: list[str]) -> DataFrame:
    """Scores of the probabilities ``shares`` of ordered classes 0, 1, ... against the class ``actual``.

    (accuracy, macro_f1, balanced_accuracy, ordinal_mae, ranked_probability_score, multiclass_log_loss): the class of the largest probability (the lowest of several)
    is the predicted one; a class without predictions or cases has F1 and recall 0; probabilities count as 1e-9 at least in the log loss. Rows without a class or a probability are left out.
    """
    k = range(len(shares))
    known = df.where(F.col(actual).isNotNull())
    for c in shares:
        known = known.where(F.col(c).isNotNull())
    a, p = F.col(actual), F.array_position(F.array(*shares), F.greatest(*shares)).cast("int") - 1
    below = [sum((F.col(c) for c in shares[: b + 1]), F.lit(0.0)) for b in k[:-1]]
    rps = sum((F.pow(x - (a <= b).cast("double"), 2) for b, x in enumerate(below)), F.lit(0.0)) / (len(shares) - 1)
    own = F.element_at(F.array(*shares), (a + 1).cast("int"))
    sums = [F.count_if((a == c) & (p == c)).alias(f"tp{c}") for c in k] + [F.count_if((a != c) & (p == c)).alias(f"fp{c}") for c in k] + [F.count_if((a == c) & (p != c)).alias(f"fn{c}") for c in k]
    out = known.groupBy(*group).agg(
        F.avg((a == p).cast("double")).alias("accuracy"), F.avg(F.abs(a - p).cast("double")).alias("ordinal_mae"), F.avg(rps).alias("ranked_probability_score"), (-F.avg(F.log(F.greatest(own, F.lit(1e-9))))).alias("multiclass_log_loss"), *sums
    )
    recall = {c: F.col(f"tp{c}") / F.greatest(F.col(f"tp{c}") + F.col(f"fn{c}"), F.lit(1)) for c in k}
    precision = {c: F.col(f"tp{c}") / F.greatest(F.col(f"tp{c}") + F.col(f"fp{c}"), F.lit(1)) for c in k}
    f1 = sum((2 * precision[c] * recall[c] / F.greatest(precision[c] + recall[c], F.lit(1e-9)) for c in k), F.lit(0.0)) / len(shares)
    return out.select(*group, "accuracy", f1.alias("macro_f1"), (sum(recall.values(), F.lit(0.0)) / len(shares)).alias("balanced_accuracy"), "ordinal_mae", "ranked_probability_score", "multiclass_log_loss")


def winners(measured: DataFrame, keys: list[str], value: str, baseline: str = "seasonal_naive") -> DataFrame:
    """Best model of each series and horizon (the first name on ties), its value, the baseline's, and the skill against it."""
    best = measured.groupBy(*keys, "horizon").agg(F.min(F.struct(F.col(value).alias("v"), "model")).alias("b"), F.max(F.when(F.col("model") == baseline, F.col(value))).alias("baseline"))
    return best.select(*keys, "horizon", F.col("b.model").alias("winner"), F.col("b.v").alias("value"), "baseline", (1 - F.col("b.v") / F.greatest("baseline", F.lit(1e-9))).alias("skill"))


def summarise(measured: DataFrame, group: list[str], value: str) -> DataFrame:
    """Number, mean, median and quartiles (interpolated) of the finite values."""
    finite = measured.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    q = F.percentile(value, [0.25, 0.5, 0.75])
    return finite.groupBy(*group).agg(F.count(F.lit(1)).alias("series"), F.avg(value).alias("mean"), q.alias("q")).select(*group, "series", "mean", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def false_discovery(tests: DataFrame, family: list[str], p_value: str) -> DataFrame:
    """Benjamini-Hochberg q-values within each family; null p-values get none.

    Ranks run over distinct p-values with their counts, so a family is as long as it has distinct values.
    """
    p = F.col(p_value)
    per = tests.where(p.isNotNull()).groupBy(*family, p.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(*family).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.withColumn("rank", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy(*family)))
    down = Window.partitionBy(*family).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.greatest(F.min(F.col("p") * F.col("n") / F.col("rank")).over(down), F.lit(0.0)), F.lit(1.0))
    known = ranked.select(*family, F.col("p").alias(p_value), q.alias("q_value"))
    return tests.join(known, [*family, p_value], "left")


def ears(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """EARS C1, C2 and C3 scores of each period: distance in deviations from the seven periods before (two left out for C2)."""
    order = Window.partitionBy(*keys).orderBy("period_start")

    def score(a: int, b: int) -> Column:
        w = order.rowsBetween(a, b)
        return F.when(F.count(value).over(w) == 7, (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(0.5)))

    out = series.withColumn("c1", score(-7, -1)).withColumn("c2", score(-9, -3))
    return out.withColumn("c3", F.when(F.col("c2").isNotNull(), F.avg(F.greatest(F.col("c2"), F.lit(0.0))).over(order.rowsBetween(-2, 0))))


def cusum(series: DataFrame, keys: list[str], value: str, slack: float = 0.5, last: int = 12) -> DataFrame:
    """One-sided CUSUM of the last periods, standardised by the ones before them; series of bounded length per key."""
    listed = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("period_start", F.col(value).cast("double").alias("v")))).alias("s"))
    values = F.transform("s", lambda x: x["v"])
    base = F.slice(values, F.lit(1), F.greatest(F.size("s") - last, F.lit(0)))
    recent = F.slice(values, F.greatest(F.size("s") - last, F.lit(0)) + 1, F.lit(last))
    with_base = listed.withColumn("base", base).withColumn("recent", recent).where(F.size("base") > 1)
    mean = F.aggregate("base", F.lit(0.0), lambda a, x: a + x) / F.size("base")
    with_mean = with_base.withColumn("mean", mean)
    deviation = F.sqrt(F.aggregate("base", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("base"))
    scored = with_mean.withColumn("deviation", F.greatest(deviation, F.lit(0.5)))
    return scored.select(*keys, F.aggregate("recent", F.lit(0.0), lambda a, x: F.greatest(F.lit(0.0), a + (x - F.col("mean")) / F.col("deviation") - slack)).alias("cusum"))
