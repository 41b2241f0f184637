"""Queries of the forecast benchmark and the spatial layer over the order panels, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import panel as p
from tidewell.operators import scoring as m
from tidewell.operators import spatial as sp
from tidewell.plans import panels
from tidewell.sources.tables import table

KEYS = ["nation", "segment"]


def _spine(s, d):
    return p.month_spine(panels.by_segment(s, d), KEYS, "cases").select(*KEYS, "period_start", "value", "present", "forward_filled")


def _folds(s, d):
    return m.simple_folds(_spine(s, d), KEYS)


def _metrics(s, d):
    return m.metrics(_folds(s, d), m.scales(_spine(s, d), KEYS), KEYS)


def _edges(s, d):
    """Nations of neighbouring keys."""
    n = table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("a"))
    return n.join(n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("a").alias("b")), "n_nationkey").select("a", "b")


def _yearly(s, d):
    return panels.by_nation(s, d).groupBy("nation", F.year("period_start").alias("year")).agg(F.sum("cases").alias("cases"))


def _alarms(s, d):
    x = m.outbreak_threshold(_spine(s, d), KEYS).where("present and threshold is not null")
    return x.select("nation", (F.col("value") > F.col("threshold")).cast("int").alias("y"), F.least(F.col("value") / (F.col("threshold") + 1), F.lit(1.0)).alias("score"))


def _votes(s, d):
    """The shares of the simple models that foresee each class, next to the class that came."""
    cut = lambda c: F.least(F.floor(F.col(c) / 2), F.lit(2)).cast("int")
    f = _folds(s, d).select("nation", "segment", "horizon", "origin", cut("actual").alias("actual_class"), cut("predicted").alias("c"))
    return f.groupBy("nation", "segment", "horizon", "origin", "actual_class").agg(*[F.avg((F.col("c") == k).cast("double")).alias(f"p{k}") for k in range(3)])


def _classes(s, d):
    f = _folds(s, d).where("horizon = 1 and model = 'naive'")
    return f.select("nation", F.least(F.floor(F.col("actual") / 2), F.lit(2)).cast("int").alias("actual_class"), F.least(F.floor(F.col("predicted") / 2), F.lit(2)).cast("int").alias("predicted_class"))


def _tests(s, d):
    """One p-value-like number per series and year, with ties."""
    return panels.by_segment(s, d).groupBy("segment", "nation", F.year("period_start").alias("year")).agg(F.round(1 / (1 + F.sum("cases")), 6).alias("p_value"))


def _round(df, digits=9):
    for name, kind in df.dtypes:
        if kind == "double":
            df = df.withColumn(name, F.round(name, digits) + 0.0)  # no negative zero
    return df


def queries() -> dict:
    return {
        "origin_sampling": lambda s, d: m.origins(m.numbered(_spine(s, d), KEYS), KEYS),
        "simple_folds": lambda s, d: _round(_folds(s, d)),
        "mase_scale": lambda s, d: _round(m.scales(_spine(s, d), KEYS)),
        "fold_metrics": lambda s, d: _round(_metrics(s, d)),
        "frontier_winner": lambda s, d: _round(m.winners(_round(_metrics(s, d)), KEYS, "mase")),
        "aggregate_quantiles": lambda s, d: _round(m.summarise(_metrics(s, d), ["horizon", "model"], "mase")),
        "median_ensemble": lambda s, d: _round(m.ensembles(_folds(s, d), KEYS)),
        "online_selector": lambda s, d: _round(m.online(_folds(s, d), KEYS), 6),
        "wis_crps": lambda s, d: _round(m.distribution_scores(m.quantile_forecasts(_folds(s, d), KEYS, m.fallback_sigma(_spine(s, d), KEYS)), KEYS)),
        "seasonal_threshold": lambda s, d: _round(m.outbreak_threshold(_spine(s, d), KEYS)),
        "binary_metrics": lambda s, d: _round(m.binary_scores(_alarms(s, d), ["nation"], "y", "score")),
        "risk_metrics": lambda s, d: _round(m.class_scores(_classes(s, d), ["nation"], "actual_class", "predicted_class")),
        "risk_probabilities": lambda s, d: _round(m.probability_scores(_votes(s, d), ["nation", "horizon"], "actual_class", ["p0", "p1", "p2"])),
        "variogram_range": lambda s, d: _round(sp.variogram_range(queries()["semivariogram_bins"](s, d), ["year"])),
        "fdr_bh": lambda s, d: _round(m.false_discovery(_tests(s, d), ["segment"], "p_value")),
        "ears_alarms": lambda s, d: _round(m.ears(panels.by_nation(s, d), ["nation"], "cases"), 6),
        "cusum_alarms": lambda s, d: _round(m.cusum(panels.by_nation(s, d), ["nation"], "cases"), 6),
        "moran_geary": lambda s, d: _round(sp.global_autocorrelation(_yearly(s, d), ["year"], "nation", "cases", sp.weights(_edges(s, d)))),
        "local_moran": lambda s, d: _round(sp.local_moran(_yearly(s, d), ["year"], "nation", "cases", sp.weights(_edges(s, d)))),
        "getis_ord_z": lambda s, d: _round(sp.hot_spots(_yearly(s, d), ["year"], "nation", "cases", _edges(s, d))),
        "semivariogram_bins": lambda s, d: _round(sp.semivariogram(_yearly(s, d).join(table(s, d, "nation").select(F.col("n_name").alias("nation"), "n_nationkey"), "nation"), ["year"], "nation", "cases", F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5))),
        "spearman_pairs": lambda s, d: _round(sp.rank_correlation(panels.by_nation(s, d), "nation", "cases"), 6),
        "hotspot_classes": lambda s, d: _round(sp.hotspot_classes(sp.hot_spots(panels.by_nation(s, d), ["period_start"], "nation", "cases", _edges(s, d)), "nation", "gi_star")),
    }


_T = f"{panels._SPINE}, q as (select nation, segment, period_start, value, pv v, row_number() over (partition by nation, segment order by period_start) - 1 t, count(*) over (partition by nation, segment) n from w)"
_O = f"""{_T}, hs(horizon) as (values (1), (2), (3), (6), (12)), ln as (select nation, segment, max(n) n from q group by all), k as (select nation, segment, horizon, n - horizon - 17 as c from ln, hs where n - horizon - 17 > 0),
o as (select distinct nation, segment, horizon, cast(18 + case when c <= 24 then i else round_even(i * (c - 1) / 23.0, 0) end as integer) as origin from k, range(0, 400) r(i) where case when c <= 24 then i < c else i < 24 end)"""
_F = f"""{_O}, fo as (select o.*, o.origin + o.horizon - 1 as target, a.value as actual, l.v as last from o join q a on a.nation = o.nation and a.segment = o.segment and a.t = o.origin + o.horizon - 1 and a.value is not null
 join q l on l.nation = o.nation and l.segment = o.segment and l.t = o.origin - 1),
tr as (select nation, segment, t, v, avg(v) over (partition by nation, segment order by t rows unbounded preceding) mean, first_value(v) over (partition by nation, segment order by t) fst,
 avg(v) over (partition by nation, segment, t % 12 order by t rows between 4 preceding and current row) win from q),
x as (select fo.*, b.mean, b.fst, s.v seas, s.win from fo join tr b on b.nation = fo.nation and b.segment = fo.segment and b.t = fo.origin - 1
 left join tr s on s.nation = fo.nation and s.segment = fo.segment and s.t = fo.target - 12 * (((fo.target - fo.origin) // 12) + 1)),
folds as (select nation, segment, horizon, origin, target, actual, 'naive' as model, last as predicted from x union all select nation, segment, horizon, origin, target, actual, 'seasonal_naive', coalesce(seas, last) from x
 union all select nation, segment, horizon, origin, target, actual, 'historical_mean', mean from x union all select nation, segment, horizon, origin, target, actual, 'drift', greatest(last + horizon * (last - fst) / (origin - 1), 0.0) from x
 union all select nation, segment, horizon, origin, target, actual, 'seasonal_window', coalesce(win, last) from x)"""
_S = """sc as (select nation, segment, greatest(coalesce(avg(abs(v - v12)), avg(abs(v - v1)), 1.0), 1.0) as scale from (select nation, segment, v, lag(v, 12) over (partition by nation, segment order by t) v12, lag(v, 1) over (partition by nation, segment order by t) v1 from q) group by all)"""
_M = f"""{_F}, {_S}, met as (select nation, segment, horizon, model, count(*) as folds, avg(abs(predicted - actual) / scale) as mase, sqrt(avg((predicted - actual) ** 2)) as rmse,
 avg(case when abs(predicted) + abs(actual) > 0 then 200 * abs(predicted - actual) / (abs(predicted) + abs(actual)) else 0.0 end) as smape, avg(predicted - actual) as bias,
 avg(2 * (case when actual > 0 then actual * ln(actual / greatest(predicted, 1e-9)) else 0.0 end - (actual - greatest(predicted, 1e-9)))) as poisson_deviance from folds join sc using (nation, segment) group by all)"""
_E = f"""{panels._CASES}, y as (select nation, year(period_start) as year, sum(cases) as cases from n group by all),
e as (select a.n_name a, b.n_name b from nation a join nation b on abs(a.n_nationkey - b.n_nationkey) = 1), dg as (select a, 1.0::double / count(*) w from e group by 1), ew as (select e.*, w from e join dg using (a)),
z as (select year, nation, cases, cases - avg(cases) over (partition by year) z, count(*) over (partition by year) n, sum(cases * cases) over (partition by year) - count(*) over (partition by year) * power(avg(cases) over (partition by year), 2) ss from y),
lg as (select a.year, a.nation, a.z, a.ss, a.n, sum(ew.w * b.z) lag, sum(ew.w) ws, sum(ew.w * (a.z - b.z) ** 2) df from z a join ew on ew.a = a.nation join z b on b.nation = ew.b and b.year = a.year group by all)"""


def _gi(group: str, rel: str) -> str:
    return f"""st as (select {group}, avg(cases) m, stddev_pop(cases) s, count(*) n from {rel} group by 1), nb as (select a, b from e union all select distinct nation, nation from {rel}),
sm as (select o.{group}, o.nation, sum(v.cases) x, count(*) k from {rel} o join nb on nb.a = o.nation join {rel} v on v.nation = nb.b and v.{group} = o.{group} group by all),
gi as (select sm.{group}, nation, case when n > 1 and s * sqrt((n * k - k * k) / nullif(n - 1, 0)) > 0 then (x - m * k) / (s * sqrt((n * k - k * k) / nullif(n - 1, 0))) end as gi_star from sm join st using ({group}))"""


def _variogram_sql() -> str:
    return f"""with {_E}, pt as (select year, nation, cases v, n_nationkey % 5 x, n_nationkey // 5 yy from y join nation on n_name = nation), pr as (select a.year, sqrt((a.x - b.x) ** 2 + (a.yy - b.yy) ** 2) h, (a.v - b.v) ** 2 / 2 g from pt a join pt b on a.year = b.year and a.nation < b.nation),
tp as (select year, max(h) top from pr group by 1) select year, cast(least(floor(h / top * 10), 9) as integer) as bin, count(*) as pairs, round(avg(h), 9) as distance, round(avg(g), 9) as semivariance from pr join tp using (year) where top > 0 group by 1, 2"""


def oracle_sql() -> dict[str, str]:
    thr = f"{_T}, th as (select nation, segment, period_start, t, value, value is not null as present, case when count(v) over p >= 3 then avg(v) over p + 2 * stddev_pop(v) over p end as threshold from q window p as (partition by nation, segment, t % 12 order by t rows between unbounded preceding and 1 preceding))"
    return {
        "origin_sampling": f"with {_O} select nation, segment, horizon, origin from o",
        "simple_folds": f"with {_F} select nation, segment, horizon, origin, target, actual, model, round(predicted, 9) as predicted from folds",
        "mase_scale": f"with {_T}, {_S} select nation, segment, round(scale, 9) as scale from sc",
        "fold_metrics": f"with {_M} select nation, segment, horizon, model, folds, round(mase, 9) as mase, round(rmse, 9) as rmse, round(smape, 9) as smape, round(bias, 9) as bias, round(poisson_deviance, 9) as poisson_deviance from met",
        "frontier_winner": f"""with {_M}, r as (select nation, segment, horizon, model, round(mase, 9) v from met), b as (select *, row_number() over (partition by nation, segment, horizon order by v, model) k from r)
select b.nation, b.segment, b.horizon, b.model as winner, b.v as value, s.v as baseline, round(1 - b.v / greatest(s.v, 1e-9), 9) as skill from b left join r s on s.nation = b.nation and s.segment = b.segment and s.horizon = b.horizon and s.model = 'seasonal_naive' where b.k = 1""",
        "aggregate_quantiles": f"with {_M} select horizon, model, count(*) as series, round(avg(mase), 9) as mean, round(quantile_cont(mase, 0.25), 9) as q25, round(quantile_cont(mase, 0.5), 9) as median, round(quantile_cont(mase, 0.75), 9) as q75 from met group by 1, 2",
        "median_ensemble": f"""with {_F}, a as (select nation, segment, horizon, origin, target, actual, median(predicted) md, avg(predicted) mn from folds where model not in ('naive', 'seasonal_naive') group by all)
select nation, segment, horizon, origin, target, actual, 'median_ensemble' as model, round(md, 9) as predicted from a union all select nation, segment, horizon, origin, target, actual, 'trimmed_mean', round(mn, 9) from a""",
        "online_selector": f"""with {_F}, ps as (select c.nation, c.segment, c.horizon, c.origin, c.target, c.actual, c.model, c.predicted, round(avg(abs(h.predicted - h.actual)), 9) past, count(h.origin) known from folds c
 left join folds h on h.nation = c.nation and h.segment = c.segment and h.horizon = c.horizon and h.model = c.model and h.target < c.origin group by all),
bs as (select *, row_number() over (partition by nation, segment, horizon, origin order by known < 2, past, model) k from ps), fb as (select nation, segment, horizon, origin, predicted fall from folds where model = 'seasonal_naive'),
wt as (select nation, segment, horizon, origin, sum(predicted / greatest(past, 0.05)) / sum(1 / greatest(past, 0.05)) wv from ps where known >= 2 group by all)
select bs.nation, bs.segment, bs.horizon, bs.origin, bs.target, bs.actual, case when known >= 2 then model else 'seasonal_naive' end as selected, round(case when known >= 2 then predicted else fall end, 6) as selector, round(coalesce(wv, fall), 6) as weighted
from bs join fb using (nation, segment, horizon, origin) left join wt using (nation, segment, horizon, origin) where k = 1""",
        "wis_crps": f"""with {_F}, dl as (select nation, segment, t, v, v - lag(v, 12) over (partition by nation, segment order by t) s, v - lag(v, 1) over (partition by nation, segment order by t) l from q),
og as (select distinct nation, segment, origin from folds),
sg as (select og.nation, og.segment, og.origin, greatest(coalesce(case when og.origin > 12 then case when count(s) > 1 then stddev_pop(s) end else case when count(l) > 1 then stddev_pop(l) end end, 0.0), sqrt(greatest(avg(v), 0.0) + 1), 1.0) sigma
 from og join dl on dl.nation = og.nation and dl.segment = og.segment and dl.t < og.origin group by og.nation, og.segment, og.origin),
rs as (select c.nation, c.segment, c.horizon, c.model, c.origin, count(h.origin) c, [quantile_cont(h.actual - h.predicted, 0.1), quantile_cont(h.actual - h.predicted, 0.25), quantile_cont(h.actual - h.predicted, 0.5), quantile_cont(h.actual - h.predicted, 0.75), quantile_cont(h.actual - h.predicted, 0.9)] e
 from folds c left join folds h on h.nation = c.nation and h.segment = c.segment and h.horizon = c.horizon and h.model = c.model and h.target < c.origin group by all),
rz as (select rs.* exclude (e), case when c >= 5 then e else [-1.2815515655 * sigma, -0.6744897502 * sigma, 0.0, 0.6744897502 * sigma, 1.2815515655 * sigma] end r from rs join sg using (nation, segment, origin)),
fq as (select f.*, greatest(r[1] + predicted, 0.0) q1, greatest(r[2] + predicted, 0.0) q2, greatest(r[3] + predicted, 0.0) q3, greatest(r[4] + predicted, 0.0) q4, greatest(r[5] + predicted, 0.0) q5 from folds f join rz using (nation, segment, horizon, model, origin)),
w2 as (select *, (0.5::double * abs(actual - q3) + 0.1::double * ((q5 - q1) + case when actual < q1 then (q1 - actual) * 10 else 0.0 end + case when actual > q5 then (actual - q5) * 10 else 0.0 end) + 0.25::double * ((q4 - q2) + case when actual < q2 then (q2 - actual) * 4 else 0.0 end + case when actual > q4 then (actual - q4) * 4 else 0.0 end)) / 0.85::double wi,
 2 * (case when actual >= q1 then (actual - q1) * 0.1 else (q1 - actual) * 0.9 end + case when actual >= q2 then (actual - q2) * 0.25 else (q2 - actual) * 0.75 end + case when actual >= q3 then (actual - q3) * 0.5 else (q3 - actual) * 0.5 end
 + case when actual >= q4 then (actual - q4) * 0.75 else (q4 - actual) * 0.25 end + case when actual >= q5 then (actual - q5) * 0.9 else (q5 - actual) * 0.1 end) / 5 cr from fq)
select nation, segment, horizon, model, round(avg(wi), 9) as wis, round(avg(cr), 9) as crps, round(avg(case when actual between q1 - 1e-9 and q5 + 1e-9 then 1.0 else 0.0 end), 9) as coverage_80 from w2 group by all""",
        "seasonal_threshold": f"with {thr} select nation, segment, period_start, t, value, present, round(threshold, 9) as threshold from th",
        "binary_metrics": f"""with {thr}, al as (select nation, case when value > threshold then 1 else 0 end y, least(value / (threshold + 1), 1.0) score from th where present and threshold is not null),
rk as (select nation, y, score, rank() over (partition by nation order by score) + (count(*) over (partition by nation, score) - 1) / 2.0 r, row_number() over (partition by nation order by score desc, y desc) k, sum(y) over (partition by nation order by score desc, y desc rows unbounded preceding) tp from al),
a as (select nation, sum(y) p, count(*) n, sum(case when y = 1 then r end) rs, sum(case when y = 1 then tp / k end) ap, avg((score - y) ** 2) brier, count(*) filter (score >= 0.5 and y = 1) tp, count(*) filter (score >= 0.5 and y = 0) fp, count(*) filter (score < 0.5 and y = 1) fn, count(*) filter (score < 0.5 and y = 0) tn from rk group by 1)
select nation, round(brier, 9) as brier, tp, fp, fn, tn, round(case when p > 0 and n > p then (rs - p * (p + 1) / 2) / (p * (n - p)) end, 9) as auroc, round(case when p > 0 then ap / p end, 9) as auprc from a""",
        "risk_metrics": f"""with {_F}, cl as (select nation, cast(least(floor(actual / 2), 2) as integer) a, cast(least(floor(predicted / 2), 2) as integer) p from folds where horizon = 1 and model = 'naive')
select nation, round(avg(case when a = p then 1.0 else 0.0 end), 9) as accuracy, round((coalesce(2 * count(*) filter (a = 0 and p = 0) / nullif(count(*) filter (a = 0) + count(*) filter (p = 0), 0), 0) + coalesce(2 * count(*) filter (a = 1 and p = 1) / nullif(count(*) filter (a = 1) + count(*) filter (p = 1), 0), 0)
 + coalesce(2 * count(*) filter (a = 2 and p = 2) / nullif(count(*) filter (a = 2) + count(*) filter (p = 2), 0), 0)) / 3, 9) as macro_f1, round(avg(abs(a - p)), 9) as distance from cl group by 1""",
        "risk_probabilities": f"""with {_F}, vt as (select nation, segment, horizon, origin, cast(least(floor(actual / 2), 2) as integer) a, avg(case when least(floor(predicted / 2), 2) = 0 then 1.0 else 0.0 end) p0,
 avg(case when least(floor(predicted / 2), 2) = 1 then 1.0 else 0.0 end) p1, avg(case when least(floor(predicted / 2), 2) = 2 then 1.0 else 0.0 end) p2 from folds group by nation, segment, horizon, origin, actual),
vp as (select *, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end p from vt), kl as (select unnest([0, 1, 2]) c),
pc as (select nation, horizon, c, count(*) filter (a = c and p = c) tp, count(*) filter (a = c) ac, count(*) filter (p = c) pd from vp, kl group by 1, 2, 3),
mc as (select nation, horizon, avg(tp / greatest(ac, 1)) as balanced_accuracy, avg(2 * (tp / greatest(pd, 1)) * (tp / greatest(ac, 1)) / greatest(tp / greatest(pd, 1) + tp / greatest(ac, 1), 1e-9)) as macro_f1 from pc group by 1, 2),
ov as (select nation, horizon, avg(case when a = p then 1.0 else 0.0 end) as accuracy, avg(abs(a - p)) as ordinal_mae, avg(((p0 - case when a <= 0 then 1 else 0 end) ** 2 + (p0 + p1 - case when a <= 1 then 1 else 0 end) ** 2) / 2) as rps, -avg(ln(greatest(case a when 0 then p0 when 1 then p1 else p2 end, 1e-9))) as ll from vp group by 1, 2)
select nation, horizon, round(accuracy, 9) as accuracy, round(macro_f1, 9) as macro_f1, round(balanced_accuracy, 9) as balanced_accuracy, round(ordinal_mae, 9) as ordinal_mae, round(rps, 9) as ranked_probability_score, round(ll, 9) as multiclass_log_loss from ov join mc using (nation, horizon)""",
        "variogram_range": "with sv as (" + _variogram_sql() + """), t as (select *, max(semivariance) over (partition by year) sill from sv)
select year, round(max(sill), 9) as sill, round(arg_min(distance, bin), 9) as "range" from t where semivariance >= 0.95 * sill group by year""",
        "fdr_bh": f"""with {panels._CASES}, ts as (select segment, nation, year(period_start) as year, round(1 / (1 + sum(cases)), 6) as p_value from g group by 1, 2, 3), r as (select *, count(*) over (partition by segment order by p_value) k, count(*) over (partition by segment) n from ts)
select segment, nation, year, p_value, round(least(greatest(min(p_value * n / k) over (partition by segment order by p_value desc range unbounded preceding), 0.0), 1.0), 9) as q_value from r""",
        "ears_alarms": f"""with {panels._CASES}, a as (select nation, period_start, cases, case when count(*) over c1 = 7 then (cases - avg(cases) over c1) / greatest(stddev_pop(cases) over c1, 0.5) end c1, case when count(*) over c2 = 7 then (cases - avg(cases) over c2) / greatest(stddev_pop(cases) over c2, 0.5) end c2 from n
 window c1 as (partition by nation order by period_start rows between 7 preceding and 1 preceding), c2 as (partition by nation order by period_start rows between 9 preceding and 3 preceding))
select nation, period_start, cases, round(c1, 6) as c1, round(c2, 6) as c2, round(case when c2 is not null then avg(greatest(case when c2 is not null then c2 end, 0.0)) over (partition by nation order by period_start rows between 2 preceding and current row) end, 6) as c3 from a""",
        "cusum_alarms": f"""with {panels._CASES}, r as (select *, row_number() over (partition by nation order by period_start desc) k from n),
b as (select nation, avg(cases) m, greatest(stddev_pop(cases), 0.5) s from r where k > 12 group by 1 having count(*) > 1), t as (select r.nation, sum((cases - m) / s - 0.5) over (partition by r.nation order by k) x from r join b using (nation) where k <= 12)
select nation, round(greatest(max(x), 0.0), 6) as cusum from t group by 1""",  # the last value of the running sum is the largest sum of a tail, or 0
        "moran_geary": f"with {_E} select year, max(n) as places, round(max(n) / sum(ws) * sum(z * lag) / max(ss), 9) as moran_i, round(-1.0::double / nullif(max(n) - 1, 0), 9) as expected_i, round((max(n) - 1) * sum(df) / (2 * sum(ws) * max(ss)), 9) as geary_c from lg group by 1",
        "local_moran": f"with {_E} select year, nation, round(z * lag * (n - 1) / ss, 9) as local_i, case when z > 0 then 'high' else 'low' end || '-' || case when lag > 0 then 'high' else 'low' end as quadrant from lg",
        "getis_ord_z": f"with {_E}, {_gi('year', 'y')} select year, nation, round(gi_star, 9) as gi_star from gi",
        "hotspot_classes": f"""with {_E}, {_gi('period_start', 'n')}, mk as (select *, gi_star > 1.96 hot, gi_star < -1.96 cold, row_number() over (partition by nation order by period_start desc) k from gi),
a as (select nation, avg(case when hot then 1.0 when hot is not null then 0.0 end) hs, avg(case when cold then 1.0 when cold is not null then 0.0 end) cs, bool_or(case when k = 1 then hot end) lh, count(*) filter (hot and k > 1) hb, count(*) filter (hot and k <= 3) hl, least(count(*), 3) rc from mk group by 1),
pr as (select x.nation, sum(sign(y.gi_star - x.gi_star)) rise from gi x join gi y on x.nation = y.nation and x.period_start < y.period_start group by 1), tie as (select nation, sum(t * (t - 1) * (2 * t + 5)) e, sum(t) n from (select nation, gi_star, count(*) t from gi where gi_star is not null group by 1, 2) group by 1),
kt as (select nation, case when n >= 4 then rise / nullif(sqrt((n * (n - 1) * (2 * n + 5) - e) / 18), 0) end tau from pr join tie using (nation))
select nation, round(hs, 9) as hot_share, round(cs, 9) as cold_share, case when hs >= 0.9 then 'persistent' when lh and hb = 0 then 'new' when hl = rc then 'consecutive' when hs >= 0.5 and tau > 1.959963984540054 then 'intensifying' when hs >= 0.5 and tau < -1.959963984540054 then 'diminishing' when hs > 0 then 'sporadic' when cs >= 0.5 then 'coldspot' else 'no_pattern' end as trajectory from a left join kt using (nation)""",
        "semivariogram_bins": _variogram_sql(),
        "spearman_pairs": f"""with {panels._CASES}, r as (select nation, period_start, rank() over (partition by nation order by cases) + (count(*) over (partition by nation, cases) - 1) / 2.0 r from n)
select a.nation as place_a, b.nation as place_b, count(*) as periods, round(covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0), 6) + 0.0 as spearman from r a join r b on a.period_start = b.period_start and a.nation < b.nation group by 1, 2""",
    }
