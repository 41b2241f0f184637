"""Queries of the numeric kernels over the order panels, with SQL twins of the models in closed form; the others are tested in tests/."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import diagnostics as dg
from tidewell.operators import forecasts as fc
from tidewell.operators import panel as p
from tidewell.plans import panels
from tidewell.sources.tables import table


#: Models that SQL can state in one expression; moving averages for one period ahead.
CLOSED = ["naive", "seasonal_naive", "historical_mean", "historical_median", "moving_average", "drift"]


def _packed(s, d):
    return fc.packed(p.month_spine(panels.by_nation(s, d), ["nation"], "cases"), ["nation"])


def _edges(s, d) -> list[tuple[str, str]]:
    names = {r[0]: r[1] for r in table(s, d, "nation").select("n_nationkey", "n_name").collect()}  # 25 rows
    return [(names[k], names[k + 1]) for k in sorted(names) if k + 1 in names]


def _errors(s, d):
    f = fc.rolling_folds(_packed(s, d), models=["seasonal_naive", "ses_optimized"]).withColumn("e", F.abs(F.col("predicted") - F.col("actual")))
    model = f.where("model = 'ses_optimized'").select("series", "horizon", "origin", F.col("e").alias("model_error"))
    return model.join(f.where("model = 'seasonal_naive'").select("series", "horizon", "origin", F.col("e").alias("baseline_error")), ["series", "horizon", "origin"])


def queries() -> dict:
    return {
        "forecast_models": lambda s, d: fc.rolling_folds(_packed(s, d)),
        "closed_form_folds": lambda s, d: fc.rolling_folds(_packed(s, d), models=CLOSED).where("model <> 'moving_average' or horizon = 1").select(
            "series", "model", "horizon", "origin", "target", "actual", *[F.round(c, 6).alias(c) for c in ("predicted", "threshold")], *[F.round(F.col("quantiles")[i], 6).alias(q) for i, q in ((0, "q10"), (2, "q50"), (4, "q90"))]
        ),
        "diagnostic_kernels": lambda s, d: dg.series_diagnostics(_packed(s, d)),
        "panel_kernels": lambda s, d: dg.panel_diagnostics(_packed(s, d).withColumn("panel", F.lit("nations")), "panel", _edges(s, d)),
        "spatial_permutation": lambda s, d: dg.permutation_moran(panels.by_nation(s, d).groupBy("nation", F.year("period_start").cast("string").alias("year")).agg(F.sum("cases").alias("cases")), "year", "nation", "cases", _edges(s, d)),
        "pooled_ridge": lambda s, d: fc.pooled_ridge(p.month_spine(panels.by_segment(s, d), panels.KEYS, "cases"), panels.KEYS),
        "learning_curves": lambda s, d: fc.learning_curves(_packed(s, d)),
        "bootstrap_interval": lambda s, d: fc.bootstrap_skill(_errors(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "closed_form_folds": f"""with {panels._CASES}, sp as (select nation, cast(unnest(generate_series(cast(min(period_start) as timestamp), cast(max(period_start) as timestamp), interval 1 month)) as date) period_start from n group by 1),
q as (select sp.nation, sp.period_start, n.cases actual, last_value(n.cases ignore nulls) over (partition by sp.nation order by sp.period_start) v, row_number() over (partition by sp.nation order by sp.period_start) - 1 t, count(*) over (partition by sp.nation) k from sp left join n using (nation, period_start)),
hs(horizon) as (values (1), (2), (3), (6), (12)), ct as (select nation, horizon, max(k) - horizon - 17 c from q, hs group by nation, horizon having max(k) - horizon - 17 > 0),
o as (select distinct nation, horizon, cast(18 + case when c <= 24 then i else round_even(i * (c - 1) / 23.0, 0) end as integer) origin from ct, range(0, 400) r(i) where case when c <= 24 then i < c else i < 24 end),
f0 as (select o.*, o.origin + o.horizon - 1 target, q.actual from o join q on q.nation = o.nation and q.t = o.origin + o.horizon - 1 where q.actual is not null),
st as (select f.nation, f.horizon, f.origin, f.target, f.actual, avg(v) mean, median(v) med, arg_max(v, t) last, arg_min(v, t) fst, avg(v) filter (t >= origin - 12) ma, max(case when t = target - 12 * (((target - origin) // 12) + 1) then v end) seas,
 count(*) filter (t % 12 = target % 12) same, avg(v) filter (t % 12 = target % 12) sm, stddev_pop(v) filter (t % 12 = target % 12) ss, quantile_cont(v, 0.9) p90 from f0 f join q on q.nation = f.nation and q.t < f.origin group by f.nation, f.horizon, f.origin, f.target, f.actual),
dl as (select nation, t, v - lag(v, 12) over (partition by nation order by t) d from q),
sg as (select st.nation, st.horizon, st.origin, greatest(stddev_pop(d), sqrt(mean + 1), 1.0) sigma from st join dl on dl.nation = st.nation and dl.t < st.origin group by st.nation, st.horizon, st.origin, mean),
f as (select nation, horizon, origin, target, actual, case when same >= 3 then sm + 2 * ss else p90 end as threshold, unnest(['naive', 'seasonal_naive', 'historical_mean', 'historical_median', 'moving_average', 'drift']) as model,
 unnest([last, coalesce(seas, last), mean, med, ma, last + horizon * (last - fst) / (origin - 1)]) predicted0 from st),
fg as (select * exclude (predicted0), greatest(predicted0, 0.0) as predicted from f),
e as (select a.nation, a.model, a.horizon, a.origin, count(b.origin) known, quantile_cont(b.actual - b.predicted, 0.1) e1, quantile_cont(b.actual - b.predicted, 0.5) e5, quantile_cont(b.actual - b.predicted, 0.9) e9
 from fg a left join fg b on b.nation = a.nation and b.model = a.model and b.horizon = a.horizon and b.target < a.origin group by all)
select g.nation as series, g.model, g.horizon, g.origin, g.target, g.actual, round(predicted, 6) as predicted, round(threshold, 6) as threshold, round(greatest(predicted + case when known >= 5 then e1 else -1.2815515655 * sigma end, 0.0), 6) as q10,
 round(greatest(predicted + case when known >= 5 then e5 else 0.0 end, 0.0), 6) as q50, round(greatest(predicted + case when known >= 5 then e9 else 1.2815515655 * sigma end, 0.0), 6) as q90
from fg g join e using (nation, model, horizon, origin) join sg using (nation, horizon, origin) where model <> 'moving_average' or g.horizon = 1""",
    }
