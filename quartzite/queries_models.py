"""Queries of linear models over walk-forward folds, with SQL written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import linear_models as lm
from .queries_panel import _IP, _add, industry_panel

FEATURES = ["signal", "log_amount", "size"]
_ALPHA, _L1_ALPHA, _L1 = 1.0, 0.004, 0.5


def panel_folds(panel: DataFrame) -> DataFrame:
    """Test periods of four weeks; a label looks five weeks ahead; a year of training."""
    dates = panel.select("td").distinct().select("td", (F.col("td") + 5).alias("label_end"), F.floor(F.col("td") / 4).cast("int").alias("period"))
    return lm.checked_folds(lm.folds(dates, 52, 20, 6))


def fold_models(s: SparkSession, d: str, l1_ratio: float | None = None) -> DataFrame:
    panel = industry_panel(s, d)
    alpha = _ALPHA if l1_ratio is None else _L1_ALPHA
    done = lm.fitted(panel, FEATURES, "fwd", "td", panel_folds(panel), alpha, l1_ratio)
    return done.select("period", "n", "intercept", *[F.col("coefficients")[j].alias(f"w_{f}") for j, f in enumerate(FEATURES)])


def fold_predictions(s: SparkSession, d: str) -> DataFrame:
    panel = industry_panel(s, d)
    made = panel_folds(panel)
    models = lm.fitted(panel, FEATURES, "fwd", "td", made, _ALPHA)
    return lm.predicted(panel, FEATURES, models, made, "td")


_FOLDS = f"""(with d as (select distinct td, cast(floor(td / 4) as int) as period from {_IP}), a as (select period, max(td) as anchor from d group by period),
 e as (select a.period, a.anchor, max(d.td) as train_to from a left join d on d.td + 5 < a.anchor group by a.period, a.anchor),
 f as (select e.period, e.anchor, e.train_to, min(d.td) as train_from, count(d.td) as n from e left join d on d.td between e.train_to - 52 and e.train_to group by e.period, e.anchor, e.train_to)
 select period, anchor, train_from, train_to, n as dates, train_to + 5 as label_end, case when train_to is null then 'NO_PURGED_DATES' when n < 20 or train_from > train_to - 46 then 'INSUFFICIENT_HISTORY' else 'OK' end as status from f)"""
_add("walk_forward_folds", lambda s, d: panel_folds(industry_panel(s, d)), _FOLDS, ["period", "anchor", "train_from", "train_to", "dates", "label_end", "status"], [])

_SUMS = f"""(with u as (select td, signal as a, log_amount as b, size as c, fwd as y from {_IP} where signal is not null and log_amount is not null and size is not null and fwd is not null)
 select period, count(*) as n, avg(a) as ma, avg(b) as mb, avg(c) as mc, avg(y) as my, var_pop(a) as aa, var_pop(b) as bb, var_pop(c) as cc, covar_pop(a, b) as ab, covar_pop(a, c) as ac, covar_pop(b, c) as bc, covar_pop(a, y) as ay, covar_pop(b, y) as by_, covar_pop(c, y) as cy
 from {_FOLDS} f join u on u.td between f.train_from and f.train_to where status = 'OK' group by period)"""
_RIDGE = f"""(with s as (select *, aa + {_ALPHA}::double / n as p, bb + {_ALPHA}::double / n as q, cc + {_ALPHA}::double / n as r from {_SUMS}),
 w as (select *, p * (q * r - bc * bc) - ab * (ab * r - bc * ac) + ac * (ab * bc - q * ac) as det from s),
 x as (select *, (ay * (q * r - bc * bc) - ab * (by_ * r - bc * cy) + ac * (by_ * bc - q * cy)) / det as w_signal, (p * (by_ * r - bc * cy) - ay * (ab * r - bc * ac) + ac * (ab * cy - by_ * ac)) / det as w_log_amount,
  (p * (q * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - q * ac)) / det as w_size from w)
 select *, my - w_signal * ma - w_log_amount * mb - w_size * mc as intercept from x)"""
_COEFFICIENTS = ["intercept", "w_signal", "w_log_amount", "w_size"]
_add("walk_forward_ridge", fold_models, _RIDGE, ["period", "n"], _COEFFICIENTS)


def _step(pull: str, size: str) -> str:
    l1, l2 = _L1_ALPHA * _L1, _L1_ALPHA * (1 - _L1)
    return f"sign({pull}) * greatest(abs({pull}) - {l1!r}::double, 0) / ({size} + {l2!r}::double)"


_NET = f"""(with recursive s as {_SUMS}, r(period, it, u, v, w) as (select period, 0, 0e0, 0e0, 0e0 from s union all
 select period, it + 1, u2, v2, {_step('(cy - ac * u2 - bc * v2)', 'cc')} from (select *, {_step('(by_ - ab * u2 - bc * w)', 'bb')} as v2 from (select r.period, it, w, v, s.* exclude (period), {_step('(ay - ab * v - ac * w)', 'aa')} as u2 from r join s on s.period = r.period where it < 120)))
 select s.period, n, u as w_signal, v as w_log_amount, w as w_size, my - u * ma - v * mb - w * mc as intercept from s join r on r.period = s.period where it = 120)"""
_add("walk_forward_elastic_net", lambda s, d: fold_models(s, d, _L1), _NET, ["period", "n"], _COEFFICIENTS)
_PREDICTED = f"""(with p as {_IP}, f as (select period, anchor, status, lead(anchor) over (order by anchor) as until from {_FOLDS}), m as {_RIDGE}
 select p.symbol, p.td, f.period, m.intercept + w_signal * signal + w_log_amount * log_amount + w_size * size as prediction from p join f on p.td >= f.anchor and (until is null or p.td < until) join m on m.period = f.period where status = 'OK')"""
_add("walk_forward_predictions", fold_predictions, _PREDICTED, ["symbol", "td", "period"], ["prediction"])
