"""Queries of cuts, events, order lives, tensors, texts, graphs and selection, each with SQL written apart from the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rolling, tensor
from .functions.windows import shift
from .operators import cutting, events, graphs, selection, text_scores
from .queries_panel import _PANEL_SQL, _add, _on_panel, industry_panel
from .queries_more import _BARS, minute_bars
from .plans.staged import staged
from .sources import panels

_K = ["symbol", "td"]

# Cuts ---------------------------------------------------------------------------------------------


def _with_ret(p: DataFrame) -> DataFrame:
    return p.withColumn("ret", F.lag("fwd").over(rolling.W.Window.partitionBy("symbol").orderBy("td")))


_RETP = "(select *, lag(fwd) over (partition by symbol order by td) as ret from {p})"
_POOL = f"(with m as (select symbol, td, ret, volume from {_RETP}), q as (select a.symbol, a.td, b.ret as o, count(*) over (partition by a.symbol, a.td) as n, row_number() over (partition by a.symbol, a.td order by b.volume, b.td) as r from m a join m b on a.symbol = b.symbol and b.td between a.td - 19 and a.td and b.ret is not null and b.volume is not null) "
for _how, _fold in (("sum", "sum({0})"), ("mean", "avg({0})"), ("compound", "product(1 + {0}) - 1")):
    _hi, _lo = _fold.format("case when r > n - 6 then o end"), _fold.format("case when r <= 6 then o end")
    _on_panel(f"rank_split_{_how}", lambda p, h=_how: cutting.rank_split(_with_ret(p), "ret", "volume", 20, 6, 6, h, False), _POOL + f", g as (select symbol, td, {_hi} as high_leg, {_lo} as low_leg from q where n >= 12 group by symbol, td) select m.symbol, m.td, high_leg, low_leg, high_leg - low_leg as cut from m left join g on g.symbol = m.symbol and g.td = m.td)", _K, ["high_leg", "low_leg", "cut"])
_on_panel("rank_split_full", lambda p: cutting.rank_split(p, "close", "volume", 8, 3, 3, "mean"), "(with q as (select a.symbol, a.td, b.close as o, count(*) over (partition by a.symbol, a.td) as n, row_number() over (partition by a.symbol, a.td order by b.volume, b.td) as r from {p} a join {p} b on a.symbol = b.symbol and b.td between a.td - 7 and a.td) select symbol, td, case when max(n) = 8 then avg(case when r > n - 3 then o end) end as high_leg, case when max(n) = 8 then avg(case when r <= 3 then o end) end as low_leg, case when max(n) = 8 then avg(case when r > n - 3 then o end) - avg(case when r <= 3 then o end) end as cut from q group by symbol, td)", _K, ["high_leg", "low_leg", "cut"])
_on_panel("quantile_split", lambda p: cutting.quantile_split(_with_ret(p), "ret", "volume", 20, 0.25, 10), _POOL + ", k as (select *, case when 2 * greatest(1, floor(n * 0.25)) > n then greatest(1, n // 2) else greatest(1, floor(n * 0.25)) end as k from q), g as (select symbol, td, avg(case when r > n - k then o end) as high_leg, avg(case when r <= k then o end) as low_leg from k where n >= 10 group by symbol, td) select m.symbol, m.td, high_leg, low_leg, high_leg - low_leg as cut from m left join g on g.symbol = m.symbol and g.td = m.td)", _K, ["high_leg", "low_leg", "cut"])
_KNIVES = list(cutting.KNIVES)
_on_panel("knives", lambda p: _with_ret(p).select("symbol", "td", *[cutting.KNIVES[k]().alias(f"k_{k}") for k in _KNIVES]), f"(select symbol, td, amount / nullif(trades, 0) as k_ats_trade_count, amount / nullif(volume, 0) as k_ats_volume, amount as k_amount, volume as k_volume, trades as k_trade_count, turnover as k_turnover, abs(ret) / nullif(amount, 0) as k_amihud, abs(ret) as k_abs_return from {_RETP})", _K, [f"k_{k}" for k in _KNIVES])
_on_panel("knife_table", lambda p: cutting.knife_table(p, "volume", "fwd", 5), "(select cast(floor((r - 1) * 5 / n) as int) + 1 as bin, count(*) as rows, avg(fwd) as mean from (select *, row_number() over (partition by td order by volume, symbol) as r, count(*) over (partition by td) as n from {p} where volume is not null and fwd is not null) group by 1)", ["bin", "rows"], ["mean"])


def _day_bars(s: SparkSession, d: str) -> DataFrame:
    order = rolling.W.Window.partitionBy("symbol", "day").orderBy("slot")
    return minute_bars(s, d).withColumn("ret", F.col("close") / F.lag("close").over(order) - 1)


_DB = f"(select *, close / lag(close) over (partition by symbol, day order by slot) - 1 as ret from {panels.bars_sql('check')})"
_DAY = ["symbol", "day"]


def _masked(s: SparkSession, d: str) -> DataFrame:
    b = _day_bars(s, d)
    return b.withColumns({
        "high": cutting.high_state("amount", _DAY), "low": cutting.high_state("amount", _DAY, False), "up": F.coalesce(F.col("ret") > 0, F.lit(False)), "down": F.coalesce(F.col("ret") < 0, F.lit(False)),
        "top": cutting.top_event("volume", _DAY), "bottom": cutting.top_event("volume", _DAY, top=False), "extreme": cutting.extreme_event("ret", _DAY), "am": F.col("slot") < 23, "pm": F.col("slot") >= 26,
    })


_MASKS = ["high", "low", "up", "down", "top", "bottom", "extreme", "am", "pm"]
_MASKED = f"""(with b as {_DB}, q as (select symbol, day, quantile_cont(amount, 0.5) as med, quantile_cont(volume, 0.8) as q8, quantile_cont(volume, 0.2) as q2, avg(ret) as mu, stddev_samp(ret) as sd, count(ret) as n from b group by symbol, day)
 select b.* exclude (high, low), amount > med as high, amount <= med as low, coalesce(ret > 0, false) as up, coalesce(ret < 0, false) as down, volume >= q8 as top, volume <= q2 as bottom, coalesce(n >= 3 and sd > 1e-12 and abs(ret - mu) > 2 * sd, false) as extreme, slot < 23 as am, slot >= 26 as pm from b join q on q.symbol = b.symbol and q.day = b.day)"""
_add("cut_masks", _masked, _MASKED, ["symbol", "day", "slot", *_MASKS], [])
_AGGS = ["mean", "sum", "std", "median", "last", "max", "min", "slope", "event_share", "centre", "dispersion"]
_AGG_SQL = ", ".join(f"""avg(ret) filter ({m}) as {m}_mean, sum(ret) filter ({m}) as {m}_sum, stddev_samp(ret) filter ({m}) as {m}_std, quantile_cont(ret, 0.5) filter ({m}) as {m}_median, arg_max(ret, slot) filter ({m} and ret is not null) as {m}_last, max(ret) filter ({m}) as {m}_max, min(ret) filter ({m}) as {m}_min,
 case when count(distinct case when {m} and ret is not null then slot end) > 1 then regr_slope(ret, slot) filter ({m}) end as {m}_slope, avg(case when {m} then 1e0 else 0e0 end) as {m}_event_share, sum(slot * abs(ret)) filter ({m}) / nullif(sum(abs(ret)) filter ({m}), 0) as {m}_centre,
 case when sum(slot * slot * abs(ret)) filter ({m}) / nullif(sum(abs(ret)) filter ({m}), 0) - power(sum(slot * abs(ret)) filter ({m}) / nullif(sum(abs(ret)) filter ({m}), 0), 2) > 1e-9 * (1 + power(sum(slot * abs(ret)) filter ({m}) / nullif(sum(abs(ret)) filter ({m}), 0), 2)) then sqrt(sum(slot * slot * abs(ret)) filter ({m}) / nullif(sum(abs(ret)) filter ({m}), 0) - power(sum(slot * abs(ret)) filter ({m}) / nullif(sum(abs(ret)) filter ({m}), 0), 2)) when sum(slot * slot * abs(ret)) filter ({m}) / nullif(sum(abs(ret)) filter ({m}), 0) - power(sum(slot * abs(ret)) filter ({m}) / nullif(sum(abs(ret)) filter ({m}), 0), 2) is not null then 0e0 end as {m}_dispersion""" for m in ("high", "low"))
_add("cut_aggregates", lambda s, d: _masked(s, d).groupBy(*_DAY).agg(*[c for m in ("high", "low") for c in events.by_name(cutting.aggregates("ret", "slot", F.col(m)), f"{m}_")]), f"(select symbol, day, {_AGG_SQL} from {_MASKED} group by symbol, day)", _DAY, [f"{m}_{a}" for m in ("high", "low") for a in _AGGS])
_CON = ["diff", "ratio", "normalised_diff", "acceleration", "reversal"]
_add("cut_contrasts", lambda s, d: _masked(s, d).groupBy(*_DAY).agg(F.sum(F.when(F.col("am"), F.col("ret"))).alias("a"), F.sum(F.when(F.col("pm"), F.col("ret"))).alias("b")).select(*_DAY, *events.by_name(cutting.contrasts("a", "b"), "c_")),
     f"(select symbol, day, a - b as c_diff, case when abs(b) > 1e-12 then a / (abs(b) + 1e-12) end as c_ratio, case when abs(a) + abs(b) > 1e-12 then (a - b) / (abs(a) + abs(b) + 1e-12) end as c_normalised_diff, b - a as c_acceleration, case when a <> 0 then -sign(a) * b end as c_reversal from (select symbol, day, sum(ret) filter (am) as a, sum(ret) filter (pm) as b from {_MASKED} group by symbol, day))", _DAY, [f"c_{c}" for c in _CON])
_on_panel("relative_to_median", lambda p: p.select("symbol", "td", cutting.relative_to_median("volume", ["td"]).alias("v")), "(select symbol, x.td, volume / nullif(abs(m), 0) as v from {p} x join (select td, quantile_cont(volume, 0.5) as m from {p} group by td) q on q.td = x.td)", _K, ["v"])


def _numbered(s: SparkSession, d: str) -> DataFrame:
    return minute_bars(s, d).withColumn("td", F.dayofmonth(F.to_date("day")))


_SMART = f"""(with b as (select *, day(cast(day as date)) as td from {panels.bars_sql('check')}), s as (select *, abs(close / nullif(lag(close) over (partition by symbol, td order by slot), 0) - 1) / sqrt(volume) as score from b),
 p as (select x.symbol, x.td as pool, s.* exclude (symbol) from (select distinct symbol, td from b) x join s on s.symbol = x.symbol and s.td between x.td - 4 and x.td where s.volume > 0 and s.amount > 0 and score is not null),
 r as (select *, coalesce(sum(volume) over (partition by symbol, pool order by score desc, volume desc, td, slot rows between unbounded preceding and 1 preceding), 0) as before, sum(volume) over (partition by symbol, pool) as whole from p)
 select symbol, pool as td, case when count(*) >= 20 then (sum(amount) filter (before < 0.2e0 * whole) / sum(volume) filter (before < 0.2e0 * whole)) / (sum(amount) / sum(volume)) end as q from r group by symbol, pool)"""
_add("smart_money", lambda s, d: cutting.smart_money(_numbered(s, d), 5, 0.2, 20), _SMART, _K, ["q"])

# Disclosures and order lives ------------------------------------------------------------------------


def reports(s: SparkSession, d: str) -> DataFrame:
    """Quarterly reports of customers: the sum of their orders of a quarter, known 30 days after its last order."""
    o = panels.table(s, d, "orders")
    return o.groupBy((F.col("o_custkey") % 100).alias("symbol"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("period")).agg(F.date_add(F.to_date(F.max("o_orderdate")), 30).alias("known"), F.round(F.sum("o_totalprice") / 1000, 3).alias("value"))


_REP = "(select o_custkey % 100 as symbol, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 as period, cast(max(cast(o_orderdate as date)) + 30 as date) as known, round(sum(o_totalprice) / 1000, 3) as value from orders group by 1, 2)"
_SUR = f"""(with c as (select a.symbol, a.period, a.known, a.value - b.value as change, b.value as old from {_REP} a join {_REP} b on a.symbol = b.symbol and b.period = a.period - 4),
 n as (select *, row_number() over (partition by symbol order by known, period) as i from c),
 h as (select x.symbol, x.period, any_value(x.known) as known, any_value(x.change) as change, any_value(x.old) as old, count(y.change) as past, stddev_samp(case when y.i >= x.i - 8 then y.change end) as sd from n x left join n y on y.symbol = x.symbol and y.i < x.i group by x.symbol, x.period)
 select symbol, period, cast(known as varchar) as known, change / case when past >= 4 and sd >= 1e-6 then sd else greatest(abs(old), 1) end as surprise from h)"""
_add("earnings_surprise", lambda s, d: events.surprise_of_changes(reports(s, d)).withColumn("known", F.col("known").cast("string")), _SUR, ["symbol", "period", "known"], ["surprise"])


def estimates(s: SparkSession, d: str) -> DataFrame:
    o = panels.table(s, d, "orders")
    return o.select((F.col("o_custkey") % 100).alias("symbol"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1 + F.col("o_orderkey") % 2).cast("int").alias("period"), F.to_date("o_orderdate").alias("at"), F.round(F.col("o_totalprice") / 300, 3).alias("estimate"))


_EST = "(select o_custkey % 100 as symbol, cast(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 + o_orderkey % 2 as int) as period, cast(o_orderdate as date) as at, round(o_totalprice / 300, 3) as estimate from orders)"
_add("consensus_surprise", lambda s, d: events.consensus_surprise(reports(s, d), estimates(s, d)).withColumn("known", F.col("known").cast("string")),
     f"(select symbol, period, cast(known as varchar) as known, (value - estimate) / abs(estimate) as surprise from (select r.*, estimate, row_number() over (partition by r.symbol, r.period order by e.at desc, estimate desc) as n from {_REP} r join {_EST} e on e.symbol = r.symbol and e.period = r.period and e.at < r.known) where n = 1 and abs(estimate) >= 1e-6)", ["symbol", "period", "known"], ["surprise"])
_add("trailing_year", lambda s, d: events.trailing_year(reports(s, d)).select("symbol", "period", "ttm"), f"(select a.symbol, a.period, case when count(*) = 4 then sum(b.value) end as ttm from {_REP} a join {_REP} b on a.symbol = b.symbol and b.period between a.period - 3 and a.period group by a.symbol, a.period)", ["symbol", "period"], ["ttm"])


def _value_panel(s: SparkSession, d: str) -> DataFrame:
    p = panels.weekly(s, d).select("symbol", "td", "close", "volume", F.expr("date_add(date'1995-01-01', td * 7)").alias("date"))
    return events.as_known(p, events.trailing_year(reports(s, d)).where("ttm is not null").withColumn("symbol", F.col("symbol").cast("int")), "date", "known", ["ttm", "period"]).select("symbol", "td", "period", (F.col("ttm") / F.nullif(F.col("close") * F.col("volume"), F.lit(0.0))).alias("value_ep"))


_add("value_as_known", _value_panel, f"""(with t as (select a.symbol, a.period, any_value(a.known) as known, sum(b.value) as ttm from {_REP} a join {_REP} b on a.symbol = b.symbol and b.period between a.period - 3 and a.period group by a.symbol, a.period having count(*) = 4),
 j as (select b.symbol, b.td, close, volume, t.period, ttm, row_number() over (partition by b.symbol, b.td order by t.known desc, t.period desc) as n from {_BARS} b left join t on t.symbol = b.symbol and t.known <= date '1995-01-01' + b.td * 7)
 select symbol, td, period, ttm / nullif(close * volume, 0) as value_ep from j where n = 1)""", ["symbol", "td", "period"], ["value_ep"])


def ticks(s: SparkSession, d: str) -> DataFrame:
    """events as additions and deletions of orders: an order is a user's hour."""
    e = panels.table(s, d, "events")
    return e.select((F.col("user_id") % 20).alias("symbol"), (F.col("user_id") * 10000 + F.dayofmonth("ts") * 100 + F.hour("ts")).alias("order_no"), F.when(F.col("user_id") % 2 == 0, "B").otherwise("S").alias("side"), F.when(F.col("event_id") % 3 > 0, "A").otherwise("D").alias("kind"), F.col("ts").alias("at"), (1 + F.col("event_id") % 7).alias("qty"))


_LIFE = """(with t as (select user_id % 20 as symbol, user_id * 10000 + day(ts) * 100 + hour(ts) as order_no, event_id % 3 > 0 as a, ts, 1 + event_id % 7 as qty from events),
 l as (select symbol, order_no, min(ts) filter (a) as added, arg_min(qty, (ts, qty)) filter (a) as size, min(ts) filter (not a) as gone, sum(qty) filter (not a) as cancelled, count(*) filter (not a) as cancels from t group by symbol, order_no having count(*) filter (a) > 0),
 g as (select *, case when cancels > 0 then cast(floor(epoch(gone)) - floor(epoch(added)) as bigint) end as age from l), r as (select *, row_number() over (partition by symbol order by age nulls last, order_no) as i, count(age) over (partition by symbol) as n from g)
 select symbol, count(*) as orders, count(*) filter (cancels > 0) as cancelled_orders, count(*) filter (cancels > 0 and cancelled < size) as partly_filled, max(age) filter (i = least(floor(n * 0.25) + 1, n)) as age_p25, max(age) filter (i = least(floor(n * 0.5) + 1, n)) as age_median, max(age) filter (i = least(floor(n * 0.75) + 1, n)) as age_p75, count(*) filter (age < 0) as negative from r group by symbol)"""
_add("order_lifetimes", lambda s, d: events.lifetime_summary(events.order_lives(ticks(s, d))), _LIFE, ["symbol"], ["orders", "cancelled_orders", "partly_filled", "age_p25", "age_median", "age_p75", "negative"])
_add("directional_refill", lambda s, d: events.refill(minute_bars(s, d), 3), f"(with b as (select *, sum(buy_amount) over (partition by symbol, day order by slot rows between 1 following and 3 following) as nx, avg(sell_amount) over (partition by symbol, day) as mu from {panels.bars_sql('check')}) select symbol, day, sum(case when sell_amount > mu then coalesce(nx, 0) end) / nullif(sum(case when sell_amount > mu then sell_amount end), 0) as refill from b group by symbol, day)", _DAY, ["refill"])

# Tensors ------------------------------------------------------------------------------------------

_TC = ["close", "volume"]


def _tensor_sql(d: int, stride: int) -> str:
    per = ", ".join(f"avg({c}) as mean_{c}, stddev_pop({c}) as std_{c}, sum({c}) as sum_{c}, max({c}) as max_{c}, min({c}) as min_{c}, case when stddev_pop({c}) >= 1e-8 then (max(case when j = {d} then {c} end) - avg({c})) / stddev_pop({c}) else 0 end as zscore_{c}, coalesce(max(case when j = {d} then {c} end) / nullif(max(case when j = 1 then {c} end), 0) - 1, 0) as return_{c}, sum(j * {c}) / {d * (d + 1) / 2} as decay_{c}" for c in _TC)
    return f"""(with r as (select symbol, td, close, volume, td - row_number() over (partition by symbol order by td) as g from {_BARS}), n as (select *, row_number() over (partition by symbol, g order by td) as i from r),
     w as (select e.symbol, e.td, x.close, x.volume, x.i - e.i + {d} as j from n e join n x on x.symbol = e.symbol and x.g = e.g and x.i between e.i - {d - 1} and e.i where e.i >= {d} and (e.i - {d}) % {stride} = 0)
     select symbol, td, {per}, covar_pop(close, volume) as cov_close_volume, case when stddev_pop(close) >= 1e-8 and stddev_pop(volume) >= 1e-8 then corr(close, volume) else 0 end as corr_close_volume from w group by symbol, td)"""


_TV = [f"{o}_{c}" for c in _TC for o in ("mean", "std", "sum", "max", "min", "zscore", "return", "decay")] + ["cov_close_volume", "corr_close_volume"]
_add("tensor_features", lambda s, d: tensor.features(panels.weekly(s, d), _TC, 10, 5), _tensor_sql(10, 5), _K, _TV)
_add("tensor_pools", lambda s, d: tensor.pooled(tensor.features(panels.weekly(s, d), _TC, 10, 5), ["mean_close", "std_volume"], 3), f"(select symbol, td, avg(mean_close) over w as poolmean_mean_close, max(mean_close) over w as poolmax_mean_close, min(mean_close) over w as poolmin_mean_close, avg(std_volume) over w as poolmean_std_volume, max(std_volume) over w as poolmax_std_volume, min(std_volume) over w as poolmin_std_volume from {_tensor_sql(10, 5)} window w as (partition by symbol order by td rows between 2 preceding and current row))", _K, [f"pool{a}_{c}" for c in ("mean_close", "std_volume") for a in ("mean", "max", "min")])

# Texts, graphs, selection -------------------------------------------------------------------------

#: A small lexicon for tests of the scorer (fixed values).
MOOD = {"good": 1.0, "great": 2.0, "bad": -1.0, "loss": -1.5, "hope": 0.5, "fear": -1.0, "true": 0.5, "false": -0.5}
NOT, VERY = ["not ", "no "], {"very ": 2.0, "so ": 1.5}


def lexicon_mood(s: SparkSession, d: str) -> DataFrame:
    docs = panels.table(s, d, "documents").select("doc_id", "source", "n_chars", "text")
    return text_scores.with_scores(docs, "text", "score", MOOD, NOT, VERY)


_add("lexicon_scores", lambda s, d: lexicon_mood(s, d).select("doc_id", "score"), None, ["doc_id"], ["score"])
_add("daily_mood", lambda s, d: text_scores.daily_mood(panels.table(s, d, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), ((F.col("value") - 50) / 50).alias("score"), (1 + F.col("event_id") % 5).alias("w")), "score", "w", ["event_type", "day"]),
     "(select event_type, day, count(*) as texts, sum(case when score < 0 then 1.5 * score else score end * w) / nullif(sum(w), 0) - 0.2 * avg(case when score < 0 then 1e0 else 0e0 end) as mood from (select event_type, cast(cast(ts as date) as varchar) as day, (value - 50) / 50 as score, 1 + event_id % 5 as w from events) group by event_type, day)", ["event_type", "day", "texts"], ["mood"])


def _returns(s: SparkSession, d: str) -> DataFrame:
    """symbol, td, ret: of the panel only the close, whose lines go to their symbols once."""
    return _with_ret(staged(panels.weekly_by_symbol(s, d, ["close"]), [{"close_next": shift("close", -1)}, {"fwd": "close_next / nullif(close, 0) - 1"}])).select("symbol", "td", "ret")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return graphs.return_correlations(_returns(s, d), "ret", 20)


_PAIRS = f"(with m as (select symbol, td, ret from {_RETP.replace('{p}', _PANEL_SQL)} where ret is not null) select a.symbol as src, b.symbol as dst, count(*) as n, corr(a.ret, b.ret) as w from m a join m b on a.td = b.td and a.symbol < b.symbol group by 1, 2 having count(*) >= 20)"
_add("correlation_graph", _pairs, _PAIRS, ["src", "dst", "n"], ["w"])
_add("top_neighbours", lambda s, d: graphs.heaviest_correlations(_returns(s, d), "ret", 20, 3), f"(select src, dst, w from (select *, row_number() over (partition by src order by w desc, dst) as r from {_PAIRS}) where r <= 3)", ["src", "dst"], ["w"])
_TRADE = "(select s_nationkey as src, n_nationkey as dst, count(*)::double as w from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2)"


def _trade(s: SparkSession, d: str) -> DataFrame:
    t = {n: panels.table(s, d, n) for n in ("lineitem", "supplier", "orders", "customer")}
    met = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return met.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))


_add("symmetric_graph", lambda s, d: graphs.symmetric(_trade(s, d)), f"(with e as {_TRADE}, b as (select src, dst, max(w) as w from (select src, dst, w from e union all select dst, src, w from e) group by src, dst) select src, dst, w / sqrt(sum(w) over (partition by src) * sum(w) over (partition by dst)) as w from b)", ["src", "dst"], ["w"])
_add("page_rank", lambda s, d: graphs.page_rank(_trade(s, d), rounds=12), f"""(with recursive e as {_TRADE}, sh as (select src, dst, w / sum(w) over (partition by src) as share from e), nodes as (select src as node from e union select dst from e), c as (select count(*) as n from nodes),
 m as (select a.node as src, b.node as dst, coalesce(share, case when a.node in (select src from e) then 0 else 1.0 / n end) as p from nodes a cross join nodes b cross join c left join sh on sh.src = a.node and sh.dst = b.node),
 r(k, node, rank) as (select 0, node, 1e0 / n from nodes, c union all (select k + 1, dst, 0.15e0 / any_value(n) + 0.85e0 * sum(rank * p) from r join m on m.src = r.node cross join c where k < 12 group by k, dst))
 select node, rank from r where k = 12)""", ["node"], ["rank"])
_FEATS = ["signal", "volume", "size", "log_amount"]
_LF = "(" + " union all ".join(f"select '{f}' as feature, cast({f} as double) as x, fwd as y from {{p}} where {f} is not null and fwd is not null" for f in _FEATS) + ")"
_on_panel("mutual_information", lambda p: selection.mutual_information(p, _FEATS, "fwd", 8), f"(with b as (select feature, floor((rank() over (partition by feature order by x) - 1) * 8 / count(*) over (partition by feature)) as i, floor((rank() over (partition by feature order by y) - 1) * 8 / count(*) over (partition by feature)) as j from {_LF}), c as (select feature, i, j, count(*)::double as n from b group by all), t as (select *, sum(n) over (partition by feature) as t, sum(n) over (partition by feature, i) as a, sum(n) over (partition by feature, j) as b from c) select feature, sum(n / t * ln(n * t / (a * b))) as mi from t group by feature)", ["feature"], ["mi"])
_F = f"(select feature, n, r2 / (1 - r2) * (n - 2) as f, n - 2 as v from (select feature, count(*) as n, power(corr(x, y), 2) as r2 from {_LF} group by feature))"
# Twice the tail of Student's t by Simpson's rule over the angle: the density is cos(angle)**(v - 1) over its whole integral.
_P = f"""(with a as (select *, atan(sqrt(f / v)) as low, least(pi() / 2 - atan(sqrt(f / v)), 14 / sqrt(v)) / 4000 as h from {_F})
 select feature, max(n) as n, max(f) as f, sum(case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end * case when cos(low + i * h) > 0 then exp((v - 1) * ln(cos(low + i * h))) else 0 end) * max(h) / 3 * 2 * exp(max(lgamma((v + 1) / 2e0) - lgamma(v / 2e0))) / sqrt(pi()) as p from a, range(0, 4001) as t(i) group by feature)"""
_on_panel("association_tests", lambda p: selection.association(p, _FEATS, "fwd"), _P, ["feature", "n"], ["f", "p"])
_on_panel("false_discovery", lambda p: selection.false_discovery(selection.association(p, _FEATS, "fwd"), 0.05).select("feature", "q", "chosen"), f"(with r as (select *, row_number() over (order by p, feature) as i, count(*) over () as m from {_P}) select a.feature, least(1, min(b.p * b.m / b.i)) as q, least(1, min(b.p * b.m / b.i)) <= 0.05 as chosen from r a join r b on b.i >= a.i group by a.feature)", ["feature", "chosen"], ["q"])
_COR = [(a, b) for i, a in enumerate(_FEATS) for b in _FEATS[i + 1 :]]
_on_panel("factor_correlations", lambda p: selection.correlations(p, _FEATS), "(" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from {{p}}" for a, b in _COR) + ")", ["a", "b"], ["r"])
_RK = "(select td, " + ", ".join(f"rank() over (partition by td order by {f}) + (count(*) over (partition by td, {f}) - 1) / 2e0 as {f}" for f in _FEATS) + " from {p} where " + " and ".join(f"{f} is not null" for f in _FEATS) + ")"
_on_panel("factor_rank_correlations", lambda p: selection.correlations(p, _FEATS, "td"), "(" + " union all ".join(f"select '{a}' as a, '{b}' as b, avg(r) as r from (select case when stddev_pop({a}) > 0 and stddev_pop({b}) > 0 then corr({a}, {b}) end as r from {_RK} group by td)" for a, b in _COR) + ")", ["a", "b"], ["r"])
