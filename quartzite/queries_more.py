"""Further queries over the driver's tables, each with SQL written apart from the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rolling
from .operators import masks, ranking, returns
from .plans.lineage import stored
from .queries_panel import _PANEL_SQL, _add, _on_panel, signal_panel
from .plans.staged import duck
from .sources import panels

_K = ["symbol", "td"]

# Returns ------------------------------------------------------------------------------------------

_BARS = duck(panels.weekly_sql("check"))


def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly bars with a quoted previous close and an adjustment factor that steps every half year."""
    b = panels.weekly(spark, sf_dir)
    pre = F.max("close").over(rolling.dates(1, -1))
    return b.withColumns({"preclose": pre, "factor": 1 + F.floor(F.col("td") / 26) * 0.05})


_ADJ = f"(select b.*, p.close as preclose, p.td as ptd, p.open as popen, p.vwap as pvwap, 1 + floor(b.td / 26) * 0.05e0 as factor, 1 + floor(p.td / 26) * 0.05e0 as pfactor from {_BARS} b left join {_BARS} p on p.symbol = b.symbol and p.td = b.td - 1)"
_RET = f"(select symbol, td, close / nullif(preclose, 0) - 1 as c2c, open * factor / nullif(popen * pfactor, 0) - 1 as o2o, vwap * factor / nullif(pvwap * pfactor, 0) - 1 as v2v from {_ADJ})"
_add("return_matrix", lambda s, d: returns.with_returns(adjusted_bars(s, d)), _RET, _K, ["c2c", "o2o", "v2v"])


def _index(bars: DataFrame) -> DataFrame:
    return returns.with_returns(bars).groupBy("td").agg(F.avg("c2c").alias("index_return"))


_add("excess_returns", lambda s, d: returns.with_returns(adjusted_bars(s, d), _index(adjusted_bars(s, d))), f"(with r as {_RET}, i as (select td, avg(c2c) as x from r group by td) select symbol, r.td, c2c - x as c2c, o2o - x as o2o, v2v - x as v2v from r join i on i.td = r.td)", _K, ["c2c", "o2o", "v2v"])
_add("forward_compound", lambda s, d: returns.with_returns(adjusted_bars(s, d)).select("symbol", "td", *[returns.compound_ahead("c2c", p, lag).alias(f"r{p}_{lag}") for p, lag in ((1, 0), (5, 0), (5, 1), (10, 1))]),
     f"(with r as {_RET} select a.symbol, a.td, " + ", ".join(f"case when count(case when b.td between a.td + {lag} and a.td + {lag} + {p} - 1 and b.c2c > -1 then 1 end) = {p} then product(case when b.td between a.td + {lag} and a.td + {lag} + {p} - 1 then 1 + b.c2c end) - 1 end as r{p}_{lag}" for p, lag in ((1, 0), (5, 0), (5, 1), (10, 1))) + " from r a join r b on a.symbol = b.symbol and b.td between a.td and a.td + 12 group by a.symbol, a.td)", _K, ["r1_0", "r5_0", "r5_1", "r10_1"])

_HORIZONS = [3, 6, 12, 48]


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.query(spark, sf_dir, f"select * from {panels.bars_sql('spark')}", ["events"]).withColumn("factor", 1 + F.dayofmonth(F.to_date("day")) * 0.01)


def bar_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.bar_returns_ahead(minute_bars(spark, sf_dir), _HORIZONS, 5, 28)


_BAR_RET = f"""(with b as (select *, 1 + day(cast(day as date)) * 0.01e0 as factor, row_number() over (partition by symbol order by day, slot) as n from {panels.bars_sql('check')}),
 t as (select a.symbol, a.day, a.slot, a.n, sum(x.amount) / nullif(sum(x.volume), 0) * max(case when x.n = a.n + 5 then x.factor end) as trade from b a left join b x on x.symbol = a.symbol and x.n between a.n + 1 and a.n + 5 group by a.symbol, a.day, a.slot, a.n),
 e as (select symbol, day, trade as at_close from t where slot = 28)
 select t.symbol, t.day, t.slot, {', '.join(f't{h}.trade / nullif(t.trade, 0) - 1 as ret_{h}' for h in _HORIZONS)}, at_close / nullif(t.trade, 0) - 1 as ret_eod
 from t {' '.join(f'left join t t{h} on t{h}.symbol = t.symbol and t{h}.n = t.n + {h}' for h in _HORIZONS)} left join e on e.symbol = t.symbol and e.day = t.day)"""
_RETS = [f"ret_{h}" for h in _HORIZONS] + ["ret_eod"]
_add("minute_forward_returns", bar_returns, _BAR_RET, ["symbol", "day", "slot"], _RETS)


def _bar_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = minute_bars(spark, sf_dir)
    return b.select("symbol", "day", "slot", ((F.col("buy_amount") - F.col("sell_amount")) / F.nullif(F.col("amount"), F.lit(0.0))).alias("value"))


_BAR_SIG = f"(select symbol, day, slot, (buy_amount - sell_amount) / nullif(amount, 0) as value from {panels.bars_sql('check')})"
_LONG = f"(unpivot {_BAR_RET} on {', '.join(_RETS)} into name horizon value r)"
_GROUPS = f"""(with s as (select *, cast(floor((row_number() over (partition by day, slot order by value, symbol) - 1) * 2 / count(*) over (partition by day, slot)) as int) as grp from {_BAR_SIG} where value is not null),
 l as (select * from (unpivot (select symbol, day, slot, {', '.join(f'coalesce({c}, 1e300) as {c}' for c in _RETS)} from {_BAR_RET}) on {', '.join(_RETS)} into name horizon value r)),
 g as (select l.day, l.slot, horizon, grp, avg(nullif(r, 1e300)) as mean_return from s join l on s.symbol = l.symbol and s.day = l.day and s.slot = l.slot group by all)
 select * from g union all select h.day, h.slot, h.horizon, -1, h.mean_return - l.mean_return from g h join g l on h.day = l.day and h.slot = l.slot and h.horizon = l.horizon and h.grp = 1 and l.grp = 0)"""
_add("intraday_group_returns", lambda s, d: returns.grouped_bar_returns(_bar_signals(s, d), bar_returns(s, d), 2, _RETS), _GROUPS, ["day", "slot", "horizon", "grp"], ["mean_return"])
_add("intraday_group_stats", lambda s, d: returns.group_statistics(returns.grouped_bar_returns(_bar_signals(s, d), bar_returns(s, d), 2, _RETS)), f"(select slot, horizon, grp, avg(mean_return) as mean, stddev_samp(mean_return) as std, avg(mean_return) / nullif(stddev_samp(mean_return), 0) * sqrt(252) as sharpe from {_GROUPS} group by slot, horizon, grp)", ["slot", "horizon", "grp"], ["mean", "std", "sharpe"])
_BAR_IC = f"""(with l as (select day, slot, horizon, value, r from {_BAR_SIG} s join (select * from {_LONG}) l using (symbol, day, slot) where value is not null and r is not null),
 k as (select day, slot, horizon, rank() over (partition by day, slot, horizon order by value) + (count(*) over (partition by day, slot, horizon, value) - 1) / 2e0 as a, rank() over (partition by day, slot, horizon order by r) + (count(*) over (partition by day, slot, horizon, r) - 1) / 2e0 as b from l)
 select day, slot, horizon, case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end as ic from k group by day, slot, horizon)"""
_add("intraday_rank_ic", lambda s, d: returns.bar_rank_ic(_bar_signals(s, d), bar_returns(s, d), _RETS), _BAR_IC, ["day", "slot", "horizon"], ["ic"])
_add("intraday_ic_summary", lambda s, d: returns.ic_summary(returns.bar_rank_ic(_bar_signals(s, d), bar_returns(s, d), _RETS), ["slot", "horizon"]), f"(select slot, horizon, count(ic) as n, avg(ic) as ic_mean, stddev_samp(ic) as ic_std, avg(ic) / nullif(stddev_samp(ic), 0) as ic_ratio from {_BAR_IC} group by slot, horizon)", ["slot", "horizon", "n"], ["ic_mean", "ic_std", "ic_ratio"])


def _decay_panel(s: SparkSession, d: str) -> DataFrame:
    return signal_panel(s, d).withColumn("ret", F.lag("fwd").over(rolling.W.Window.partitionBy("symbol").orderBy("td")))


def _decay_sql(h: int) -> str:
    frame = f"over (partition by symbol order by td range between 1 following and {h} following)"
    made = f"(select symbol, td, signal, case when count(case when ret > -1 then 1 end) {frame} = {h} then exp(sum(case when ret > -1 then ln(1 + ret) end) {frame}) - 1 end as fwd from (select *, lag(fwd) over (partition by symbol order by td) as ret from {_PANEL_SQL}))"
    ranks = f"(select td, rank() over (partition by td order by signal) + (count(*) over (partition by td, signal) - 1) / 2e0 as a, rank() over (partition by td order by fwd) + (count(*) over (partition by td, fwd) - 1) / 2e0 as b from {made} where signal is not null and fwd is not null and td % {h} = 0)"
    return f"select {h} as horizon, count(ic) as dates, avg(ic) as ic, avg(ic) / nullif(stddev_pop(ic), 0) as ir from (select td, case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end as ic from {ranks} group by td)"


_add("ic_decay", lambda s, d: returns.ic_decay(_decay_panel(s, d), "ret", [1, 2, 5]), "(" + " union all ".join(_decay_sql(h) for h in (1, 2, 5)) + ")", ["horizon", "dates"], ["ic", "ir"])

# Masks --------------------------------------------------------------------------------------------

_LIMITS = "(select symbol, td, close, volume, amount, turnover, trades, max(close) over (partition by symbol order by td rows between 3 preceding and current row) as up, min(close) over (partition by symbol order by td rows between 3 preceding and current row) as down, row_number() over (partition by symbol order by td) as age from " + _BARS + ")"


def _limits(s: SparkSession, d: str) -> DataFrame:
    w = rolling.W.Window.partitionBy("symbol").orderBy("td").rowsBetween(-3, 0)
    return panels.weekly(s, d).select("symbol", "td", "close", "volume", "amount", "turnover", "trades", F.max("close").over(w).alias("up"), F.min("close").over(w).alias("down"), masks.age().alias("age"))


_add("limit_status", lambda s, d: _limits(s, d).select("symbol", "td", masks.limit_status(F.col("close"), F.col("up"), F.col("down")).alias("status"), masks.inside_limits(F.col("close"), F.col("up"), F.col("down")).alias("inside")), f"(select symbol, td, cast(case when close is null then null when close >= up - 1e-4 then 1 when close <= down + 1e-4 then -1 else 0 end as int) as status, cast(case when close <> up and close <> down then 1 end as int) as inside from {_LIMITS})", [*_K, "status", "inside"], [])


def _names(s: SparkSession, d: str) -> DataFrame:
    """Names of suppliers as intervals of weeks: from each part type's first shipment to its last, seven weeks at most, named by the type; open for one supplier in seven."""
    li = panels.table(s, d, "lineitem").where("l_shipdate >= timestamp '1995-01-01 00:00:00'").join(panels.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    week = "cast(floor(datediff(l_shipdate, timestamp '1995-01-01 00:00:00') / 7) as int)"
    iv = li.groupBy(F.col("l_suppkey").cast("int").alias("symbol"), F.col("p_type").alias("name")).agg(F.expr(f"min({week})").alias("start"), F.expr(f"max({week})").alias("end"))
    return iv.withColumn("end", F.when(F.col("symbol") % 7 != 0, F.least(F.col("end"), F.col("start") + 6)))


_SPECIAL = f"""(with iv as (select cast(l_suppkey as int) as symbol, p_type as name, min(cast(floor(datediff('day', timestamp '1995-01-01 00:00:00', l_shipdate) / 7) as int)) as f, max(cast(floor(datediff('day', timestamp '1995-01-01 00:00:00', l_shipdate) / 7) as int)) as t
   from lineitem join part on l_partkey = p_partkey where l_shipdate >= timestamp '1995-01-01 00:00:00' group by 1, 2)
 select symbol, td, exists (select 1 from iv where iv.symbol = b.symbol and regexp_matches(iv.name, 'ST|\\*|退') and b.td >= f and (iv.symbol % 7 = 0 or b.td <= least(t, f + 6))) as special from {_BARS} b)"""
_add("special_treatment", lambda s, d: masks.under_names(panels.weekly(s, d).select("symbol", "td"), _names(s, d)), _SPECIAL, [*_K, "special"], [])


def _tradable(s: SparkSession, d: str) -> DataFrame:
    b = masks.under_names(_limits(s, d), _names(s, d))
    status = F.when(F.col("trades") > 1, F.lit("open")).when(F.col("turnover") > 0.02, F.lit("")).otherwise(F.lit("halted"))
    return b.select("symbol", "td", cs_tradable(b, status))


def cs_tradable(b: DataFrame, status) -> object:  # noqa: ANN001
    from .operators.cross_section import tradable

    return tradable(F.col("up"), F.col("down"), F.col("close"), masks.suspended(status, "halted"), F.col("special"), F.col("age"), 10).alias("tradable")


_add("tradability", _tradable, f"(select b.symbol, b.td, coalesce(close < up and close > down, false) and trades > 1 and not special and age >= 10 as tradable from {_LIMITS} b join {_SPECIAL} x on x.symbol = b.symbol and x.td = b.td)", [*_K, "tradable"], [])
_add("valuation_sanity", lambda s, d: panels.table(s, d, "customer").select("c_custkey", masks.sane_value(F.col("c_acctbal") / 50, 150.0).alias("pe"), masks.sane_value(F.col("c_acctbal") / 200, 30.0).alias("pb")), "(select c_custkey, case when c_acctbal > 0 and c_acctbal / 50 <= 150 then c_acctbal / 50 end as pe, case when c_acctbal > 0 and c_acctbal / 200 <= 30 then c_acctbal / 200 end as pb from customer)", ["c_custkey"], ["pe", "pb"])
_add("session_filter", lambda s, d: panels.table(s, d, "events").where(masks.in_session(F.col("ts"))).select("event_id", masks.trading_minute(F.col("ts")).alias("minute")),
     "(select event_id, cast(case when t < time '11:30:00' then date_diff('minute', time '09:30:00', date_trunc('minute', ts)::time) when hour(ts) = 11 then 119 when t < time '15:00:00' then date_diff('minute', time '13:00:00', date_trunc('minute', ts)::time) + 120 else 239 end as int) as minute from (select *, cast(ts as time) as t from events) where t between time '09:30:00' and time '11:30:00.999' and (t <= time '11:30:00' or t < time '11:30:01') or t between time '13:00:00' and time '15:00:00.999')", ["event_id", "minute"], [])
_add("guarded_bars", lambda s, d: masks.guarded(_limits(s, d), {"prices above 0": F.col("close") > 0, "a band in order": F.col("up") >= F.col("down")}), f"(select symbol, td, close from {_LIMITS})", _K, ["close"])

# Windows --------------------------------------------------------------------------------------------

_W = "over (partition by symbol order by td range between {0} preceding and current row)"
_on_panel("rolling_trend", lambda p: p.select("symbol", "td", rolling.trend("close", 60, 5).alias("v")), f"(select symbol, td, case when count(close) {_W.format(59)} >= 5 then regr_slope(close, td) {_W.format(59)} end as v from {{p}})", _K, ["v"])


def _market(p: DataFrame) -> DataFrame:
    w = rolling.W.Window.partitionBy("symbol").orderBy("td")
    p = p.withColumn("ret", F.lag("fwd").over(w))
    return p.withColumn("market", F.avg("ret").over(rolling.W.Window.partitionBy("td")))


_MKT = "(select *, avg(ret) over (partition by td) as market from (select *, lag(fwd) over (partition by symbol order by td) as ret from {p}))"
_on_panel("market_residual", lambda p: rolling.with_market_residual(_market(p), "ret", "market", 60, "v", 20), f"(with m as {_MKT} select symbol, td, case when count(ret + market) {_W.format(59)} >= 20 then ret - regr_intercept(ret, market) {_W.format(59)} - regr_slope(ret, market) {_W.format(59)} * market end as v from m)", _K, ["v"])
_NEAR = "(with m as (select symbol, td, close from {p}), q as (select a.symbol, a.td, b.close as x, a.td - b.td as age, row_number() over (partition by a.symbol, a.td order by b.td desc) - 1 as k from m a join m b on a.symbol = b.symbol and b.td <= a.td and b.td > a.td - 400) "
_on_panel("linear_decay", lambda p: p.select("symbol", "td", rolling.decay_mean("close", 10).alias("v")), _NEAR + "select symbol, td, sum((10 - age) * x) / nullif(sum(10 - age), 0) as v from q where age < 10 group by symbol, td)", _K, ["v"])
_GAPS = "case when volume > 150 then close end"  # some rows have no value
_on_panel("ewm_mean", lambda p: rolling.with_smoothed(stored(rolling.with_smoothed(stored(p.select("symbol", "td", F.expr(_GAPS).alias("x"))), "x", 5, "adjusted")), "x", 5, "plain", False),  # each reads its rows twice
          """(with recursive m as (select symbol, td, case when volume > 150 then close end as x, row_number() over (partition by symbol order by td) as n from {p}),
 r(symbol, td, n, plain, top, weight, kept) as (select symbol, td, n, x, coalesce(x, 0), case when x is null then 0e0 else 1e0 end, case when x is not null then 1e0 end from m where n = 1
  union all select m.symbol, m.td, m.n, case when m.x is null then r.plain when r.plain is null then m.x else (r.kept * 2 / 3 * r.plain + m.x / 3) / (r.kept * 2 / 3 + 1e0 / 3) end, r.top * 2 / 3 + coalesce(m.x, 0), r.weight * 2 / 3 + case when m.x is null then 0e0 else 1e0 end, case when m.x is null then r.kept * 2 / 3 else 1e0 end
  from m join r on m.symbol = r.symbol and m.n = r.n + 1) select symbol, td, top / nullif(weight, 0) as adjusted, plain from r)""", _K, ["adjusted", "plain"])
_on_panel("ewm_skew", lambda p: p.withColumn("x", F.expr(_GAPS)).select("symbol", "td", rolling.weighted_skew("x", 10, 30, 8).alias("v")),
          """(with m as (select symbol, td, case when volume > 150 then close end as x, row_number() over (partition by symbol order by td) as n from {p}), q as (select a.symbol, a.td, b.x, power(0.5e0, (a.n - b.n) / 10e0) as wt from m a join m b on b.symbol = a.symbol and b.n between a.n - 29 and a.n and b.x is not null where a.n >= 30),
 mm as (select symbol, td, sum(wt * x) / sum(wt) as mu from q group by symbol, td), c as (select q.symbol, q.td, count(*) as n, sum(wt * power(x - mu, 2)) / sum(wt) as m2, sum(wt * power(x - mu, 3)) / sum(wt) as m3 from q join mm on mm.symbol = q.symbol and mm.td = q.td group by q.symbol, q.td)
 select m.symbol, m.td, case when c.n >= 8 and m2 > 1e-14 then m3 / power(m2, 1.5e0) end as v from m left join c on c.symbol = m.symbol and c.td = m.td)""", _K, ["v"])
_on_panel("event_decay", lambda p: p.withColumn("x", F.when(F.col("volume") > 150, F.col("close"))).select("symbol", "td", rolling.filled("x", 6).alias("held"), rolling.decayed("x", 3, 8).alias("decayed")),
          "(with m as (select symbol, td, case when volume > 150 then close end as x from {p}) select a.symbol, a.td, max(case when a.td - b.td <= 6 then b.x end) as held, max(b.x * power(0.5e0, (a.td - b.td) / 3e0)) as decayed from m a left join m b on a.symbol = b.symbol and b.x is not null and b.td = (select max(c.td) from m c where c.symbol = a.symbol and c.td between a.td - 8 and a.td and c.x is not null) group by a.symbol, a.td)", _K, ["held", "decayed"])
_on_panel("forward_mean", lambda p: p.select("symbol", "td", rolling.ahead_mean("close", 5, 3).alias("v")), "(select symbol, td, case when count(close) over w >= 3 then avg(close) over w end as v from {p} window w as (partition by symbol order by td range between current row and 4 following))", _K, ["v"])
_on_panel("consecutive_runs", rolling.with_runs, "(select symbol, td, dense_rank() over (partition by symbol order by g) as run, row_number() over (partition by symbol, g order by td) as in_run from (select *, td - row_number() over (partition by symbol order by td) as g from {p}))", [*_K, "run", "in_run"], [])

# Ranking ------------------------------------------------------------------------------------------

_on_panel("top_first_groups", lambda p: p.where("signal is not null").select("symbol", "td", ranking.top_first_groups(F.col("signal"), 10).alias("grp")), "(select symbol, td, cast(case when m = 1 then 1 else greatest(1, ceil((r - 1) * 10e0 / (m - 1) - 1e-9)) end as int) as grp from (select *, row_number() over (partition by td order by signal desc, symbol) as r, count(*) over (partition by td) as m from {p} where signal is not null))", [*_K, "grp"], [])
_on_panel("tied_groups", lambda p: p.withColumn("q", F.round("signal", 1)).select("symbol", "td", ranking.tied_groups(F.col("q"), 5).alias("grp")).where("grp is not null"), "(with s as (select symbol, td, round(signal, 1) as q from {p} where signal is not null), r as (select a.symbol, a.td, (count(case when b.q < a.q then 1 end) + (count(case when b.q = a.q then 1 end) + 1) / 2e0) / count(*) as pct from s a join s b on a.td = b.td group by a.symbol, a.td) select symbol, td, cast(least(5, greatest(1, ceil(pct * 5 - 1e-9))) as int) as grp from r)", [*_K, "grp"], [])
_on_panel("fraction_masks", lambda p: p.select("symbol", "td", ranking.fraction_mask(F.col("signal"), 0.2).alias("top"), ranking.fraction_mask(F.col("signal"), 0.2, False).alias("bottom"), ranking.fraction_mask(F.col("signal"), 0.2, True, "average", False).alias("open_top")),
          "(with s as (select *, count(signal) over (partition by td) as n, row_number() over (partition by td order by signal nulls last, symbol) as f, rank() over (partition by td order by signal nulls last) + (count(*) over (partition by td, signal) - 1) / 2e0 as a from {p}) select symbol, td, case when signal is not null then cast(f / n::double >= 1 - 0.2e0 as int) end as top, case when signal is not null then cast(f / n::double <= 0.2e0 as int) end as bottom, case when signal is not null then cast(a / n > 1 - 0.2e0 as int) end as open_top from s)", [*_K, "top", "bottom", "open_top"], [])
_on_panel("extremes", lambda p: ranking.extremes(p, "signal", 3), "(select symbol, td, signal as value, 'top' as side from (select *, row_number() over (partition by td order by signal desc, symbol) as r from {p} where signal is not null) where r <= 3 union all select symbol, td, signal, 'bottom' from (select *, row_number() over (partition by td order by signal, symbol) as r from {p} where signal is not null) where r <= 3)", [*_K, "side"], ["value"])
_add("cumulative_volume_cut", lambda s, d: ranking.until_volume(minute_bars(s, d).withColumn("score", F.abs(F.col("close") - F.col("open")) / F.sqrt("volume")), "score", "volume", ["symbol", "day"], 0.2).select("symbol", "day", "slot", "score"),
     f"(with b as (select *, abs(close - open) / sqrt(volume) as score from {panels.bars_sql('check')}), r as (select *, sum(volume) over (partition by symbol, day order by score desc, volume desc, slot) as upto, sum(volume) over (partition by symbol, day) as whole from b) select symbol, day, slot, score from r where upto - volume < 0.2e0 * whole)", ["symbol", "day", "slot"], ["score"])
_on_panel("sampled_panel", lambda p: ranking.sampled_symbols(ranking.sampled_dates(p, 4), 5, "s:").select("symbol", "td", "close"), "(select symbol, td, close from {p} where td % 4 = 0 and symbol in (select symbol from (select distinct symbol from {p} where td % 4 = 0) order by sha256('s:' || symbol), symbol limit 5))", _K, ["close"])
_on_panel("set_agreement", lambda p: ranking.set_agreement(ranking.extremes(p, "signal", 5).where("side = 'top'"), "td", "symbol"), "(with t as (select td, symbol from (select *, row_number() over (partition by td order by signal desc, symbol) as r from {p} where signal is not null) where r <= 5) select a.td as a, b.td as b, count(*) as common, count(*) / ((select count(*) from t where td = a.td) + (select count(*) from t where td = b.td) - count(*))::double as jaccard from t a join t b on a.symbol = b.symbol and a.td < b.td group by a.td, b.td)", ["a", "b", "common"], ["jaccard"])
