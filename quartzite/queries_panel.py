"""Queries over the driver's tables for the panel operators, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import daily_arrays as arrays
from .functions import daily_factors as daily
from .functions import intraday
from .functions import order_book as book
from .functions import order_flow as flow
from .functions.matrices import safe
from .operators import cross_section as cs
from .operators import evaluation as ev
from .operators import joins
from .operators.cross_pass import Pass, average_ranks, crossed, residual, scores
from .operators.rolling_pass import staged_by_symbol
from .operators.symbol_pass import by_date, by_symbol
from .plans.staged import Stage, duck, full_output, output, single, staged, staged_sql
from .sources import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: The same queries and SQL with values in full precision, for tests with a tolerance.
FULL: dict[str, tuple[Query, str]] = {}


def add_staged(name: str, source: Callable[[str], str], tables: list[str], stages: list[Stage], keys: list[str], values: list[str], where: str = "true") -> None:
    """Registers a query made of stages over a source given as SQL text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        start = panels.query(spark, sf_dir, f"select * from {source('spark')}", tables)
        return staged(start, stages).where(where)

    _add(name, run, f"{duck(staged_sql(source('check'), stages))} where {where}", keys, values)


def _add(name: str, run: Query, check: str | None, keys: list[str], values: list[str]) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir).selectExpr(*output(keys, values))
    if check:
        ORACLE[name] = f"select {', '.join(output(keys, values))} from {check}"
        FULL[name] = (lambda spark, sf_dir: run(spark, sf_dir).selectExpr(*full_output(keys, values)), f"select {', '.join(full_output(keys, values))} from {check}")


def add_sql(name: str, tables: list[str], text: str, check: str | None = None) -> None:
    """Registers a query that is SQL text; check: its text for the other engine, where that differs."""
    QUERIES[name] = lambda spark, sf_dir: panels.query(spark, sf_dir, text, tables)
    ORACLE[name] = duck(check or text)


def _family(name: str, base: list[Stage], factors: dict[str, str], only: set[str] | None = None) -> None:
    made = {f"f_{k}": v for k, v in factors.items() if only is None or k in only}
    add_staged(name, panels.weekly_sql, ["lineitem"], [*base, made], ["symbol", "td"], list(made))


def _family_by_symbol(name: str, base: list[Stage], factors: dict[str, str], run: Query) -> None:
    """A family whose windows by symbol are Arrow passes. Its SQL is the stages' text."""
    made = {f"f_{k}": v for k, v in factors.items()}
    check = duck(staged_sql(panels.weekly_sql("check"), [*base, made]))
    _add(name, run, f"{check} where true", ["symbol", "td"], list(made))


Finish = Callable[[np.ndarray], np.ndarray]


def _family_of_arrays(name: str, base: list[Stage], factors: dict[str, str], run: Callable[[SparkSession, str, Finish], DataFrame], where: str = " where true") -> None:
    """A family in NumPy, whose last pass also finishes the values (`single` does what `output` does elsewhere). Its SQL is the stages' text."""
    keys, made = ["symbol", "td"], {f"f_{k}": v for k, v in factors.items()}
    check = duck(staged_sql(panels.weekly_sql("check"), [*base, made])) + where
    of = lambda s, d, finish: run(s, d, finish).select(*keys, *[F.col(n).alias(f"f_{n}") for n in factors])
    QUERIES[name] = lambda s, d: of(s, d, single)
    ORACLE[name] = f"select {', '.join(output(keys, list(made)))} from {check}"
    FULL[name] = (lambda s, d: of(s, d, lambda v: v), f"select {', '.join(full_output(keys, list(made)))} from {check}")


def factors_eod(spark: SparkSession, sf_dir: str, finish: Finish) -> DataFrame:
    make = lambda p: {n: finish(v) for n, v in arrays.eod(p).items()}
    return by_symbol(panels.weekly_by_symbol(spark, sf_dir, arrays.PANEL), arrays.PANEL, make, list(daily.EOD))


_family_of_arrays("factors_eod", daily.BASE, daily.EOD, factors_eod)


def factors_engine(spark: SparkSession, sf_dir: str, finish: Finish) -> DataFrame:
    """The engine family: what the dates need by symbol, all cross-sections of a date at once, then all windows by symbol.

    The panel's columns go along to the dates and back with what these made, so that the panel is made and sorted once.
    """
    panel = [c for c in arrays.PANEL if c != "turnover"]
    start = panels.weekly_by_symbol(spark, sf_dir, panel)
    inputs = by_symbol(start, panel, lambda p: arrays.engine_inputs(p) | {c: p[c] for c in panel}, list(dict.fromkeys([*arrays.ENGINE_CROSSED, *panel])))
    dates = [n for n in daily.ENGINE if n in arrays.ENGINE_DATES]

    def crosses(x: arrays.Arrays) -> arrays.Arrays:
        made = arrays.engine_dates(x, average_ranks, scores, lambda y, xs: residual(y, xs, 8))
        return {n: v if n == "rank_ret_20" else finish(v) for n, v in made.items()}

    held = by_date(inputs, arrays.ENGINE_CROSSED, crosses, ["rank_ret_20", *dates], panel).repartition("symbol").sortWithinPartitions("symbol", "td")
    return by_symbol(held, [*panel, "rank_ret_20", *dates], lambda p: {n: finish(v) for n, v in arrays.engine(p).items()} | {n: p[n] for n in dates}, list(daily.ENGINE))


_family_of_arrays("factors_engine", [*daily.BASE, *daily.ENGINE_BASE], daily.ENGINE, factors_engine, "")


def factors_broker(spark: SparkSession, sf_dir: str, finish: Finish) -> DataFrame:
    """The broker family: the market's return of each date first, all windows by symbol, then the cross-sections of the date at once."""
    start = panels.weekly_by_symbol(spark, sf_dir, arrays.PANEL)
    returns = by_symbol(start, ["close"], lambda p: {"ret": safe(p["close"] - p.shift("close"), p.shift("close"))}, ["ret"])
    market = returns.groupBy("td").agg(F.avg("ret").alias("market_ret"))  # a row a date
    held = start.join(F.broadcast(market), "td", "left")  # left: both readings of the panel stay the same exchange
    late = ["cn_attention_shock_5d", "cn_rsi_momentum_gap_20d"]
    now = [n for n in daily.BROKER if n not in late]
    windows = lambda p: {n: finish(v) if n in now else v for n, v in arrays.broker(p).items()}
    made = by_symbol(held, [*arrays.PANEL, "market_ret"], windows, [*now, *arrays.BROKER_CROSSED])
    crosses = lambda x: {n: finish(v) for n, v in arrays.broker_dates(x, average_ranks, scores).items()}
    return by_date(made, arrays.BROKER_CROSSED, crosses, late, now)


_family_of_arrays("factors_broker", daily.BASE + daily.ENGINE_BASE[:1] + daily.BROKER_BASE, daily.BROKER, factors_broker)


# Order flow and order size -----------------------------------------------------------------

_family("factors_trade_flow", flow.TRADE_FLOW_BASE, flow.TRADE_FLOW)
_family("factors_order_size", flow.ORDER_SIZE_BASE, flow.ORDER_SIZE)


def factors_flow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows by symbol, then the z-scores of the dates at once."""
    z = {"flow_net_20d": "net20", "flow_net_5d": "net5", "flow_net_shock": "net_z60", "flow_buy_share_20d": "buy20"}
    now = {f"f_{n}": t for n, t in flow.STATES.items() if n not in z}
    held = staged_by_symbol(panels.weekly(spark, sf_dir), [*flow.STATE_BASE, now], [*now, *z.values()])
    return crossed(held, Pass(z={f"f_{n}": x for n, x in z.items()}), keep=list(now))


def factors_flow_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks and residuals of the dates at once, over the few columns that are needed, then all windows by symbol."""
    what = Pass({"r_ret": "day_ret", "r_neg": "neg_ret", "r_net": "net_flow", "r_sell": "sell_intensity", "r_buy": "buy_intensity"}, residuals={"flow_resid": ("day_ret", ["net_flow"])})
    day = staged(panels.weekly(spark, sf_dir), [flow.RESPONSE_BASE[0], {"neg_ret": "-day_ret"}])
    made = {f"f_{n}": t for n, t in flow.RESPONSE.items()}
    held = crossed(day, what, keep=["net_flow", "cancel_pressure", "cancel_intensity", "depth", "spread"])
    return staged_by_symbol(held, [flow.RESPONSE_BASE[-1], made], list(made))


_family_by_symbol("factors_flow_states", flow.STATE_BASE, flow.STATES, factors_flow_states)
_family_by_symbol("factors_flow_response", flow.RESPONSE_BASE, flow.RESPONSE, factors_flow_response)
_family("factors_size_normalised", flow.NORMALISED_BASE, flow.NORMALISED)


# Order book arrays --------------------------------------------------------------------------


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as snapshots: levels 1-10 bid volumes, 11-20 ask volumes, 21-30 and 31-40 steps of the prices."""
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    steps = lambda a, sign: F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.lit(100.0) + sign * F.aggregate(F.slice(a, F.lit(1), i), F.lit(0.0), lambda s, x: s + x))
    d = panels.table(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("e"))
    return d.select("vec_id", "label", F.slice("e", 1, 10).alias("bid"), F.slice("e", 11, 10).alias("ask"), steps(F.slice("e", 21, 10), -1.0).alias("bid_price"), steps(F.slice("e", 31, 10), 1.0).alias("ask_price"))


def order_book_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = book.snapshot_metrics(F.col("bid"), F.col("ask"), F.col("bid_price"), F.col("ask_price"))
    d = _books(spark, sf_dir).select("vec_id", "label", *[c.alias(n) for n, c in made.items()])
    return d.selectExpr(*output(["vec_id", "label"], list(made)))


_BOOK_SQL = """
(with e as (select vec_id, label, list_transform(embedding, lambda x: abs(cast(x as double))) as e from embeddings),
p as (select vec_id, label, e[1:10] as bid, e[11:20] as ask, list_transform(range(1, 11), lambda i: 100.0 - list_sum(e[21:20 + i])) as bp, list_transform(range(1, 11), lambda i: 100.0 + list_sum(e[31:30 + i])) as ap from e)
select vec_id, label,
  (list_sum(bid[1:1]) - list_sum(ask[1:1])) / nullif(list_sum(bid[1:1]) + list_sum(ask[1:1]), 0) as obi_1,
  (list_sum(bid[1:5]) - list_sum(ask[1:5])) / nullif(list_sum(bid[1:5]) + list_sum(ask[1:5]), 0) as obi_5,
  (list_sum(bid) - list_sum(ask)) / nullif(list_sum(bid) + list_sum(ask), 0) as obi_10,
  (list_sum(list_transform(range(1, 11), lambda i: bid[i] / i)) - list_sum(list_transform(range(1, 11), lambda i: ask[i] / i))) / nullif(list_sum(list_transform(range(1, 11), lambda i: bid[i] / i)) + list_sum(list_transform(range(1, 11), lambda i: ask[i] / i)), 0) as weighted_obi,
  (ap[1] - bp[1]) / nullif((ap[1] + bp[1]) / 2, 0) as relative_spread,
  ((bp[1] * ask[1] + ap[1] * bid[1]) / nullif(ask[1] + bid[1], 0) - (bp[1] + ap[1]) / 2) / nullif((bp[1] + ap[1]) / 2, 0) as microprice_deviation,
  (list_sum(bid[1:3]) - list_sum(ask[1:3])) / nullif(list_sum(bid[1:3]) + list_sum(ask[1:3]), 0) - (list_sum(bid) - list_sum(ask)) / nullif(list_sum(bid) + list_sum(ask), 0) as near_far_imbalance,
  list_sum(list_transform(bid, lambda x: x * x)) / nullif(list_sum(bid) * list_sum(bid), 0) as bid_hhi,
  list_sum(list_transform(ask, lambda x: x * x)) / nullif(list_sum(ask) * list_sum(ask), 0) as ask_hhi,
  list_sum(list_transform(range(1, 11), lambda i: bid[i] * (i - 5.5))) / 82.5 as bid_slope,
  list_sum(list_transform(range(1, 11), lambda i: ask[i] * (i - 5.5))) / 82.5 as ask_slope,
  (list_sum(list_transform(range(1, 11), lambda i: ask[i] * ap[i])) / nullif(list_sum(ask), 0) - list_sum(list_transform(range(1, 11), lambda i: bid[i] * bp[i])) / nullif(list_sum(bid), 0)) / nullif((bp[1] + ap[1]) / 2, 0) as book_vwap_gap,
  ln(1 + list_sum(bid) + list_sum(ask)) as log_depth,
  -list_sum(list_transform(bid, lambda x: case when x > 0 then x / list_sum(bid) * ln(x / list_sum(bid)) else 0 end)) / ln(10.0) as bid_entropy,
  list_max(bid) / nullif(list_sum(bid), 0) as bid_wall, list_max(ask) / nullif(list_sum(ask), 0) as ask_wall
from p)
"""
_BOOK = ["obi_1", "obi_5", "obi_10", "weighted_obi", "relative_spread", "microprice_deviation", "near_far_imbalance", "bid_hhi", "ask_hhi", "bid_slope", "ask_slope", "book_vwap_gap", "log_depth", "bid_entropy", "bid_wall", "ask_wall"]
QUERIES["order_book_snapshots"] = order_book_snapshots
ORACLE["order_book_snapshots"] = f"select {', '.join(output(['vec_id', 'label'], _BOOK))} from {_BOOK_SQL}"


def order_book_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots in order of id, 25 a day by symbol (label): means, deviations, open, close, slope, sign persistence, shocks."""
    made = book.snapshot_metrics(F.col("bid"), F.col("ask"), F.col("bid_price"), F.col("ask_price"))
    d = _books(spark, sf_dir).select(F.col("label").alias("symbol"), (F.col("vec_id") / 100).cast("int").alias("td"), (F.col("vec_id") % 100).cast("int").alias("slot"), *[c.alias(n) for n, c in made.items()])
    d.createOrReplaceTempView("book_snapshots")
    return staged(spark.sql(f"select * from {_book_daily_sql('book_snapshots')}"), _BOOK_SHOCKS).selectExpr(*output(["symbol", "td"], _BOOK_DAILY))


def _book_daily_sql(source: str) -> str:
    means = ", ".join(f"avg({m}) as {m}_mean, stddev_samp({m}) as {m}_std" for m in _BOOK)
    return f"""(select symbol, td, {means},
      avg(case when slot < 25 then obi_5 end) as opening_obi_l5, avg(case when slot >= 75 then obi_5 end) as closing_obi_l5,
      avg(case when slot < 25 then relative_spread end) as opening_spread, avg(case when slot >= 75 then relative_spread end) as closing_spread,
      avg(case when slot < 25 then log_depth end) as opening_depth, avg(case when slot >= 75 then log_depth end) as closing_depth,
      (avg(slot * obi_5) - avg(slot) * avg(obi_5)) / nullif(var_pop(slot), 0) as obi_intraday_slope,
      avg(case when before is not null then case when sign(obi_5) = sign(before) then 1e0 else 0e0 end end) as obi_sign_persistence
      from (select *, lag(obi_5) over (partition by symbol, td order by slot) as before from {source}) s group by symbol, td)"""


_BOOK_SHOCKS: list[Stage] = [
    {
        "opening_closing_obi_change": "closing_obi_l5 - opening_obi_l5",
        "opening_closing_spread_change": "closing_spread - opening_spread",
        "opening_closing_depth_change": "closing_depth - opening_depth",
        "depth_concentration_asymmetry": "bid_hhi_mean - ask_hhi_mean",
        "depth_slope_asymmetry": "bid_slope_mean - ask_slope_mean",
        **{f"{n}_shock": flow.own_z(m, 20, 3, "rows") for n, m in (("obi", "obi_5_mean"), ("spread", "relative_spread_mean"), ("depth", "log_depth_mean"), ("microprice", "microprice_deviation_mean"))},
    }
]
_BOOK_DAILY = [f"{m}_{s}" for m in _BOOK for s in ("mean", "std")] + ["opening_obi_l5", "closing_obi_l5", "obi_intraday_slope", "obi_sign_persistence", *_BOOK_SHOCKS[0]]
QUERIES["order_book_daily"] = order_book_daily
ORACLE["order_book_daily"] = f"select {', '.join(output(['symbol', 'td'], _BOOK_DAILY))} from {staged_sql(_book_daily_sql(f'(select *, label as symbol, cast(floor(vec_id / 100) as int) as td, cast(vec_id % 100 as int) as slot from {_BOOK_SQL})'), _BOOK_SHOCKS)}"


# Intraday bars ------------------------------------------------------------------------------

_bar = {f"f_{k}": v for k, v in intraday.BAR_FACTORS.items()}
add_staged("intraday_factors", panels.bars_sql, ["events"], [*intraday.BAR_BASE, _bar], ["symbol", "day", "slot"], list(_bar))
#: Signals at five slots only; the filter stands above the windows.
add_staged("intraday_signal_slots", panels.bars_sql, ["events"], [*intraday.BAR_BASE, _bar], ["symbol", "day", "slot"], list(_bar), where="slot in (19, 20, 22, 26, 28)")


def _grouped(stages: list[Stage], grouped: Callable[[str], str]) -> Callable[[str], str]:
    return lambda dialect: grouped(staged_sql(panels.bars_sql(dialect), stages))


add_staged("price_formation", _grouped(intraday.PATH_BASE, intraday.path_sql), ["events"], intraday.PATH_LAST, ["symbol", "day"], intraday.PATH_VALUES)
add_staged("liquidity_impact", _grouped(intraday.FORWARD, intraday.impact_sql), ["events"], intraday.IMPACT_LAST, ["symbol", "day"], intraday.IMPACT_VALUES)
add_staged("resilience", _grouped(intraday.RESILIENCE, intraday.resilience_sql), ["events"], [], ["symbol", "day"], intraday.RESILIENCE_VALUES)


# Evaluation of a reversal signal on the weekly panel ---------------------------------------------

_SIGNAL: list[Stage] = [
    {"close_4": daily.shift("close", 4), "close_next": daily.shift("close", -1)},
    {"ret_4": "close / nullif(close_4, 0) - 1", "fwd": "close_next / nullif(close, 0) - 1"},
    {"signal": "-ret_4"},
]
_PANEL_SQL = duck(staged_sql(panels.weekly_sql("check"), _SIGNAL))
_RANKED = f"""(select *, row_number() over (partition by td order by signal, symbol) as r, count(*) over (partition by td) as m from {_PANEL_SQL} where signal is not null)"""
_GROUPED = f"(select symbol, td, signal, fwd, cast(case when m = 1 then 1 else greatest(1, floor(((r - 1) * 5 + m - 2) / (m - 1))) end as int) as grp from {_RANKED})"
_WEIGHTED = f"(select *, 1e0 / count(*) over (partition by td, grp) as weight from {_GROUPED})"
_TEST = f"""(with w as {_WEIGHTED}, d as (select distinct td from {_PANEL_SQL}),
pnl as (select td, grp, count(*) as names, sum(weight * coalesce(fwd, 0)) as gross from w group by td, grp),
mv as (select coalesce(a.td, b.td + 1) as td, coalesce(a.grp, b.grp) as grp, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) as x from w a full join w b on a.symbol = b.symbol and a.grp = b.grp and a.td = b.td + 1),
t as (select td, grp, sum(x) as turnover from mv where td in (select td from d) group by td, grp),
one as (select td, grp, coalesce(names, 0) as names, coalesce(gross, 0) as gross, turnover from t left join pnl using (td, grp)),
net as (select *, gross - 0.00075 * turnover * case when (select sum(gross) from one o where o.grp = one.grp) > 0 then 1 else -1 end as net from one),
sp as (select h.td, 0 as grp, h.names + l.names as names, h.gross - l.gross as gross, h.turnover + l.turnover as turnover, h.net - l.net as net from net h join net l on h.td = l.td and h.grp = 5 and l.grp = 1)
select * from net union all select * from sp)"""


def signal_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(panels.weekly(spark, sf_dir), _SIGNAL).select("symbol", "td", "close", "volume", "amount", "signal", "fwd")


_add("decile_groups", lambda s, d: ev.group_weights(signal_panel(s, d), 5), _WEIGHTED, ["symbol", "td", "grp"], ["signal", "weight"])
_add("group_test", lambda s, d: ev.group_test(signal_panel(s, d), 5, 0.00075), _TEST, ["td", "grp"], ["names", "gross", "turnover", "net"])
_IC = f"""(select td, corr(rs, rf) as ic, count(*) as names from (select td, rank() over (partition by td order by signal) + (count(*) over (partition by td, signal) - 1) / 2.0 as rs,
  rank() over (partition by td order by fwd) + (count(*) over (partition by td, fwd) - 1) / 2.0 as rf from {_PANEL_SQL} where signal is not null and fwd is not null) group by td)"""
_add("rank_ic", lambda s, d: ev.rank_ic(signal_panel(s, d)), _IC, ["td"], ["ic", "names"])
_PERF = f"""(with c as (select grp, td, net, coalesce(product(greatest(1 + net, 0)) over (partition by grp order by td), 1) as wealth from {_TEST} where grp > 0 and net is not null),
 p as (select *, greatest(1, max(wealth) over (partition by grp order by td)) as peak from c),
 q as (select p.*, 1 - wealth / peak as fall, (select max(o.td) from p o where o.grp = p.grp and o.td <= p.td and o.wealth = o.peak) as top, row_number() over (partition by grp order by 1 - wealth / peak desc, td) as worst from p)
 select grp, count(net) as days, avg(net) * 250 as annual_return, avg(net) / nullif(stddev_samp(net), 0) * sqrt(250) as sharpe, max(fall) as max_drawdown, avg(case when net > 0 then 1.0 else 0.0 end) as hit_rate,
  max(case when worst = 1 then top end) as peak_td, max(case when worst = 1 then td end) as trough_td from q group by grp)"""
_add("performance", lambda s, d: ev.performance(ev.group_test(signal_panel(s, d), 5, 0.00075).where("grp > 0"), "grp", "net"), _PERF, ["grp", "peak_td", "trough_td"], ["days", "annual_return", "sharpe", "max_drawdown", "hit_rate"])
_REB = f"(select a.symbol, a.td, a.fwd, b.signal from {_PANEL_SQL} a left join {_PANEL_SQL} b on a.symbol = b.symbol and b.td = a.td - a.td % 4)"
_add("rebalanced", lambda s, d: ev.rebalanced(signal_panel(s, d), 4), _REB, ["symbol", "td"], ["signal", "fwd"])
_RANKS = f"""(select symbol, td, signal, case when signal is not null then (rank() over (partition by td order by signal nulls last) + (count(*) over (partition by td, signal) - 1) / 2e0) / count(signal) over (partition by td) end as pct from {_PANEL_SQL})"""
_HYS = f"""(with recursive r as (select *, row_number() over (partition by symbol order by td) as n from {_RANKS}),
 m as (select symbol, td, pct, n, case when pct >= 0.9e0 then 1 else 0 end as long, case when pct <= 0.1e0 then 1 else 0 end as short from r where n = 1
  union all select r.symbol, r.td, r.pct, r.n, case when r.pct >= 0.9e0 then 1 when r.pct is null or r.pct < 0.8e0 or r.td > m.td + 1 then 0 else m.long end,
   case when r.pct <= 0.1e0 then 1 when r.pct is null or r.pct > 0.2e0 or r.td > m.td + 1 then 0 else m.short end from m join r on r.symbol = m.symbol and r.n = m.n + 1)
 select * from m)"""
_add("hysteresis", lambda s, d: ev.hysteresis(signal_panel(s, d), 0.1, 0.2), _HYS, ["symbol", "td", "long", "short"], ["pct"])
_HOLD = f"""(with recursive h as {_HYS},
 k as (select symbol, td, n, long as held_long, case when long = 0 then short else 0 end as held_short from h where n = 1
  union all select h.symbol, h.td, h.n, case when h.long = 1 or k.held_long between 1 and 4 then k.held_long + 1 else 0 end,
   case when (h.short = 1 or k.held_short between 1 and 4) and not (h.long = 1 or k.held_long between 1 and 4) then k.held_short + 1 else 0 end from k join h on h.symbol = k.symbol and h.n = k.n + 1)
 select symbol, td, cast(held_long as bigint) as held_long, cast(held_short as bigint) as held_short from k)"""
_add("minimum_holding", lambda s, d: ev.minimum_holding(ev.hysteresis(signal_panel(s, d), 0.1, 0.2), 5), _HOLD, ["symbol", "td", "held_long", "held_short"], [])


def _books_of(s: SparkSession, d: str, method: str) -> DataFrame:
    panel = signal_panel(s, d)
    return ev.book_weights(panel.select("symbol", "td", "signal").join(ev.hysteresis(panel, 0.1, 0.2), ["symbol", "td"]), method)


for _method, _scores in (("ew", ("1e0", "1e0")), ("rank", ("r.pct", "1 - r.pct")), ("zscore", ("greatest(z, 0)", "greatest(-z, 0)"))):
    _add(f"weights_{_method}", lambda s, d, m=_method: _books_of(s, d, m), f"""(with z as (select r.*, (signal - avg(signal) over (partition by td)) / nullif(stddev_samp(signal) over (partition by td), 0) as z from {_RANKS} r where signal is not null),
 q as (select r.symbol, r.td, case when long = 1 then {_scores[0]} end as l, case when short = 1 then {_scores[1]} end as s from z r join {_HYS} h on r.symbol = h.symbol and r.td = h.td),
 t as (select td, sum(l) as tl, sum(s) as ts from q group by td)
 select symbol, q.td, coalesce(l / nullif(tl, 0), 0) as w_long, coalesce(s / nullif(ts, 0), 0) as w_short from q join t on q.td = t.td)""", ["symbol", "td"], ["w_long", "w_short"])
_OVER = f"(with w as {_WEIGHTED} select symbol, td + k as td, sum(weight) / 4 as weight from w, range(4) r(k) where grp = 5 group by symbol, td + k)"
_add("overlapped", lambda s, d: ev.overlapped(ev.group_weights(signal_panel(s, d), 5).where("grp = 5"), 4), _OVER, ["symbol", "td"], ["weight"])
_NW = f"""(select 0 as grp, count(*) as days, avg(ic) as mean, avg(ic) / nullif(sqrt(greatest(sum(dev * dev) + 2 * (0.75 * coalesce(sum(dev * l1), 0) + 0.5 * coalesce(sum(dev * l2), 0) + 0.25 * coalesce(sum(dev * l3), 0)), 0)) / count(*), 0) as t_value
 from (select *, lag(dev, 1) over (order by td) as l1, lag(dev, 2) over (order by td) as l2, lag(dev, 3) over (order by td) as l3 from (select td, ic, ic - avg(ic) over () as dev from {_IC} where ic is not null and not isnan(ic) and names >= 10)) having count(*) > 0)"""
_add("newey_west", lambda s, d: ev.newey_west(ev.rank_ic(signal_panel(s, d)).where("ic is not null and not isnan(ic) and names >= 10").withColumn("grp", F.lit(0)), "grp", "ic", 3), _NW, ["grp"], ["days", "mean", "t_value"])
_DRIFT = f"""(with w as (select *, cast(floor(td / 4) as int) as block, 1e0 as w0 from {_PANEL_SQL}), v as (select *, w0 * exp(coalesce(sum(ln(1 + coalesce(fwd, 0))) over (partition by symbol, block order by td rows between unbounded preceding and 1 preceding), 0)) as value from w)
 select symbol, td, value / sum(value) over (partition by td) as weight from v)"""
_add("drifted_weights", lambda s, d: ev.drifted(signal_panel(s, d).select("symbol", "td", F.floor(F.col("td") / 4).cast("int").alias("block"), F.lit(1.0).alias("w0"), F.col("fwd").alias("ret"))), _DRIFT, ["symbol", "td"], ["weight"])
_add("pca_scores", lambda s, d: ev.pca_scores(signal_panel(s, d).withColumn("log_amount", F.log("amount")), ["signal", "log_amount", "volume"], 2), None, ["symbol", "td"], ["pc1", "pc2"])


# Joins ----------------------------------------------------------------------------------------


def asof_join(spark: SparkSession, sf_dir: str, strict: bool = False, parted: bool = False) -> DataFrame:
    """Orders with the last earlier event of the same customer hash: value and time."""
    o = panels.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("who"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(o_orderkey % 30, o_orderkey % 24, o_orderkey % 60)").alias("at"))
    e = panels.table(spark, sf_dir, "events").select((F.col("user_id") % 150).alias("who"), F.date_trunc("minute", "ts").alias("ts"), "event_id", "value")
    return joins.asof(o, e, "who", "at", "ts", ["event_id", "value"], strict=strict, most=F.expr("interval 2 days"), tie=["event_id"], part=F.to_date if parted else None)


def _asof_sql(op: str) -> str:
    return f"""(with o as (select o_orderkey, o_custkey % 150 as who, timestamp '2024-01-01 00:00:00' + to_days(cast(o_orderkey % 30 as int)) + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) as at from orders),
    e as (select user_id % 150 as who, date_trunc('minute', ts) as ts, event_id, value from events),
    h as (select o_orderkey, e.event_id, e.value, e.ts, o.at, row_number() over (partition by o_orderkey order by e.ts desc, e.event_id desc) as n from o join e on o.who = e.who and e.ts {op} o.at)
    select o.o_orderkey, o.who, case when h.ts >= o.at - interval 2 day then h.event_id end as event_id, case when h.ts >= o.at - interval 2 day then h.value end as value from o left join h on o.o_orderkey = h.o_orderkey and n = 1)"""


_add("asof_join", asof_join, _asof_sql("<="), ["o_orderkey", "who", "event_id"], ["value"])
_add("asof_join_by_day", lambda s, d: asof_join(s, d, True, True), _asof_sql("<"), ["o_orderkey", "who", "event_id"], ["value"])
_add("asof_join_strict", lambda s, d: asof_join(s, d, True), _asof_sql("<"), ["o_orderkey", "who", "event_id"], ["value"])


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of supplier bars in which each of the supplier's membership intervals holds (from its parts)."""
    bars = panels.weekly(spark, sf_dir).select("symbol", "td", "amount")
    li = panels.table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '1995-01-01 00:00:00'")
    iv = li.groupBy(F.col("l_suppkey").cast("int").alias("symbol"), (F.col("l_partkey") % 10).alias("pool")).agg(F.expr("cast(min(floor(datediff(l_shipdate, timestamp '1995-01-01 00:00:00') / 7)) as int)").alias("entered"), F.expr("cast(max(floor(datediff(l_shipdate, timestamp '1995-01-01 00:00:00') / 7)) as int)").alias("left_"))
    return joins.within(bars, iv.withColumn("left_", F.when(F.col("pool") != 3, F.col("left_"))), "symbol", "td", "entered", "left_", 26).select("symbol", "td", "pool", "amount")


_add("interval_join", interval_join, f"""(with iv as (select cast(l_suppkey as int) as symbol, l_partkey % 10 as pool, min(cast(floor(datediff('day', timestamp '1995-01-01 00:00:00', l_shipdate) / 7) as int)) as f, max(cast(floor(datediff('day', timestamp '1995-01-01 00:00:00', l_shipdate) / 7) as int)) as t from lineitem where l_shipdate >= timestamp '1995-01-01 00:00:00' group by 1, 2)
 select b.symbol, b.td, pool, amount from {panels.weekly_sql('check')} b join iv on b.symbol = iv.symbol and b.td >= f and (pool = 3 or b.td <= t))""", ["symbol", "td", "pool"], ["amount"])


def first_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders mapped to the first day at or after theirs that has a shipment of a part divisible by 50."""
    days = panels.table(spark, sf_dir, "lineitem").where("l_partkey % 50 = 0").select(F.to_date("l_shipdate").alias("d"))
    o = panels.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return joins.first_on_or_after(o, days, "o_orderdate", "d").select("o_orderkey", F.col("_day").cast("string").alias("day"))


_add("first_trading_day", first_trading_day, "(with d as (select distinct cast(l_shipdate as date) as d from lineitem where l_partkey % 50 = 0) select o_orderkey, cast((select min(d) from d where d.d >= cast(o_orderdate as date)) as varchar) as day from orders)", ["o_orderkey", "day"], [])
_add("keep_latest", lambda s, d: joins.keep(panels.table(s, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice"), "(select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1)", ["o_custkey", "o_orderkey"], ["o_totalprice"])
_add("keep_earliest", lambda s, d: joins.keep(panels.table(s, d, "orders"), ["o_custkey"], [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]).select("o_custkey", "o_orderkey", "o_totalprice"), "(select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n = 1)", ["o_custkey", "o_orderkey"], ["o_totalprice"])
_add("checked_join", lambda s, d: joins.checked_many_to_one(panels.table(s, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), panels.table(s, d, "nation"), ["n_nationkey"]).select("c_custkey", "n_name", "c_acctbal"), "(select c_custkey, n_name, c_acctbal from customer left join nation on c_nationkey = n_nationkey)", ["c_custkey", "n_name"], ["c_acctbal"])
_add("renamed_codes", lambda s, d: joins.renamed(panels.table(s, d, "customer").select("c_custkey", "c_mktsegment"), panels.table(s, d, "region").selectExpr("case r_regionkey when 0 then 'BUILDING' when 1 then 'MACHINERY' else r_name end as old", "concat('R', r_regionkey) as new"), "c_mktsegment", "old", "new"), "(select c_custkey, coalesce(new, c_mktsegment) as c_mktsegment from customer left join (select case r_regionkey when 0 then 'BUILDING' when 1 then 'MACHINERY' else r_name end as old, 'R' || r_regionkey as new from region) on c_mktsegment = old)", ["c_custkey", "c_mktsegment"], [])
add_sql("semi_join", ["customer", "orders"], "select c_custkey, c_name from customer left semi join orders on c_custkey = o_custkey and o_totalprice > 100000", "select c_custkey, c_name from customer where exists (select 1 from orders where c_custkey = o_custkey and o_totalprice > 100000)")
add_sql("anti_join", ["customer", "orders"], "select c_custkey, c_name from customer left anti join orders on c_custkey = o_custkey and o_totalprice > 400000", "select c_custkey, c_name from customer where not exists (select 1 from orders where c_custkey = o_custkey and o_totalprice > 400000)")


# Cross-sections: winsorising, standardising, neutralising ---------------------------------------


def industry_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal panel with the supplier's nation as industry and its balance as size."""
    p = staged(panels.weekly(spark, sf_dir), _SIGNAL)
    s = panels.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("symbol"), F.col("s_nationkey").alias("industry"), F.log(F.col("s_acctbal") + 2000).alias("size"))
    return p.join(s, "symbol").withColumn("log_amount", F.log("amount"))


_IP = f"(select p.*, s_nationkey as industry, ln(s_acctbal + 2000) as size, ln(amount) as log_amount from {_PANEL_SQL} p join supplier on symbol = s_suppkey)"


def _on_panel(name: str, run: Callable[[DataFrame], DataFrame], check: str, keys: list[str], values: list[str]) -> None:
    """A query over the industry panel; {p} in the SQL is that panel."""
    _add(name, lambda s, d: run(industry_panel(s, d)), check.replace("{p}", _IP), keys, values)


_MED = "quantile_cont({0}, 0.5) over (partition by td)"
_MADS = "(select *, " + _MED.format("abs(signal - med)") + " * 1.4826 * 3 as width from (select *, " + _MED.format("signal") + " as med from {p}))"
_on_panel("mad_tanh", lambda p: cs.with_mad(p, "signal", "v"), f"(select symbol, td, case when width > 0 then tanh((signal - med) / nullif(width, 0) * 1.212) * width + med else signal end as v from {_MADS})", ["symbol", "td"], ["v"])
_on_panel("mad_clip", lambda p: cs.with_mad(p, "signal", "v", soft=False), f"(select symbol, td, case when width > 0 and signal is not null then case when signal > med + width then med + width when signal < med - width then med - width else signal end else signal end as v from {_MADS})", ["symbol", "td"], ["v"])
_on_panel("winsor_squeeze", lambda p: cs.with_squeeze(p, "signal", "v", width=2.0), f"""(with m as (select *, {_MED.format('signal')} as med, avg(signal) over (partition by td) as mean from {{p}}), w as (select *, 2 * avg(abs(signal - mean)) over (partition by td) as dev from m)
 select symbol, td, case when signal > med + dev then med + dev + (signal - med - dev) / 1000 when signal < med - dev then med - dev + (signal - med + dev) / 1000 else signal end as v from w)""", ["symbol", "td"], ["v"])
_Z = "(with m as (select td, avg(signal) as a, stddev_samp(signal) as s1, stddev_pop(signal) as s0 from {p} group by td) select symbol, x.td, "
_on_panel("z_scores", lambda p: p.select("symbol", "td", cs.z_score(F.col("signal")).alias("z1"), cs.z_score(F.col("signal"), ddof=0).alias("z0"), cs.z_score(F.col("signal"), constant=0.0).alias("zc")), _Z + "case when s1 > 1e-12 then (signal - a) / s1 end as z1, case when s0 > 1e-12 then (signal - a) / s0 end as z0, case when signal is not null then coalesce(case when s1 > 1e-12 then (signal - a) / s1 end, 0) end as zc from {p} x join m on m.td = x.td)", ["symbol", "td"], ["z1", "z0", "zc"])
_on_panel("rank_z", lambda p: cs.with_rank_z(p, "signal", "v"), """(with s as (select symbol, td, signal from {p}), r as (select a.symbol, a.td, case when a.signal is not null then (count(case when b.signal < a.signal then 1 end) + (count(case when b.signal = a.signal then 1 end) + 1) / 2e0) / count(b.signal) end as pct from s a join s b on a.td = b.td group by a.symbol, a.td, a.signal)
 select symbol, td, (pct - avg(pct) over (partition by td)) / nullif(stddev_pop(pct) over (partition by td), 0) as v from r)""", ["symbol", "td"], ["v"])
_on_panel("industry_demeaned", lambda p: p.select("symbol", "td", cs.demeaned(F.col("signal"), ["td", "industry"], 2).alias("v")), "(with m as (select td, industry, avg(signal) as a, count(signal) as n from {p} group by td, industry) select symbol, x.td, case when n >= 2 then signal - a end as v from {p} x join m on m.td = x.td and m.industry = x.industry)", ["symbol", "td"], ["v"])
_SIZE_RES = """(with u as (select * from {p} where {y} is not null), m as (select td, industry, avg({y}) as ym, avg(size) as sm from u group by td, industry),
 e as (select u.symbol, u.td, {y} - ym as yd, size - sm as sd from u join m on m.td = u.td and m.industry = u.industry), b as (select td, sum(yd * sd) / nullif(sum(sd * sd), 0) as slope, count(*) as n from e group by td)
 select x.symbol, x.td, case when n >= 10 then yd - coalesce(slope, 0) * sd end as v from {p} x left join e on e.symbol = x.symbol and e.td = x.td left join b on b.td = x.td)"""
_on_panel("industry_size_residual", lambda p: cs.with_industry_size_residual(p, "signal", "size", "industry", "v"), _SIZE_RES.replace("{y}", "signal"), ["symbol", "td"], ["v"])
_TWO = """(with u as (select *, count(*) over (partition by td) as n from {p} where {y} is not null and size is not null and log_amount is not null),
 m as (select td, avg({y}) as ym, avg(size) as am, avg(log_amount) as bm, var_pop(size) as saa, var_pop(log_amount) as sbb, covar_pop(size, log_amount) as sab, covar_pop(size, {y}) as say, covar_pop(log_amount, {y}) as sby from u group by td),
 c as (select *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) as ca, (sby * saa - say * sab) / (saa * sbb - sab * sab) as cb from m)
 select u.symbol, u.td, u.fwd, {y} - ym - ca * (size - am) - cb * (log_amount - bm) as v from u join c on c.td = u.td where n >= 12)"""
_on_panel("residual_on_controls", lambda p: cs.with_residual(p.where("signal is not null"), "signal", ["size", "log_amount"], "v", least=12).where("v is not null"), _TWO.replace("{y}", "signal"), ["symbol", "td"], ["v"])
_on_panel("processed_signal", lambda p: cs.processed(p, "signal", "size", "industry", "v"), "(with f as (select * exclude (signal), coalesce(signal, avg(signal) over (partition by td, industry)) as filled from (select * exclude (signal), case when width > 0 then tanh((signal - med) / nullif(width, 0) * 1.212) * width + med else signal end as signal from " + _MADS + ")), r as " + _SIZE_RES.replace("{p}", "f").replace("{y}", "filled") + " select symbol, td, (v - avg(v) over (partition by td)) / nullif(stddev_samp(v) over (partition by td), 0) as v from r)", ["symbol", "td"], ["v"])


def _ic_sql(source: str, value: str) -> str:
    """Mean over dates of the rank correlation of value and fwd, by pairs of ranks counted one by one."""
    return f"""(select count(ic) as dates, avg(ic) as ic from (select td, corr(a, b) as ic from (select td, rank() over (partition by td order by {value}) + (count(*) over (partition by td, {value}) - 1) / 2e0 as a, rank() over (partition by td order by fwd) + (count(*) over (partition by td, fwd) - 1) / 2e0 as b
      from {source} where {value} is not null and fwd is not null) group by td) where not isnan(ic))"""


_ONE = "(with u as (select *, count(*) over (partition by td) as n from {p} where signal is not null), c as (select td, regr_slope(signal, size) as b, regr_intercept(signal, size) as a from u group by td) select u.symbol, u.td, u.fwd, signal - a - b * size as v from u join c on c.td = u.td where n >= 12)"
_on_panel("neutral_chain", lambda p: cs.neutral_chain(p.where("signal is not null"), "signal", ["size", "log_amount"], "fwd", least=12), f"(select 0 as step, * from {_ic_sql('{p}', 'signal')} union all select 1, * from {_ic_sql(_ONE, 'v')} union all select 2, * from {_ic_sql(_TWO.replace('{y}', 'signal'), 'v')})", ["step", "dates"], ["ic"])

