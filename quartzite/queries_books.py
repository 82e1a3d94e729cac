"""Queries of long-short books, excess returns and their checks, streams as batches and stores, with SQL written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation as ev
from .operators import investability as inv
from .queries_panel import _add, _on_panel
from .queries_more import _BARS
from .sources import panels, stores
from .streaming import bars as streams

_W = "(select symbol, td, fwd, coalesce(case when r / n::double >= 0.8e0 then 1e0 end / nullif(sum(case when r / n::double >= 0.8e0 then 1e0 end) over (partition by td), 0), 0) - coalesce(case when r / n::double <= 0.2e0 then 1e0 end / nullif(sum(case when r / n::double <= 0.2e0 then 1e0 end) over (partition by td), 0), 0) as w from (select symbol, td, fwd, row_number() over (partition by td order by signal, symbol) as r, count(*) over (partition by td) as n from {p} where signal is not null))"
_LS = f"""(with w as {_W}, m as (select coalesce(a.td, b.td + 1) as td, coalesce(a.w, 0) * coalesce(a.fwd, 0) as g, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) as x from w a full join w b on a.symbol = b.symbol and a.td = b.td + 1)
 select td, sum(g) as gross, sum(x) as turnover, sum(g) - 0.001 * sum(x) as net from m where td in (select td from {{p}}) group by td having sum(x) > 0 or count(case when g <> 0 then 1 end) > 0 or td in (select td from w where w <> 0))"""
_on_panel("long_short_net", lambda p: inv.long_short(p, 0.2, 0.001), _LS, ["td"], ["gross", "turnover", "net"])
_EX = "(with r as (select *, row_number() over (partition by td order by signal nulls last, symbol) / count(signal) over (partition by td)::double as pct from {p} where signal is not null) select td, count(*) filter (pct > 1 - 0.1e0) as chosen, count(*) as universe, avg(fwd) filter (pct > 1 - 0.1e0) - avg(fwd) as excess from r where fwd is not null group by td)"
_on_panel("excess_of_top", lambda p: inv.excess_of_top(p, 0.1), _EX, ["td", "chosen", "universe"], ["excess"])
_on_panel("excess_by_period", lambda p: inv.by_period(inv.excess_of_top(p, 0.1), "excess", F.expr("cast(floor(td / 13) as int)")), f"(select cast(floor(td / 13) as int) as period, count(excess) as days, sum(excess) as total, avg(excess) / nullif(stddev_samp(excess), 0) * sqrt(250) as sharpe from {_EX} group by 1)", ["period", "days"], ["total", "sharpe"])


def _group_means(p: DataFrame) -> DataFrame:
    return p.where("signal is not null").withColumn("grp", ev.groups(F.col("signal"), 10)).groupBy("grp").agg(F.avg("fwd").alias("mean"))


_GM = "(select cast(case when m = 1 then 1 else greatest(1, ceil((r - 1) * 10e0 / (m - 1) - 1e-9)) end as int) as grp, avg(fwd) as mean from (select *, row_number() over (partition by td order by signal, symbol) as r, count(*) over (partition by td) as m from {p} where signal is not null) group by 1)"
_on_panel("decile_groups_10", _group_means, _GM, ["grp"], ["mean"])
_on_panel("monotonicity", lambda p: inv.monotonicity(_group_means(p)), f"(select corr(a, b) as spearman, avg(up) as rising from (select rank() over (order by grp) as a, rank() over (order by mean) as b, case when mean > lag(mean) over (order by grp) then 1e0 when lag(mean) over (order by grp) is not null then 0e0 end as up from {_GM}))", [], ["spearman", "rising"])
_MARKET = "(select td, avg(fwd) as ret from {p} group by td)"
_on_panel("excess_by_regime", lambda p: inv.by_regime(inv.excess_of_top(p, 0.1), "excess", p.groupBy("td").agg(F.avg("fwd").alias("ret")), 1), f"(with m as (select td, case when avg(ret) over (order by td rows between 1 preceding and 1 preceding) > 0 then 'up' else 'down' end as regime from {_MARKET}) select regime, count(excess) as days, avg(excess) as mean from {_EX} e join m on m.td = e.td group by regime)", ["regime", "days"], ["mean"])
_IC = "(select td, case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end as ic from (select td, rank() over (partition by td order by signal) + (count(*) over (partition by td, signal) - 1) / 2e0 as a, rank() over (partition by td order by fwd) + (count(*) over (partition by td, fwd) - 1) / 2e0 as b from {p} where signal is not null and fwd is not null) group by td)"


def _ics(p: DataFrame) -> DataFrame:
    return ev.rank_ic(p).withColumn("ic", F.when(~F.isnan("ic"), F.col("ic")))


_on_panel("sign_consistency", lambda p: inv.sign_consistency(_ics(p), F.expr("cast(floor(td / 13) as int)")), f"(with q as (select floor(td / 13) as p, avg(ic) as m, count(ic) as n from {_IC} group by 1 having count(ic) > 0) select count(*) as periods, avg(case when sign(m) = (select sign(sum(ic)) from {_IC}) then 1e0 else 0e0 end) as share from q)", ["periods"], ["share"])
_on_panel("gate_verdicts", lambda p: inv.verdicts(inv.by_period(inv.excess_of_top(p, 0.1), "excess", F.expr("cast(floor(td / 13) as int)")), {"sharpe": ("sharpe", 0.5), "total": ("total", 0.0)}).select("period", "pass_sharpe", "pass_total", "pass_all"), f"(select period, coalesce(sharpe > 0.5, false) as pass_sharpe, coalesce(total > 0, false) as pass_total, coalesce(sharpe > 0.5 and total > 0, false) as pass_all from (select cast(floor(td / 13) as int) as period, sum(excess) as total, avg(excess) / nullif(stddev_samp(excess), 0) * sqrt(250) as sharpe from {_EX} group by 1))", ["period", "pass_sharpe", "pass_total", "pass_all"], [])
_on_panel("conditional_ic", lambda p: inv.conditional_ic(p, "volume"), "(" + " union all ".join(f"select {b} as bin, count(ic) as dates, avg(ic) as ic from (select td, case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end as ic from (select td, rank() over (partition by td order by signal) + (count(*) over (partition by td, signal) - 1) / 2e0 as a, rank() over (partition by td order by fwd) + (count(*) over (partition by td, fwd) - 1) / 2e0 as b from (select *, cast(floor((row_number() over (partition by td order by volume, symbol) - 1) * 3 / count(*) over (partition by td)) as int) + 1 as bin from {{p}} where signal is not null and fwd is not null) where bin = {b}) group by td)" for b in (1, 2, 3)) + ")", ["bin", "dates"], ["ic"])

# Streams as batches, stores -------------------------------------------------------------------------


def trade_events(s: SparkSession, d: str) -> DataFrame:
    e = panels.table(s, d, "events")
    return e.select(F.col("event_type").alias("symbol"), "event_id", "ts", (100 + F.col("value")).alias("price"), (1 + F.col("user_id") % 10).alias("size"), (F.col("user_id") % 2 == 0).alias("buy"))


_TE = "(select event_type as symbol, event_id, ts, 100 + value as price, 1 + user_id % 10 as size, user_id % 2 = 0 as buy from events)"
_add("ten_minute_bars", lambda s, d: streams.bars(trade_events(s, d), "10 minutes").withColumn("began", F.col("start").cast("string")), f"(select symbol, cast(time_bucket(interval 10 minute, ts) as varchar) as began, count(*) as n, sum(size) as volume, sum(price * size) as amount, max(price) as high, min(price) as low, count(*) filter (buy) as buys from {_TE} group by 1, 2)", ["symbol", "began", "n"], ["volume", "amount", "high", "low", "buys"])
_add("sliding_bars", lambda s, d: streams.bars(trade_events(s, d), "1 hour", "30 minutes").withColumn("began", F.col("start").cast("string")), f"(select symbol, cast(time_bucket(interval 30 minute, ts) - interval (k * 30) minute as varchar) as began, count(*) as n, sum(size) as volume, sum(price * size) as amount, max(price) as high, min(price) as low, count(*) filter (buy) as buys from {_TE}, range(2) r(k) group by 1, 2)", ["symbol", "began", "n"], ["volume", "amount", "high", "low", "buys"])
_add("event_sessions", lambda s, d: streams.sessions(trade_events(s, d), "20 minutes").withColumn("began", F.col("start").cast("string")), f"(with g as (select *, case when ts < lag(ts) over (partition by symbol order by ts) + interval 20 minute then 0 else 1 end as new from {_TE}), h as (select *, sum(new) over (partition by symbol order by ts, event_id rows unbounded preceding) as k from g) select symbol, cast(min(ts) as varchar) as began, count(*) as n, sum(size) as volume from h group by symbol, k)", ["symbol", "began", "n"], ["volume"])
_add("day_states", lambda s, d: streams.day_states_batch(trade_events(s, d)), f"(select symbol, cast(cast(ts as date) as varchar) as day, event_id, sum(size) over w as volume, sum(price * size) over w as amount, sum(price * size) over w / nullif(sum(size) over w, 0) as vwap, max(price) over w as high, min(price) over w as low from {_TE} window w as (partition by symbol, cast(ts as date) order by ts, event_id rows unbounded preceding))", ["symbol", "day", "event_id"], ["volume", "amount", "vwap", "high", "low"])
_add("missing_keys", lambda s, d: stores.missing_keys(panels.table(s, d, "customer").select(F.col("c_custkey").alias("k")), panels.table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), ["k"]), "(select c_custkey as k from customer except select o_custkey from orders where o_totalprice > 300000)", ["k"], [])
_add("wide_panel", lambda s, d: panels.weekly(s, d).withColumn("k", F.col("symbol") % 5).groupBy("td").pivot("k", [0, 1, 2, 3, 4]).agg(F.max_by("close", "symbol")).select("td", *[F.col(str(k)).alias(f"s{k}") for k in range(5)]), f"(select td, {', '.join(f'arg_max(close, symbol) filter (symbol % 5 = {k}) as s{k}' for k in range(5))} from {_BARS} group by td)", ["td"], [f"s{k}" for k in range(5)])
_add("quantiles_and_counts", lambda s, d: panels.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.expr("percentile_disc(0.5) within group (order by l_extendedprice)").alias("exact"), F.count_distinct("l_suppkey").alias("suppliers"), F.expr("percentile(l_quantity, 0.25)").alias("low")), "(select l_returnflag, quantile_disc(l_extendedprice, 0.5) as exact, count(distinct l_suppkey) as suppliers, quantile_cont(l_quantity, 0.25) as low from lineitem group by 1)", ["l_returnflag", "suppliers"], ["exact", "low"])
_add("monthly_rollup", lambda s, d: panels.table(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").cast("string").alias("month"), F.quarter("o_orderdate").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last")), "(select cast(cast(date_trunc('month', o_orderdate) as date) as varchar) as month, quarter(o_orderdate) as q, count(*) as n, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as last from orders group by 1, 2)", ["month", "q", "n"], ["last"])
_add("text_and_maps", lambda s, d: panels.table(s, d, "events").select("event_id", F.rpad(F.upper(F.substring("event_type", 1, 3)), 6, ".").alias("code"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("padded"), F.element_at(F.create_map(*[F.lit(x) for x in ("view", 1, "click", 2, "purchase", 3)]), F.col("event_type")).alias("level"), F.get_json_object("props", "$.k").alias("prop"), F.substring(F.sha2(F.col("props"), 256), 1, 12).alias("mark")), "(select event_id, rpad(upper(substring(event_type, 1, 3)), 6, '.') as code, lpad(cast(user_id as varchar), 6, '0') as padded, case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 end as level, json_extract_string(props, '$.k') as prop, substring(sha256(props), 1, 12) as mark from events)", ["event_id", "code", "padded", "level", "prop", "mark"], [])
