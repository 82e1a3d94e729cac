"""Queries of book dynamics and of trade sizes on lagged scales, with SQL written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .operators import book_dynamics as dyn
from .operators import size_grids as grids
from .queries_panel import _add
from .sources import panels

# Book dynamics: events as books of ten levels a half apart ------------------------------------

_HALVES = ((0, 43_200), (43_200, 86_400))


def event_books(s: SparkSession, d: str) -> DataFrame:
    """Every event as a book of its type, with the day's trading so far."""
    e = panels.table(s, d, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").cast("string").alias("day"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    steps = F.sequence(F.lit(1), F.lit(10))
    price = lambda sign: F.transform(steps, lambda i: 100 + F.col("seq") % 5 + sign * i * 0.5)
    size = lambda k: F.transform(steps, lambda i: (F.col("seq") + k * i) % 4)
    run = W.Window.partitionBy("symbol", "day").orderBy("at", "seq").rowsBetween(W.Window.unboundedPreceding, 0)
    volume = (1 + F.col("seq") % 7).cast("double")
    return e.select("*", price(-1).alias("bid_price"), size(3).alias("bid_volume"), price(1).alias("ask_price"), size(1).alias("ask_volume"), F.sum(volume).over(run).alias("acc_volume"), F.sum(volume * (100 + F.col("seq") % 11 * 0.5)).over(run).alias("acc_amount"))


def event_dynamics(s: SparkSession, d: str) -> DataFrame:
    return dyn.with_dynamics(dyn.on_grid(dyn.valid_books(event_books(s, d)), 600, 6, _HALVES))


_DYNAMICS = """(with b as (select event_type as symbol, cast(cast(ts as date) as varchar) as day, event_id, ts, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 600 as own, 100e0 + event_id % 5 as mid,
  sum(1e0 + event_id % 7) over r as acc_volume, sum((1e0 + event_id % 7) * (100 + event_id % 11 * 0.5e0)) over r as acc_amount from events
  window r as (partition by event_type, cast(ts as date) order by ts, event_id rows between unbounded preceding and current row)),
 g as (select *, lead(own) over (partition by symbol, day, own // 72 order by ts, event_id) as nxt from b),
 f as (select *, unnest(range(own, least(coalesce(nxt, (own // 72 + 1) * 72), own + 7))) as slot from g where nxt is null or nxt > own),
 q as (select *, row_number() over (partition by symbol, day order by slot) as n, (event_id + 3) % 4 as bq, (event_id + 1) % 4 as aq, mid - 0.5 as bp, mid + 0.5 as ap from f),
 l as (select symbol, day, n, i, mid - i * 0.5e0 as price, (event_id + 3 * i) % 4 as bv, mid + i * 0.5e0 as offer, (event_id + i) % 4 as av from q, range(1, 11) as t(i)),
 s as (select symbol, day, n, sum(case when bv + av > 0 then (11 - i) * (bv - av) / (bv + av)::double end) / nullif(sum(case when bv + av > 0 then 11 - i end), 0) as soir_raw, (sum(price * bv) + sum(offer * av)) / nullif(sum(bv + av), 0) as infer_raw from l group by symbol, day, n),
 x as (select coalesce(a.symbol, z.symbol) as symbol, coalesce(a.day, z.day) as day, coalesce(a.n, z.n) as n, coalesce(a.price, z.price) as price, coalesce(a.bv, 0) - coalesce(z.bv, 0) as moved
   from l a full join (select symbol, day, n + 1 as n, price, bv from l) z on z.symbol = a.symbol and z.day = a.day and z.n = a.n and z.price = a.price),
 y as (select q.symbol, q.day, q.n, sum(x.price * moved) filter (x.price >= greatest(q.mid - 5, coalesce(p.mid, 5) - 5) and x.price <= greatest(q.bp, coalesce(p.bp, 0))) as ladder_amount
   from q left join q p on p.symbol = q.symbol and p.day = q.day and p.n = q.n - 1 join x on x.symbol = q.symbol and x.day = q.day and x.n = q.n group by q.symbol, q.day, q.n),
 a as (select q.*, coalesce(soir_raw, last_value(soir_raw ignore nulls) over w, 0) as soir, last_value(infer_raw ignore nulls) over w as infer_price, coalesce(ladder_amount, 0) as ladder_amount, ln(ap) - ln(bp) as log_spread,
   last_value(case when bq > 0 and aq > 0 then ln(aq) - ln(bq) end ignore nulls) over w as ratio, lag(bp) over o as pbp, lag(ap) over o as pap, lag(bq) over o as pbq, lag(aq) over o as paq,
   (acc_amount - lag(acc_amount) over o) / nullif(acc_volume - lag(acc_volume) over o, 0) as trade_price
   from q join s on s.symbol = q.symbol and s.day = q.day and s.n = q.n join y on y.symbol = q.symbol and y.day = q.day and y.n = q.n
   window o as (partition by q.symbol, q.day order by q.n), w as (partition by q.symbol, q.day order by q.n rows between unbounded preceding and current row)),
 c as (select *, case when bp > pbp then bq when bp < pbp then -pbq else bq - pbq end as bid_change, case when ap > pap then paq when ap < pap then aq else aq - paq end as ask_change, lag(soir) over (partition by symbol, day order by n) as psoir from a),
 m as (select *, (bid_change - ask_change) / nullif(abs(bid_change) + abs(ask_change), 0)::double * trade_price as flow from c),
 k as (select m.symbol, m.day, m.n, coalesce(avg(z.ratio) filter (z.n > m.n - 20), 0) as ratio_mean, coalesce(sum(z.flow) filter (z.n > m.n - 20) / nullif(sum(z.trade_price) filter (z.n > m.n - 20), 0), 0) as net_buy_quote_ratio,
   sum(z.ladder_amount) filter (z.n > m.n - 20) as level10_diff_buy, avg(z.psoir) filter (z.n > m.n - 19) as soir_mean, stddev_pop(z.psoir) filter (z.n > m.n - 19) as soir_sd,
   case when count(z.infer_price) = 60 then coalesce((avg(z.n * z.infer_price) - avg(z.n) * avg(z.infer_price)) / nullif(avg(z.n * z.n) - avg(z.n) * avg(z.n), 0), 0) else 0 end as slope
   from m join m z on z.symbol = m.symbol and z.day = m.day and z.n between m.n - 59 and m.n group by m.symbol, m.day, m.n),
 v as (select m.*, ratio_mean, net_buy_quote_ratio, level10_diff_buy, slope, case when soir_sd >= 1e-7 then (soir - soir_mean) / soir_sd end as z from m join k on k.symbol = m.symbol and k.day = m.day and k.n = m.n)
 select symbol, day, slot, slot - own as age, bid_change, ask_change, trade_price, ladder_amount, case when abs(ratio_mean) >= 1e-9 then log_spread / ratio_mean end as time_weighted_order_slope, net_buy_quote_ratio, level10_diff_buy,
   coalesce(last_value(z ignore nulls) over (partition by symbol, day order by n rows between unbounded preceding and current row), 0) as wavg_soir, avg(slope) over (partition by symbol, day order by n rows between 19 preceding and current row) as level10_infer_price_trend from v)"""
_add("book_dynamics", event_dynamics, _DYNAMICS, ["symbol", "day", "slot", "age"], ["bid_change", "ask_change", "trade_price", "ladder_amount", *dyn.FACTORS])
_DAILY = [f"{f}_mean" for f in dyn.FACTORS]
_COUNTS = ["snapshots", "buckets", *[f"{f}_{k}" for f in dyn.FACTORS for k in ("valid", "nulls", "clips")]]
_BY_DAY = (
    f"(with r as (select *, slot // 6 as hour from {_DYNAMICS}), l as (select symbol, day, hour, count(*) as n, "
    + ", ".join(f"arg_max_null({f}, slot) as {f}, count(*) filter ({f} is null) as {f}_n, count(*) filter (abs({f}) > 1e6) as {f}_c" for f in dyn.FACTORS)
    + " from r group by symbol, day, hour) select symbol, day, sum(n)::bigint as snapshots, count(*) as buckets, "
    + ", ".join(f"avg({f}) as {f}_mean, count({f}) as {f}_valid, sum({f}_n)::bigint as {f}_nulls, sum({f}_c)::bigint as {f}_clips" for f in dyn.FACTORS)
    + " from l group by symbol, day)"
)
_add("book_dynamics_daily", lambda s, d: dyn.by_day(event_dynamics(s, d), F.floor(F.col("slot") / 6)), _BY_DAY, ["symbol", "day", *_COUNTS], _DAILY)

# Trade sizes on lagged scales -----------------------------------------------------------------

_BANDS = {"adv_lower": (200.0, 400.0, 600.0), "adv_upper": (800.0, 1000.0, 1500.0), "fixed": (20_000.0, 60_000.0)}


def line_trades(s: SparkSession, d: str) -> DataFrame:
    """Order lines as trades of ten groups of suppliers by week."""
    at = F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / 7).cast("int")
    return panels.table(s, d, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("symbol"), at.alias("td"), F.col("l_extendedprice").alias("amount"))


def size_shares(s: SparkSession, d: str) -> DataFrame:
    trades = grids.checked(line_trades(s, d))
    return grids.amount_shares(trades, grids.daily_scales(trades), grids.bands(**_BANDS))


_ENDS = [("a1", "adv", 1e-4, a, b) for a in _BANDS["adv_lower"] for b in _BANDS["adv_upper"]] + [("a2", "ats", 1.0, a, b) for a in grids.ATS_LOWER for b in grids.ATS_UPPER]
_NAMES = [f"{p}_{a:g}_{b:g}".replace(".", "p") for p, _, _, a, b in _ENDS]
_SHARES = (
    "(with t as (select cast(l_suppkey % 10 as int) as symbol, cast(floor(datediff('day', date '1992-01-01', cast(l_shipdate as date)) / 7) as int) as td, l_extendedprice as amount from lineitem where l_extendedprice > 0),"
    " s as (select symbol, td, sum(amount) as total, count(*) as trades, quantile_cont(amount, 0.2) as q20, quantile_cont(amount, 0.5) as mid, quantile_cont(amount, 0.8) as q80 from t group by symbol, td),"
    " h as (select s.symbol, s.td, count(p.total) as history, max(p.td) as latest, case when count(p.total) = 20 then avg(p.total) end as adv, case when count(p.total) = 20 then median(p.total) end as adv_median, case when count(p.total) = 20 then median(p.mid) end as ats"
    " from s left join s p on p.symbol = s.symbol and p.td between s.td - 20 and s.td - 1 group by s.symbol, s.td)"
    " select t.symbol, t.td, max(s.trades) as trades, max(history) as history, max(latest) as latest, max(total) as total, max(q20) as q20, max(mid) as median, max(q80) as q80, max(adv) as adv, max(adv_median) as adv_median, max(ats) as ats,"
    " sum(case when amount > 20000 and amount <= 60000 then amount else 0 end) / max(total) as a0, sum(case when amount > q20 and amount <= q80 then amount else 0 end) / max(total) as a3, "
    + ", ".join(f"case when max({c}) is not null then sum(case when amount > {c} * {a * u!r}::double and amount <= {c} * {b * u!r}::double then amount else 0 end) / max(total) end as {n}" for n, (_, c, u, a, b) in zip(_NAMES, _ENDS, strict=True))
    + " from t join s on s.symbol = t.symbol and s.td = t.td join h on h.symbol = t.symbol and h.td = t.td group by t.symbol, t.td)"
)
_add("size_shares", size_shares, _SHARES, ["symbol", "td", "trades", "history", "latest"], ["total", "q20", "median", "q80", "adv", "adv_median", "ats", "a0", *_NAMES, "a3"])
