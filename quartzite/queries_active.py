"""Queries of active trading, cancelled orders and composites, with SQL written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .operators import active_trading as act
from .operators import cancels
from .operators import composites as comp
from .plans.lineage import stored
from .queries_panel import _IP, _add, industry_panel
from .sources import panels

_D = ["symbol", "td"]

# Active trading: order lines as bars, a day of 28 slots --------------------------------------------


def line_bars(s: SparkSession, d: str) -> DataFrame:
    """symbol (supplier), td, slot, amounts, counts, price and return within the day; lines that came back are sales."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    buy = F.col("l_returnflag") != "R"
    l = panels.table(s, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("symbol"), F.floor(day / 28).cast("int").alias("td"), (day % 28).alias("slot"), "l_extendedprice", "l_quantity", buy.alias("buy"))  # noqa: E741
    of = lambda on: F.round(F.coalesce(F.sum(F.when(on, F.col("l_extendedprice"))), F.lit(0.0)), 2)
    b = l.groupBy("symbol", "td", "slot").agg(of(F.lit(True)).alias("amount"), of(F.col("buy")).alias("buy_amount"), of(~F.col("buy")).alias("sell_amount"), F.count_if("buy").alias("buys"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    back = F.lag("price").over(W.Window.partitionBy("symbol", "td").orderBy("slot"))
    return b.withColumns({"avg_buy": F.col("buy_amount") / F.nullif(F.col("buys"), F.lit(0)), "ret": F.col("price") / back - 1})


_LB = """(with l as (select cast(l_suppkey as int) as symbol, cast(floor(datediff('day', date '1992-01-01', cast(l_shipdate as date)) / 28) as int) as td, datediff('day', date '1992-01-01', cast(l_shipdate as date)) % 28 as slot, l_extendedprice as a, l_quantity as q, l_returnflag <> 'R' as buy from lineitem),
 b as (select symbol, td, slot, round(sum(a), 2) as amount, round(coalesce(sum(a) filter (buy), 0), 2) as buy_amount, round(coalesce(sum(a) filter (not buy), 0), 2) as sell_amount, count(*) filter (buy) as buys, sum(a) / sum(q) as price from l group by symbol, td, slot)
 select *, buy_amount / nullif(buys, 0) as avg_buy, price / lag(price) over (partition by symbol, td order by slot) - 1 as ret from b)"""

_PRESSURE = f"""(with b as (select *, (buy_amount - sell_amount) / nullif(buy_amount + sell_amount, 0) as p from {_LB}), s as (select symbol, td, avg(avg_buy) as m from b group by symbol, td),
 u as (select s.symbol, s.td, case when count(x.m) >= 3 then avg(x.m) end as usual from s left join s x on x.symbol = s.symbol and x.td between s.td - 6 and s.td - 1 group by s.symbol, s.td),
 d as (select b.symbol, b.td, case when count(p) >= 2 then avg(p) end as pressure, case when count(p) >= 2 then sum((1 + slot / 28e0) * amount * p) / nullif(sum((1 + slot / 28e0) * amount) filter (p is not null), 0) end as session_pressure,
  case when count(p) filter (avg_buy > usual * 1.2e0) >= 2 then sum(amount * p) filter (avg_buy > usual * 1.2e0) / nullif(sum(amount) filter (avg_buy > usual * 1.2e0 and p is not null), 0) end as smart_pressure, count(p) filter (avg_buy > usual * 1.2e0) as smart_bars
  from b join u on u.symbol = b.symbol and u.td = b.td group by b.symbol, b.td)
 select d.*, d.pressure - e.pressure as change from d left join d e on e.symbol = d.symbol and e.td = d.td - 2)"""
_add("active_pressure", lambda s, d: act.pressure_change(act.daily_pressure(line_bars(s, d), 1 + F.col("slot") / 28.0, 1.2, 6, 3, 2), "pressure", "change", 2), _PRESSURE, [*_D, "smart_bars"], ["pressure", "session_pressure", "smart_pressure", "change"])
_CONC = f"""(with b as {_LB}, k as (select symbol, td, quantile_cont(avg_buy, 0.8) as bound from b where buy_amount > 0 and avg_buy > 0 group by symbol, td),
 m as (select b.symbol, b.td, sum(case when avg_buy >= bound then buy_amount else 0 end) / sum(buy_amount) as concentration, count(*) filter (avg_buy >= bound) as big_bars from b join k on k.symbol = b.symbol and k.td = b.td where buy_amount > 0 and avg_buy > 0 group by b.symbol, b.td)
 select a.symbol, a.td, concentration, big_bars from (select distinct symbol, td from b) a left join m on m.symbol = a.symbol and m.td = a.td)"""
_add("size_concentration", lambda s, d: act.size_concentration(line_bars(s, d)), _CONC, [*_D, "big_bars"], ["concentration"])
_LATE = f"(select symbol, td, 3 as slot, lag(x) over (partition by symbol order by td) as value from (select symbol, td, sum(buy_amount) filter (slot >= 21) / nullif(sum(buy_amount + sell_amount) filter (slot >= 21), 0) as x from {_LB} group by symbol, td))"
_add("late_session_strength", lambda s, d: act.late_strength(line_bars(s, d), F.col("slot") >= 21, 3), _LATE, [*_D, "slot"], ["value"])
_add("panel_stamped", lambda s, d: act.stamped(act.size_concentration(line_bars(s, d)), "concentration", 14, -1.0), f"(select symbol, td, 14 as slot, -lag(concentration) over (partition by symbol order by td) as value from {_CONC})", [*_D, "slot"], ["value"])


def timing(s: SparkSession, d: str) -> DataFrame:
    bars = line_bars(s, d)
    size = bars.groupBy(*_D).agg(F.log(F.sum("amount")).alias("size"))
    return act.timing_innovation(act.timing_centres(bars, "ret").join(size, _D), ["size"], 6, 8)


def _line_residual(source: str, y: str, x: str) -> str:
    """SQL of the residual of y on one control, date by date."""
    return f"(with q as (select *, count(*) over (partition by td) as n from {source} where {y} is not null and {x} is not null), c as (select td, regr_slope({y}, {x}) as b, regr_intercept({y}, {x}) as a, sum(power({x} - m, 2)) as v from (select *, avg({x}) over (partition by td) as m from q) group by td) select q.symbol, q.td, case when n >= 8 and v > 1e-18 then {y} - a - b * {x} end as r from q join c on c.td = q.td)"


_CENTRES = f"(select symbol, td, sum(slot * greatest(ret, 0)) / nullif(sum(greatest(ret, 0)), 0) as up, sum(slot * greatest(-ret, 0)) / nullif(sum(greatest(-ret, 0)), 0) as down, ln(sum(amount)) as size from {_LB} group by symbol, td)"
_TIMING = f"""(with c as {_CENTRES}, u as {_line_residual('c', 'up', 'size')}, w as {_line_residual('c', 'down', 'size')}, b as (select u.symbol, u.td, u.r as ru, w.r as rd from u join w on w.symbol = u.symbol and w.td = u.td), i as {_line_residual('b', 'rd', 'ru')},
 p as (select c.symbol, c.td, i.r as innovation from c left join i on i.symbol = c.symbol and i.td = c.td)
 select symbol, td, innovation, case when count(innovation) over q >= 6 then avg(innovation) over q end as timing from p window q as (partition by symbol order by td range between 5 preceding and current row))"""
_add("timing_chain", timing, _TIMING, _D, ["innovation", "timing"])


def session_legs(s: SparkSession, d: str) -> DataFrame:
    b = panels.weekly(s, d)
    before = F.max("close").over(W.Window.partitionBy("symbol").orderBy("td").rangeBetween(-1, -1))
    b = b.select(*_D, (F.col("open") / before - 1).alias("r_on"), (F.col("close") / F.col("open") - 1).alias("r_pm"))
    date = W.Window.partitionBy("td")
    return act.session_t(b.withColumns({"index_on": F.avg("r_on").over(date), "index_day": F.avg("r_pm").over(date)}), 20, 10)


_SESSION = f"""(with b as (select x.symbol, x.td, x.open / y.close - 1 as r_on, x.close / x.open - 1 as r_pm from {panels.weekly_sql('check')} x left join {panels.weekly_sql('check')} y on y.symbol = x.symbol and y.td = x.td - 1),
 m as (select td, avg(r_on) as i, avg(r_pm) as j from b group by td), e as (select b.symbol, b.td, r_on - i - r_pm + j as delta from b join m on m.td = b.td)
 select symbol, td, delta, case when count(delta) over w >= 10 and stddev_samp(delta) over w > 1e-12 then avg(delta) over w / (stddev_samp(delta) over w / sqrt(count(delta) over w)) end as t from e window w as (partition by symbol order by td range between 19 preceding and current row))"""
_add("session_residual_t", session_legs, _SESSION, _D, ["delta", "t"])

# Cancelled orders: three events a message group --------------------------------------------------


def messages(s: SparkSession, d: str) -> DataFrame:
    """Events as orders, cancels and trades of twenty symbols; an order in four has no price, one in thirteen is missing."""
    no = F.floor(F.col("event_id") / 3)
    kind = F.when(F.col("event_id") % 3 == 0, F.when(no % 13 == 0, "lost").otherwise("order")).when(F.col("event_id") % 3 == 1, "cancel").otherwise("trade")
    price = F.when((kind == "order") & (no % 4 == 0), 0.0).otherwise(100 + no % 11 * 0.5)
    return panels.table(s, d, "events").select((no % 20).alias("symbol"), F.to_date("ts").cast("string").alias("day"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), no.alias("order_no"), F.when(no % 2 == 0, 1).otherwise(-1).alias("side"), price.alias("price"), (1 + F.col("event_id") % 7).cast("double").alias("volume"))


_MSG = """(select event_id // 3 % 20 as symbol, cast(cast(ts as date) as varchar) as day, ts as moment, event_id, case event_id % 3 when 0 then case when event_id // 3 % 13 = 0 then 'lost' else 'order' end when 1 then 'cancel' else 'trade' end as kind, event_id // 3 as no, event_id // 3 % 2 = 0 as buys,
 case when event_id % 3 = 0 and event_id // 3 % 13 <> 0 and event_id // 3 % 4 = 0 then 0e0 else 100 + event_id // 3 % 11 * 0.5e0 end as price, 1e0 + event_id % 7 as volume, hour(ts) between 2 and 21 as live from events)"""
_CANCELLED = f"""(with m as {_MSG}, k as (select symbol, day, no, coalesce(max(price) filter (kind = 'order'), 0) as price, count(*) filter (kind = 'order') > 0 as known, sum(volume) filter (kind = 'cancel' and live) as volume, count(*) filter (kind = 'cancel' and live) as events, min(moment) filter (kind = 'cancel' and live) as first_at, bool_or(buys) filter (kind = 'cancel' and live) as buys
  from m group by symbol, day, no having count(*) filter (kind = 'cancel' and live) > 0),
 f as (select k.no, k.day, t.price as fill, row_number() over (partition by k.no, k.day order by t.moment desc, t.event_id desc) as pick from k join m t on t.symbol = k.symbol and t.day = k.day and t.kind = 'trade' and t.live and t.price > 0 and t.moment <= k.first_at where k.price = 0),
 c as (select k.*, fill, volume * case when k.price > 0 then k.price else coalesce(fill, 0) end as value from k left join f on f.no = k.no and f.day = k.day and pick = 1),
 s as (select symbol, day, coalesce(sum(value) filter (buys), 0) as buy_value, coalesce(sum(value) filter (not buys), 0) as sell_value, coalesce(sum(volume) filter (buys), 0) as buy_volume, coalesce(sum(volume) filter (not buys), 0) as sell_volume, coalesce(sum(events) filter (buys), 0)::bigint as buy_events, coalesce(sum(events) filter (not buys), 0)::bigint as sell_events,
  count(*) filter (buys) as buy_orders, count(*) filter (not buys) as sell_orders, sum(events)::bigint as events, coalesce(sum(events) filter (known), 0) / sum(events)::double as coverage, coalesce(sum(events) filter (price = 0), 0)::bigint as unpriced_events, count(*) filter (price = 0 and fill is not null) as filled_orders, count(*) filter (not known) + count(*) filter (price = 0 and fill is null) as failures from c group by symbol, day),
 t as (select symbol, day, sum(price * volume) as trade_value, sum(volume) as trade_volume, count(*) as trades from m where kind = 'trade' and live group by symbol, day),
 j as (select s.*, coalesce(trade_value, 0) as trade_value, coalesce(trade_volume, 0) as trade_volume, coalesce(trades, 0) as trades, row_number() over (partition by s.symbol order by s.day) as n from s left join t on t.symbol = s.symbol and t.day = s.day),
 h as (select a.symbol, a.day, avg(b.buy_value + b.sell_value) as usual from j a left join j b on b.symbol = a.symbol and b.n between a.n - 20 and a.n - 1 group by a.symbol, a.day)
 select j.*, buy_value / nullif(trade_value, 0) as buy_intensity, sell_value / nullif(trade_value, 0) as sell_intensity, (buy_value - sell_value) / nullif(buy_value + sell_value, 0) as imbalance, coalesce(buy_value + sell_value > 2 * usual, false) as shock from j join h on h.symbol = j.symbol and h.day = j.day)"""
_add("cancelled_by_day", lambda s, d: cancels.by_symbol_day(messages(s, d), F.hour("at").between(2, 21)), _CANCELLED,
     ["symbol", "day", "buy_events", "sell_events", "buy_orders", "sell_orders", "events", "unpriced_events", "filled_orders", "failures", "trades", "shock"], ["buy_value", "sell_value", "buy_volume", "sell_volume", "coverage", "trade_value", "trade_volume", "buy_intensity", "sell_intensity", "imbalance"])

# Composites -----------------------------------------------------------------------------------

_FEATS = ["signal", "log_amount", "size"]


def _rank(x: str, use: str = "true") -> str:
    return f"(rank() over (partition by td order by {x}) + (count(*) over (partition by td, {x}) - 1) / 2e0)"


_ICS = "(" + " union all ".join(f"select d.td, '{f}' as feature, ic from (select distinct td from {_IP}) d left join (select td, case when count(*) >= 5 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end as ic from (select td, {_rank(f)} as a, {_rank('fwd')} as b from {_IP} where {f} is not null and fwd is not null) group by td) r on r.td = d.td" for f in _FEATS) + ")"
_WEIGHTS = f"""(with i as (select *, dense_rank() over (order by td) as n from {_ICS}), m as (select a.td, a.feature, case when count(b.ic) >= 12 and stddev_pop(b.ic) > 1e-12 then avg(b.ic) / stddev_pop(b.ic) end as icir from i a left join i b on b.feature = a.feature and b.n between a.n - 26 and a.n - 1 group by a.td, a.feature)
 select td, feature, icir, case when sum(greatest(coalesce(icir, 0), 0)) over (partition by td) > 0 then greatest(coalesce(icir, 0), 0) / sum(greatest(coalesce(icir, 0), 0)) over (partition by td) else 1e0 / count(*) over (partition by td) end as weight from m)"""


def icir_weights(s: SparkSession, d: str) -> DataFrame:
    return comp.rolling_weights(comp.daily_ics(industry_panel(s, d), _FEATS, "fwd"), 26, 12)


_add("rolling_icir_weights", icir_weights, _WEIGHTS, ["td", "feature"], ["icir", "weight"])
_SCORE = f"""(with w as (select td, {', '.join(f"max(weight) filter (feature = '{f}') as w_{f}" for f in _FEATS)} from {_WEIGHTS} group by td),
 r as (select symbol, td, {', '.join(f"case when {f} is not null then (rank() over (partition by td order by {f} nulls last) + (count(*) over (partition by td, {f}) - 1) / 2e0) / count({f}) over (partition by td) end as r_{f}" for f in _FEATS)} from {_IP})
 select symbol, r.td, ({' + '.join(f'coalesce(w_{f} * r_{f}, 0)' for f in _FEATS)}) / nullif({' + '.join(f'case when r_{f} is not null then w_{f} else 0 end' for f in _FEATS)}, 0) as score from r join w on w.td = r.td)"""
_add("icir_composite", lambda s, d: comp.composite(industry_panel(s, d), _FEATS, icir_weights(s, d)), _SCORE, _D, ["score"])
_FM = f"""(with u as (select * from {_IP} where fwd is not null and signal is not null and size is not null), k as (select td, {_rank('fwd')} as y, {_rank('signal')} as a, {_rank('size')} as b, count(*) over (partition by td) as n from u),
 z as (select td, n, (y - avg(y) over w) / stddev_samp(y) over w as y, (a - avg(a) over w) / nullif(stddev_samp(a) over w, 0) as a, (b - avg(b) over w) / nullif(stddev_samp(b) over w, 0) as b from k where n >= 10 window w as (partition by td)),
 m as (select td, var_pop(a) as saa, var_pop(b) as sbb, covar_pop(a, b) as sab, covar_pop(a, y) as say, covar_pop(b, y) as sby from z group by td having count(a) > 0 and count(b) > 0),
 c as (select td, (say * sbb - sby * sab) / (saa * sbb - sab * sab) as signal, (sby * saa - say * sab) / (saa * sbb - sab * sab) as size from m),
 v as (select td, 'signal' as variable, signal as v from c union all select td, 'size', size from c), e as (select *, v - avg(v) over (partition by variable) as e from v), g as (select *, lag(e, 1) over o as l1, lag(e, 2) over o as l2, lag(e, 3) over o as l3 from e window o as (partition by variable order by td))
 select variable, count(v) as days, avg(v) as mean, avg(v) / (sqrt(sum(e * e) + 2 * (0.75 * coalesce(sum(e * l1), 0) + 0.5 * coalesce(sum(e * l2), 0) + 0.25 * coalesce(sum(e * l3), 0))) / count(v)) as t from g group by variable)"""
_add("fama_macbeth", lambda s, d: comp.fama_macbeth(industry_panel(s, d), "fwd", ["signal", "size"], 3).where("variable <> 'intercept'"), _FM, ["variable", "days"], ["mean", "t"])


def memberships(s: SparkSession, d: str) -> DataFrame:
    """Pools of customers as intervals of weeks, two or more of a start among them; one in nine is open."""
    o = panels.table(s, d, "orders")
    start = F.floor(F.datediff("o_orderdate", F.lit("1992-01-01")) / 28).cast("int")
    end = F.when(F.col("o_orderkey") % 9 != 0, start + (F.col("o_orderkey") % 5).cast("int"))
    return o.select((F.col("o_custkey") % 50).cast("int").alias("symbol"), start.alias("start"), end.alias("end"), F.col("o_orderpriority").alias("pool"))


_MEMBERS = """(with i as (select cast(o_custkey % 50 as int) as symbol, cast(floor(datediff('day', date '1992-01-01', cast(o_orderdate as date)) / 28) as int) as f, o_orderkey, o_orderpriority as pool from orders),
 j as (select symbol, f, case when o_orderkey % 9 <> 0 then f + o_orderkey % 5 end as t, pool from i), k as (select *, row_number() over (partition by symbol, f order by t desc nulls first, pool desc) as r from j),
 d as (select distinct f as td from i where f % 2 = 0), h as (select k.symbol, d.td, k.pool, row_number() over (partition by k.symbol, d.td order by f desc) as pick from k join d on d.td >= k.f and (k.t is null or d.td <= k.t) where r = 1)
 select symbol, td, pool from h where pick = 1)"""
_add("interval_panel", lambda s, d: comp.interval_panel(memberships(s, d), memberships(s, d).where("start % 2 = 0").select(F.col("start").alias("td")).distinct(), "pool"), _MEMBERS, ["symbol", "td", "pool"], [])


def quantile_errors(s: SparkSession, d: str) -> DataFrame:
    """Whether approximate quantiles of prices by shipping mode keep their bound: the ranks of each value's rows against the rank asked for."""
    l = panels.table(s, d, "lineitem").select("l_returnflag", "l_extendedprice")  # noqa: E741
    probs, accuracy = [0.1, 0.5, 0.9], 200
    q = comp.approximate_quantiles(l, ["l_returnflag"], "l_extendedprice", probs, accuracy)
    j = l.join(F.broadcast(q), "l_returnflag")  # a row a flag
    counts = [c for k in range(len(probs)) for c in (F.count_if(F.col("l_extendedprice") < F.col("quantiles")[k]).alias(f"b{k}"), F.count_if(F.col("l_extendedprice") <= F.col("quantiles")[k]).alias(f"u{k}"))]
    within = lambda k, p: ((F.col(f"b{k}") <= p * F.col("n") + F.col("n") / accuracy + 1) & (F.col(f"u{k}") >= p * F.col("n") - F.col("n") / accuracy - 1)).alias(f"within_{k}")
    return j.groupBy("l_returnflag", "n").agg(*counts).select("l_returnflag", "n", *[within(k, p) for k, p in enumerate(probs)])


_add("approximate_quantiles", quantile_errors, "(select l_returnflag, count(*) as n, true as within_0, true as within_1, true as within_2 from lineitem group by 1)", ["l_returnflag", "n", "within_0", "within_1", "within_2"], [])


def reports(s: SparkSession, d: str) -> DataFrame:
    """Quarters of suppliers as reports, made known 30 to 59 days after the quarter, some twice."""
    l = panels.table(s, d, "lineitem").withColumn("period", F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / 91).cast("int"))  # noqa: E741
    q = l.groupBy(F.col("l_suppkey").cast("int").alias("symbol"), "period").agg((F.sum("l_extendedprice") / 1000 - F.sum("l_quantity")).alias("profit"), (F.sum("l_extendedprice") / 500 - 100).alias("equity"), (F.sum(F.col("l_extendedprice") * F.col("l_discount")) / 10).alias("gross"), (F.sum("l_extendedprice") / 300).alias("assets"), (F.sum("l_tax") * 100).alias("cash"))
    first = q.withColumn("known", (F.col("period") + 1) * 91 + 30 + F.col("symbol") % 30)
    return first.union(first.where("(symbol + period) % 7 = 0").withColumns({"profit": F.col("profit") * 1.1, "known": F.col("known") + 20}).select(*first.columns))


def report_days(s: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / 28).cast("int") * 28
    return panels.table(s, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("symbol"), day.alias("td")).distinct()


_MADE = ["roe", "roe_stability", "gross_profitability", "cfo_quality"]
_QUALITY = f"""(with q as (select cast(l_suppkey as int) as symbol, cast(floor(datediff('day', date '1992-01-01', cast(l_shipdate as date)) / 91) as int) as period, sum(l_extendedprice) / 1000 - sum(l_quantity) as profit, sum(l_extendedprice) / 500 - 100 as equity, sum(l_extendedprice * l_discount) / 10 as gross, sum(l_extendedprice) / 300 as assets, sum(l_tax) * 100 as cash from lineitem group by 1, 2),
 f as (select symbol, period, profit * case when (symbol + period) % 7 = 0 then 1.1e0 else 1 end as profit, equity, gross, assets, cash, (period + 1) * 91 + 30 + symbol % 30 + case when (symbol + period) % 7 = 0 then 20 else 0 end as known from q),
 r as (select *, profit / case when equity > 0 then equity end as roe, gross / case when assets > 0 then assets end as gross_profitability, (cash - profit) / case when assets > 0 then assets end as cfo_quality from f),
 v as (select *, case when count(roe) over w >= 4 then -stddev_samp(roe) over w end as roe_stability from r window w as (partition by symbol order by period rows between 7 preceding and current row)),
 d as (select distinct cast(l_suppkey as int) as symbol, cast(floor(datediff('day', date '1992-01-01', cast(l_shipdate as date)) / 28) as int) * 28 as td from lineitem),
 a as (select d.symbol, d.td, v.period, {', '.join(f'v.{m}' for m in _MADE)}, row_number() over (partition by d.symbol, d.td order by v.known desc, v.period desc) as pick from d left join v on v.symbol = d.symbol and v.known <= d.td),
 k as (select *, {', '.join(f'case when {m} is not null then (rank() over (partition by td order by {m} nulls last) + (count(*) over (partition by td, {m}) - 1) / 2e0) / count({m}) over (partition by td) end as r_{m}' for m in _MADE)} from a where pick = 1)
 select symbol, td, period, {', '.join(_MADE)}, ({' + '.join(f'coalesce(r_{m}, 0)' for m in _MADE)}) / nullif({' + '.join(f'case when r_{m} is null then 0 else 1 end' for m in _MADE)}, 0) as composite from k)"""
_add("quality_factors", lambda s, d: comp.quality(reports(s, d), report_days(s, d)), _QUALITY, [*_D, "period"], [*_MADE, "composite"])


def drivers(s: SparkSession, d: str) -> DataFrame:
    """Features of the industry panel as drivers of returns, with the clusters of their correlations and the order in which they add variance."""
    from .operators import selection

    panel = industry_panel(s, d).withColumn("signal_lag", F.lag("signal").over(W.Window.partitionBy("symbol").orderBy("td")))
    names = [*_FEATS, "volume", "amount", "signal_lag"]
    panel = stored(panel.select("symbol", "td", "fwd", *names))  # for all passes below
    found = comp.orthogonal_drivers(panel, names, "fwd", 0.003, lambda df: df)
    pairs = [(r["a"], r["b"], r["r"]) for r in selection.correlations(panel, names).collect()]  # a row a pair of features
    cluster, order = comp.correlation_clusters(pairs, names, 0.6), dict(comp.variance_order(panel, names))
    return s.createDataFrame([(n, ic, left, ok, cluster[n], order.get(n)) for n, ic, left, ok in found], "feature string, ic double, ic_left double, driver boolean, cluster string, variance_left double")


_add("orthogonal_drivers", drivers, None, ["feature", "driver", "cluster"], ["ic", "ic_left", "variance_left"])
