"""Queries of cuts by name, with SQL written apart from the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .operators import cut_recipes as cr
from .queries_panel import _add
from .sources import panels

#: Half-hour slots of a day in place of minutes.
_SEGMENTS = {"open": (0, 6), "morning": (6, 20), "afternoon": (24, 36), "close": (36, 47), "common_close": (36, 46), "full": (0, 47), "early_close": (36, 42), "late_close": (42, 47), "close_auction": (47, 48)}
_SESSIONS = ((0, 24), (24, 47))
_CLASSES = {"flow": "flow", "amount": "amount", "large": "amount", "return": "level"}
NAMES = [
    "flow__time_open__sum", "flow__time_full__temporal_center", "flow__time_full__tc_plus", "flow__time_full__tc_minus", "flow__time_full__temporal_gap", "flow__time_full__temporal_dispersion",
    "flow__time_morning__persistence", "flow__state_high_vol__mean", "flow__state_price_down__sum", "flow__event_extreme__event_share", "flow__contrast_diff_close_vs_open__sum", "flow__contrast_reversal_open_vs_late_close__sum",
    "amount__time_afternoon__median", "amount__time_common_close__std", "amount__state_low_spread__mean", "amount__event_top_q__event_share", "amount__event_shock__sum", "amount__event_liquidity_shock__mean", "amount__contrast_share_close_vs_full__sum", "amount__contrast_normalised_diff_high_depth_vs_low_depth__mean", "amount__time_close_auction__last",
    "large__event_bottom_q__max", "large__state_large_order_dominated__sum", "large__contrast_ratio_price_up_vs_price_down__mean", "large__event_large_trade__event_share",
    "return__time_early_close__slope", "return__state_high_trade_intensity__min", "return__contrast_acceleration_afternoon_vs_morning__mean", "return__contrast_persistence_high_vol_vs_low_vol__persistence",
]


def recipe_bars(s: SparkSession, d: str) -> DataFrame:
    """The event bars with net active flow, returns, a spread (relative range) and a depth (number of trades)."""
    b = panels.query(s, d, f"select * from {panels.bars_sql('spark')}", ["events"])
    back = F.lag("close").over(W.Window.partitionBy("symbol", "day").orderBy("slot"))
    ret = F.col("close") / back - 1
    return b.select("symbol", "day", "slot", "amount", (F.col("buy_amount") - F.col("sell_amount")).alias("flow"), (F.col("large_buy") + F.col("large_sell")).alias("large"), ret.alias("return"), F.abs(ret).alias("abs_return"), ((F.col("high") - F.col("low")) / F.col("close")).alias("spread"), (F.col("buy_count") + F.col("sell_count")).alias("depth"))


def cut_recipes(s: SparkSession, d: str) -> DataFrame:
    accepted = cr.accept(NAMES, _CLASSES)
    if accepted.rejected:
        raise ValueError(f"recipes not accepted: {accepted.rejected}")
    return cr.apply_recipes(recipe_bars(s, d), accepted.recipes, _SEGMENTS, _SESSIONS)


def _in(low: int, high: int) -> str:
    return f"slot >= {low} and slot < {high}"


_SQL = f"""(with b as (select symbol, day, slot, amount, buy_amount - sell_amount as flow, large_buy + large_sell as large, close / lag(close) over (partition by symbol, day order by slot) - 1 as ret, (high - low) / close as spread, buy_count + sell_count as depth, slot = 47 as auction from {panels.bars_sql('check')}),
 m as (select symbol, day, median(abs(ret)) as vol_mid, median(spread) as spread_mid, median(depth) as depth_mid, median(amount) as amount_mid, median(large) as large_mid, quantile_cont(amount, 0.8) as amount_top, quantile_cont(large, 0.8) as large_top, quantile_cont(large, 0.2) as large_low,
  quantile_cont(spread, 0.8) as spread_top, quantile_cont(depth, 0.2) as depth_low, quantile_cont(abs(ret), 0.8) as vol_top, avg(flow) as flow_mean, stddev_pop(flow) as flow_sd, count(flow) as flow_n from b group by symbol, day),
 p as (select x.symbol, x.day, x.slot, count(y.amount) as n, avg(y.amount) as mean, stddev_pop(y.amount) as sd from b x left join b y on y.symbol = x.symbol and y.day = x.day and y.slot < x.slot group by x.symbol, x.day, x.slot),
 k as (select x.symbol, x.day, x.slot, y.flow as flow_before, y.ret as ret_before from b x join b y on y.symbol = x.symbol and y.day = x.day and y.slot = x.slot - 1 and (x.slot < 24) = (y.slot < 24) and x.slot < 47),
 r as (select b.*, m.* exclude (symbol, day), p.n as past_n, p.mean as past_mean, p.sd as past_sd, k.flow_before, k.ret_before, case when abs(k.ret_before) > vol_mid then 1 when abs(k.ret_before) <= vol_mid then 0 end as before_high, case when abs(ret) > vol_mid then 1 when abs(ret) <= vol_mid then 0 end as now_high, not auction and (coalesce(spread >= spread_top, false) or coalesce(depth <= depth_low, false) or coalesce(abs(ret) >= vol_top, false)) as shocked
  from b join m on m.symbol = b.symbol and m.day = b.day join p on p.symbol = b.symbol and p.day = b.day and p.slot = b.slot left join k on k.symbol = b.symbol and k.day = b.day and k.slot = b.slot),
 c as (select symbol, day, sum(flow) filter ({_in(0, 6)}) as flow_open, sum(flow) filter ({_in(36, 47)}) as flow_close, sum(flow) filter ({_in(42, 47)}) as flow_late, sum(slot * abs(flow)) filter ({_in(0, 47)}) / nullif(sum(abs(flow)) filter ({_in(0, 47)}), 0) as centre,
  sum(slot * flow) filter (flow > 0 and slot < 47) / sum(flow) filter (flow > 0 and slot < 47) as plus, sum(slot * flow) filter (flow < 0 and slot < 47) / sum(flow) filter (flow < 0 and slot < 47) as minus,
  count(*) filter (flow * flow_before <> 0 and {_in(7, 20)}) as pairs, count(*) filter (flow * flow_before > 0 and {_in(7, 20)}) as same,
  avg(flow) filter (now_high = 1 and not auction) as fv, count(flow) filter (now_high = 1 and not auction) as fvn, sum(flow) filter (ret < 0 and not auction) as fd, sum(case when flow_n >= 3 and flow_sd > 0 and abs(flow - flow_mean) > 2 * flow_sd and not auction then 1e0 else 0 end) / count(flow) as fx,
  case when count(*) filter ({_in(24, 36)}) >= 3 then median(amount) filter ({_in(24, 36)}) end as am, case when count(*) filter ({_in(36, 46)}) >= 3 then stddev_pop(amount) filter ({_in(36, 46)}) end as asd, case when count(*) filter (spread <= spread_mid and not auction) >= 3 then avg(amount) filter (spread <= spread_mid and not auction) end as asp,
  sum(case when amount >= amount_top and not auction then 1e0 else 0 end) / count(*) as atop, sum(amount) filter (past_n >= 5 and past_sd > 0 and amount > past_mean + 2 * past_sd and not auction) as ashock, case when count(*) filter (shocked) >= 3 then avg(amount) filter (shocked) end as aliq,
  sum(amount) filter ({_in(36, 47)}) as aclose, sum(amount) filter ({_in(0, 47)}) as afull, case when count(*) filter (depth > depth_mid and not auction) >= 3 then avg(amount) filter (depth > depth_mid and not auction) end as adh, case when count(*) filter (depth <= depth_mid and not auction) >= 3 then avg(amount) filter (depth <= depth_mid and not auction) end as adl,
  max(amount) filter (auction) as auc, max(large) filter (large <= large_low and not auction) as lmax, sum(large) filter (large > large_mid and not auction) as lsum, case when count(*) filter (ret > 0 and not auction) >= 3 then avg(large) filter (ret > 0 and not auction) end as lup, case when count(*) filter (ret < 0 and not auction) >= 3 then avg(large) filter (ret < 0 and not auction) end as ldown,
  sum(case when large >= large_top and not auction then 1e0 else 0 end) / count(large) as ltop, case when count(ret) filter ({_in(36, 42)}) >= 3 then regr_slope(ret, slot) filter ({_in(36, 42)} and ret is not null) end as rslope, min(ret) filter (amount > amount_mid and not auction) as rmin,
  case when count(ret) filter ({_in(24, 36)}) >= 3 then avg(ret) filter ({_in(24, 36)}) end as ra, case when count(ret) filter ({_in(6, 20)}) >= 3 then avg(ret) filter ({_in(6, 20)}) end as rm,
  count(*) filter (now_high = 1 and before_high = 1 and ret * ret_before <> 0) as hp, count(*) filter (now_high = 1 and before_high = 1 and ret * ret_before > 0) as hs, count(*) filter (now_high = 0 and before_high = 0 and ret <> 0 and ret_before <> 0) as lp, count(*) filter (now_high = 0 and before_high = 0 and ret <> 0 and ret_before <> 0 and sign(ret) = sign(ret_before)) as ls from r group by symbol, day),
 g as (select r.symbol, r.day, sqrt(sum(power(slot - centre, 2) * abs(flow)) / nullif(sum(abs(flow)), 0)) as spread_of_time from r join c on c.symbol = r.symbol and c.day = r.day where slot < 47 group by r.symbol, r.day)
 select c.symbol, c.day, flow_open as {NAMES[0]}, centre as {NAMES[1]}, plus as {NAMES[2]}, minus as {NAMES[3]}, minus - plus as {NAMES[4]}, spread_of_time as {NAMES[5]}, case when pairs >= 3 then same / pairs::double end as {NAMES[6]}, case when fvn >= 3 then fv end as {NAMES[7]}, fd as {NAMES[8]}, fx as {NAMES[9]}, flow_close - flow_open as {NAMES[10]}, case when flow_open <> 0 then -sign(flow_open) * flow_late end as {NAMES[11]},
  am as {NAMES[12]}, asd as {NAMES[13]}, asp as {NAMES[14]}, atop as {NAMES[15]}, ashock as {NAMES[16]}, aliq as {NAMES[17]}, aclose / afull as {NAMES[18]}, (adh - adl) / (adh + adl) as {NAMES[19]}, auc as {NAMES[20]}, lmax as {NAMES[21]}, lsum as {NAMES[22]}, case when ldown > 1e-12 then lup / ldown end as {NAMES[23]}, ltop as {NAMES[24]},
  rslope as {NAMES[25]}, rmin as {NAMES[26]}, ra - rm as {NAMES[27]}, case when hp >= 3 then hs / hp::double end - case when lp >= 3 then ls / lp::double end as {NAMES[28]} from c join g on g.symbol = c.symbol and g.day = c.day)"""
_add("cut_recipes", cut_recipes, _SQL, ["symbol", "day"], NAMES)
