"""Intraday formulas on bars keyed by (symbol, day, slot), as SQL text.

Windows of bars count rows within (symbol, day) unless they are said to cross days.
"""

from __future__ import annotations

from .windows import safe

DAY = "partition by symbol, day order by slot"


def running(fn: str, x: str) -> str:
    return f"{fn}({x}) over ({DAY} rows between unbounded preceding and current row)"


def last_bars(fn: str, x: str, n: int, least: int = 1) -> str:
    o = f"({DAY} rows between {n - 1} preceding and current row)"
    return f"case when count({x}) over {o} >= {least} then {fn}({x}) over {o} end"


def across(fn: str, x: str, n: int, least: int, after: int = 1) -> str:
    """Over the n earlier bars of the same slot on other days."""
    o = f"(partition by symbol, slot order by day rows between {n - 1 + after} preceding and {after} preceding)"
    return f"case when count({x}) over {o} >= {least} then {fn}({x}) over {o} end"


BAR_BASE = [
    {"prev": f"lag(close) over ({DAY})", "cum_amount": running("sum", "amount"), "cum_volume": running("sum", "volume"), "cum_buy": running("sum", "buy_amount"), "cum_sell": running("sum", "sell_amount"), "first_open": f"first_value(open) over ({DAY})"},
    {"r": "ln(close / nullif(prev, 0))", "cum_vwap": safe("cum_amount", "cum_volume"), "ofi": safe("buy_amount - sell_amount", "buy_amount + sell_amount"), "trade_size": safe("buy_amount", "buy_count")},
    {"r_prev": f"lag(r) over ({DAY})", "ofi_prev": f"lag(ofi) over ({DAY})", "abs_ill": safe("abs(r)", "amount")},
]

BAR_FACTORS = {
    "close_vwap_deviation": "case when prev is not null then (close - cum_vwap) / nullif(cum_vwap, 0) end",
    "active_buy_sell_imbalance": safe("cum_buy - cum_sell", "cum_buy + cum_sell"),
    "bartime_ofi": "ofi",
    "ofi_persistence": last_bars("avg", "ofi", 5, 3),
    "active_buy_shock": f"(buy_amount - ({across('avg', 'buy_amount', 10, 5)})) / nullif(case when ({across('stddev_samp', 'buy_amount', 10, 5)}) > greatest(1e-8 * abs({across('avg', 'buy_amount', 10, 5)}), 1) then {across('stddev_samp', 'buy_amount', 10, 5)} end, 0)",
    "average_active_trade_size": "trade_size",
    "large_active_buy_ratio": safe("large_buy", "buy_amount"),
    "intraday_amihud": f"({last_bars('avg', 'abs_ill', 5, 3)}) * 1e6",
    "realized_volatility": f"case when count(r) over ({DAY} rows between unbounded preceding and current row) >= 5 then sqrt({running('sum', 'r * r')}) end",
    "minute_skew": f"case when {running('count', 'r')} >= 5 and {running('sum', 'r * r')} > 1e-12 then sqrt({running('count', 'r')}) * {running('sum', 'r * r * r')} / power({running('sum', 'r * r')}, 1.5e0) end",
    "front_loading": f"amount / nullif({across('avg', 'amount', 20, 5)}, 0)",
    "back_loading": f"cum_amount / nullif({across('avg', 'cum_amount', 20, 5)}, 0)",
    "morning_reversal_pressure": "case when slot = 20 then close / nullif(first_open, 0) - 1 end",
}

#: Day aggregates of the path of bars; half is the first slot of the second session.
PATH_BASE = [
    *BAR_BASE,
    {
        "peak": running("max", "close"),
        "trough": running("min", "close"),
        "step": "abs(close - prev)",
        "day_amount": "sum(amount) over (partition by symbol, day)",
        "q95": "percentile(abs(r), 0.95e0) over (partition by symbol, day)",
        "bars": "count(*) over (partition by symbol, day)",
        "r5": f"sum(r) over ({DAY} rows between 4 preceding and current row)",
        "n5": f"count(r) over ({DAY} rows between 4 preceding and current row)",
        "seq": f"row_number() over ({DAY})",
    },
]


def guarded_corr(x: str, y: str) -> str:
    """Correlation of the rows that have both; null, not an error, where either is constant."""
    spread = f"(stddev_pop(case when {y} is not null then {x} end) * stddev_pop(case when {x} is not null then {y} end))"
    return f"covar_pop({x}, {y}) / nullif({spread}, 0e0)"


def path_sql(source: str, open_slots: int = 6, half: int = 24, close_slot: int = 42, slots: int = 48) -> str:
    """One row per (symbol, day): returns of parts of the day, realised moments, timing of amount, impact."""
    return f"""(select symbol, day,
      min_by(open, slot) as open_price, max_by(close, slot) as close_price, max(high) as high_price, min(low) as low_price,
      sum(amount) / nullif(sum(volume), 0) as day_vwap, sum(amount) as total_amount,
      ln(max_by(case when slot < {open_slots} then close end, case when slot < {open_slots} then slot end) / min_by(open, slot)) as open_to_30m_return,
      ln(max_by(case when slot < {half} then close end, case when slot < {half} then slot end) / min_by(open, slot)) as morning_return,
      ln(max_by(close, slot) / min_by(case when slot >= {half} then open end, case when slot >= {half} then slot end)) as afternoon_return,
      ln(max_by(close, slot) / min_by(case when slot >= {close_slot} then open end, case when slot >= {close_slot} then slot end)) as closing_30m_return,
      ln(min_by(case when slot >= {half} then open end, case when slot >= {half} then slot end) / max_by(case when slot < {half} then close end, case when slot < {half} then slot end)) as lunch_gap_return,
      abs(max_by(close, slot) - min_by(open, slot)) / nullif(sum(step), 0) as path_efficiency,
      avg(case when r_prev is not null then case when sign(r) = sign(r_prev) then 1e0 else 0e0 end end) as sign_persistence,
      {guarded_corr('r', 'r_prev')} as autocorr1,
      avg(case when n5 = 5 then r5 * r5 end) / nullif(5 * avg(r * r), 0) as variance_ratio_5,
      sqrt(sum(r * r)) as realized_volatility,
      sum(case when r < 0 then r * r else 0 end) / nullif(sum(r * r), 0) as downside_semivariance_share,
      sqrt(count(r)) * sum(r * r * r) / nullif(power(sum(r * r), 1.5e0), 0) as realized_skewness,
      count(r) * sum(r * r * r * r) / nullif(power(sum(r * r), 2), 0) as realized_kurtosis,
      greatest(sum(r * r) - 1.5707963267948966e0 * sum(abs(r) * abs(r_prev)), 0) / nullif(sum(r * r), 0) as jump_share,
      max(abs(r)) as max_abs_return,
      sum(case when abs(r) >= q95 then r * r else 0 end) / nullif(sum(r * r), 0) as tail_return_share,
      max(1 - close / nullif(peak, 0)) as max_drawdown, max(close / nullif(trough, 0) - 1) as max_drawup,
      sum(case when slot < {open_slots} then amount else 0 end) / nullif(sum(amount), 0) as opening_amount_share,
      sum(case when slot >= {close_slot} then amount else 0 end) / nullif(sum(amount), 0) as closing_amount_share,
      sum(case when slot < {half} then amount else -amount end) / nullif(sum(amount), 0) as half_day_imbalance,
      sum(power(amount / nullif(day_amount, 0), 2)) as volume_hhi,
      sum(slot * amount) / nullif({slots - 1} * sum(amount), 0) as amount_time_center,
      {guarded_corr('volume', 'r')} as volume_return_corr, {guarded_corr('volume', 'abs(r)')} as volume_abs_return_corr,
      avg(case when amount > 0 then abs(r) / amount end) * 1e6 as intraday_amihud,
      sum(slot * greatest(r, 0)) / nullif(sum(greatest(r, 0)), 0) as up_center, sum(slot * abs(least(r, 0))) / nullif(sum(abs(least(r, 0))), 0) as down_center,
      sum(r * (buy_amount - sell_amount)) / nullif(sum(abs(buy_amount - sell_amount)), 0) as signed_amount_impact,
      sum(r * sign(buy_amount - sell_amount) * sqrt(abs(buy_amount - sell_amount))) / nullif(sum(sqrt(abs(buy_amount - sell_amount))), 0) as signed_sqrt_impact,
      sum(r * (buy_count - sell_count)) / nullif(sum(abs(buy_count - sell_count)), 0) as impact_per_trade,
      sum(ofi * amount) / nullif(sum(amount), 0) as active_pressure
      from {source} p group by symbol, day)"""


PATH_LAST = [
    {
        "overnight_gap": "ln(open_price / nullif(lag(close_price) over (partition by symbol order by day), 0))",
        "vwap_close_deviation": safe("close_price - day_vwap", "day_vwap"),
        "close_location_value": safe("2 * close_price - high_price - low_price", "high_price - low_price"),
        "return_per_amount": safe("ln(close_price / open_price) * 1e6", "total_amount"),
        "range_per_amount": safe("(high_price - low_price) / open_price * 1e6", "total_amount"),
        "timing_gap": "up_center - down_center",
    }
]
PATH_VALUES = """open_to_30m_return morning_return afternoon_return closing_30m_return lunch_gap_return path_efficiency sign_persistence autocorr1
variance_ratio_5 realized_volatility downside_semivariance_share realized_skewness realized_kurtosis jump_share max_abs_return tail_return_share
max_drawdown max_drawup opening_amount_share closing_amount_share half_day_imbalance volume_hhi amount_time_center volume_return_corr
volume_abs_return_corr intraday_amihud up_center down_center signed_amount_impact signed_sqrt_impact impact_per_trade active_pressure
overnight_gap vwap_close_deviation close_location_value return_per_amount range_per_amount timing_gap""".split()

#: Impact and recovery by forward bars: the next bar and the bar five ahead of the same day.
FORWARD = [
    *BAR_BASE,
    {
        "signed": "buy_amount - sell_amount",
        "mid": "(high + low) / 2",
        "spread": "(high - low) / nullif(close, 0)",
        "depth": "ln(1 + volume)",
        "lead1": f"lead(close, 1) over ({DAY})",
        "lead5": f"lead(close, 5) over ({DAY})",
        "amount_median": "percentile(amount, 0.5e0) over (partition by symbol, day)",
    },
    {"fwd1": "ln(lead1 / close)", "fwd5": "ln(lead5 / close)", "spread5": f"lead(spread, 5) over ({DAY})", "depth5": f"lead(depth, 5) over ({DAY})"},
]


def impact_sql(source: str) -> str:
    """One row per (symbol, day): price impact by side and size, spreads, recovery after heavy bars."""
    return f"""(select symbol, day,
      avg(spread / nullif(ln(1 + depth), 0)) as spread_per_depth, sum(amount) / nullif(avg(depth), 0) as amount_to_depth, avg(depth / (amount + 1)) * 1e3 as depth_per_amount,
      sum(fwd1 * buy_amount) / nullif(sum(case when fwd1 is not null then buy_amount end), 0) as buy_price_impact,
      sum(fwd1 * sell_amount) / nullif(sum(case when fwd1 is not null then sell_amount end), 0) as sell_price_impact,
      avg(2 * sign(signed) * (amount / nullif(volume, 0) - mid) / nullif(mid, 0)) as effective_spread,
      avg(2 * sign(signed) * fwd1) as permanent_impact_1, avg(2 * sign(signed) * fwd5) as permanent_impact_5,
      sum(fwd1 * (large_buy - large_sell)) / nullif(sum(abs(case when fwd1 is not null then large_buy - large_sell end)), 0) as large_trade_impact,
      sum(fwd1 * (signed - large_buy + large_sell)) / nullif(sum(abs(case when fwd1 is not null then signed - large_buy + large_sell end)), 0) as small_trade_impact,
      avg(case when amount > 2 * amount_median then (spread - spread5) / nullif(spread, 0) end) as spread_recovery_5,
      avg(case when amount > 2 * amount_median then (depth5 - depth) / nullif(depth, 0) end) as depth_recovery_5
      from {source} f group by symbol, day)"""


IMPACT_LAST = [
    {
        "impact_asymmetry": "buy_price_impact - sell_price_impact",
        "realized_spread_5": "effective_spread - permanent_impact_5",
        "adverse_selection_ratio": "case when abs(effective_spread) > 1e-12 and abs(permanent_impact_5 / effective_spread) <= 1e6 then permanent_impact_5 / abs(effective_spread) end",
        "impact_convexity": "large_trade_impact - small_trade_impact",
        "impact_decay_5": "permanent_impact_1 - permanent_impact_5",
    }
]
IMPACT_VALUES = """spread_per_depth amount_to_depth depth_per_amount buy_price_impact sell_price_impact effective_spread permanent_impact_1 permanent_impact_5
large_trade_impact small_trade_impact spread_recovery_5 depth_recovery_5 impact_asymmetry realized_spread_5 adverse_selection_ratio impact_convexity impact_decay_5""".split()

#: Shocks against the trailing median of the session and how the state looks h bars later.
RESILIENCE = [
    *FORWARD,
    {
        "trail_median": f"case when count(amount) over ({DAY} rows between 20 preceding and 1 preceding) >= 5 then percentile(amount, 0.5e0) over ({DAY} rows between 20 preceding and 1 preceding) end",
        "depth_before": f"lag(depth) over ({DAY})",
        "spread_before": f"lag(spread) over ({DAY})",
        **{f"depth_{h}": f"lead(depth, {h}) over ({DAY})" for h in (1, 3)},
        **{f"spread_{h}": f"lead(spread, {h}) over ({DAY})" for h in (1, 3)},
        **{f"ofi_{h}": f"lead(ofi, {h}) over ({DAY})" for h in (3, 5)},
    },
    {"buy_shock": "case when buy_amount > 1.5e0 * trail_median then 1 end", "sell_shock": "case when sell_amount > 1.5e0 * trail_median then 1 end", "depth_shock": "case when depth < 0.8e0 * depth_before then 1 end", "spread_shock": "case when spread > 1.5e0 * spread_before then 1 end"},
]


def resilience_sql(source: str) -> str:
    rec = lambda h: f"avg(case when depth_shock = 1 then (depth_{h} - depth) / nullif(depth_before - depth, 0) end) as depth_recovery_{h}, avg(case when spread_shock = 1 then (spread - spread_{h}) / nullif(spread - spread_before, 0) end) as spread_recovery_{h}"
    obi = lambda h: f"avg(case when buy_shock = 1 then ofi - ofi_{h} end) as buy_restoration_{h}, avg(case when sell_shock = 1 then ofi_{h} - ofi end) as sell_restoration_{h}"
    return f"""(select symbol, day, count(buy_shock) as buy_shocks, count(sell_shock) as sell_shocks, count(depth_shock) as depth_shocks, count(spread_shock) as spread_shocks,
      {rec(1)}, {rec(3)}, avg(case when depth_shock = 1 then (depth5 - depth) / nullif(depth_before - depth, 0) end) as depth_recovery_5, avg(case when spread_shock = 1 then spread5 - spread_before end) as spread_residual_5,
      {obi(3)}, {obi(5)} from {source} f group by symbol, day)"""


RESILIENCE_VALUES = """buy_shocks sell_shocks depth_shocks spread_shocks depth_recovery_1 spread_recovery_1 depth_recovery_3 spread_recovery_3 depth_recovery_5 spread_residual_5
buy_restoration_3 sell_restoration_3 buy_restoration_5 sell_restoration_5""".split()
