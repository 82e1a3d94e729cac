"""Order-flow and order-size formulas on symbol-day primitives (SQL text by stage)."""

from __future__ import annotations

from .windows import agg, corr, cross_rank, cross_z, mean, residual, roll, safe, shift, std


def prior_z(x: str, w: int = 20, least: int = 10, ddof: int = 1) -> str:
    """z-score of x against the w present rows before it."""
    of = lambda fn: agg(fn, x, w, "rows", 1)
    sd = of("stddev_samp" if ddof else "stddev_pop")
    return f"case when {of('count')} >= {least} and {sd} > 1e-12 then ({x} - {of('avg')}) / {sd} end"


def own_z(x: str, w: int, least: int, kind: str = "range") -> str:
    """z-score of x against a window that ends with it."""
    of = lambda fn: agg(fn, x, w, kind)
    return f"case when {of('count')} >= {least} and {of('stddev_samp')} > 1e-12 then ({x} - {of('avg')}) / {of('stddev_samp')} end"


TRADE_FLOW_BASE = [
    {
        "net_buy_ratio": safe("buy_amount - sell_amount", "amount"),
        "net_buy_count_ratio": safe("buy_count - sell_count", "buy_count + sell_count"),
        "avg_buy": safe("buy_amount", "buy_count"),
        "avg_sell": safe("sell_amount", "sell_count"),
    }
]
TRADE_FLOW = {
    "net_buy": "net_buy_ratio",
    "net_buy_count": "net_buy_count_ratio",
    "buy_dominance": safe("buy_amount", "buy_amount + sell_amount"),
    "avg_buy_trade_size": "avg_buy",
    "avg_sell_trade_size": "avg_sell",
    "trade_size_asymmetry": safe("avg_buy", "avg_sell"),
    "flow_concentration": "0.5e0 * (abs(net_buy_ratio) + abs(net_buy_count_ratio))",
    "flow_zscore_20d": prior_z("net_buy_ratio"),
    "flow_acceleration": "net_buy_ratio - lag(net_buy_ratio) over (partition by symbol order by td)",
}

_BUCKETS = ("small_amount", "mid_amount", "large_amount", "super_amount")
ORDER_SIZE_BASE = [
    {f"p_{b}": safe(b, "amount") for b in _BUCKETS},
    {
        "tail_large": "p_large_amount + p_super_amount",
        "entropy": "-(" + " + ".join(f"case when p_{b} > 0 then p_{b} * ln(p_{b}) else 0 end" for b in _BUCKETS) + ") / ln(4)",
        "concentration": " + ".join(f"p_{b} * p_{b}" for b in _BUCKETS),
    },
]
ORDER_SIZE = {
    "small_order_ratio": "p_small_amount",
    "small_mid_order_ratio": "p_small_amount + p_mid_amount",
    "mid_order_ratio": "p_mid_amount",
    "mid_large_order_ratio": "p_mid_amount + p_large_amount",
    "large_order_ratio": "tail_large",
    "super_large_order_ratio": "p_super_amount",
    "large_small_spread": "tail_large - p_small_amount",
    "order_size_entropy": "entropy",
    "order_size_concentration": "concentration",
    "order_size_tail_share": "p_small_amount + p_super_amount",
    **{f"{b}_order_pressure": safe(f"{b}_buy - {b}_sell", "amount") for b in ("small", "mid", "large", "super")},
    "buy_large_order_ratio": safe("large_buy + super_buy", "buy_amount"),
    "sell_large_order_ratio": safe("large_sell + super_sell", "sell_amount"),
    "small_order_direction": safe("small_buy - small_sell", "small_buy + small_sell"),
    "large_order_direction": safe("large_buy - large_sell", "large_buy + large_sell"),
    "large_order_shock_20d": prior_z("tail_large"),
    "order_size_entropy_shock_20d": prior_z("entropy"),
}

#: Day states of volume, cancel and amount pressure, with shocks and persistence on the calendar.
STATE_BASE = [
    {
        "voi": safe("buy_volume - sell_volume", "buy_volume + sell_volume"),
        "oir": safe("bid_cancel - ask_cancel", "bid_cancel + ask_cancel"),
        "mpb": safe("buy_amount - sell_amount", "buy_amount + sell_amount"),
        "net": "buy_amount - sell_amount",
        "buy_share": safe("buy_amount", "buy_amount + sell_amount"),
    },
    {"voi5": mean("voi", 5), "net_cap": "net / 1e6"},
    {"voi5_lag": shift("voi5", 1), "net20": roll("sum", "net_cap", 20, 10), "net5": roll("sum", "net_cap", 5, 3), "net_z60": own_z("net", 60, 20), "buy20": mean("buy_share", 20)},
]
STATES = {
    "cn_voi_20d": mean("voi", 20),
    "cn_oir_20d": mean("oir", 20),
    "cn_mpb_20d": mean("mpb", 20),
    "cn_voi_shock": own_z("voi", 60, 20),
    "cn_mpb_shock": own_z("mpb", 60, 20),
    "cn_cancel_shock": own_z("oir", 60, 20),
    "cn_flow_persistence": corr("voi", "voi5_lag", 20, 10),
    "cn_imbalance_duration": f"{agg('sum', 'case when voi > 0.5e0 then 1.0e0 else 0.0e0 end', 20)} / {agg('count', '*', 20)}",
    "cn_liquidity_consumption": safe("volume", "buy_volume + sell_volume"),
    "flow_net_20d": cross_z("net20"),
    "flow_net_5d": cross_z("net5"),
    "flow_net_shock": cross_z("net_z60"),
    "flow_buy_share_20d": cross_z("buy20"),
}

#: Persistence of order flow against the return of the same day, over five present rows.
RESPONSE_BASE = [
    {
        "day_ret": safe("close - open", "open"),
        "net_flow": safe("buy_amount - sell_amount", "amount"),
        "sell_intensity": safe("sell_amount", "amount"),
        "buy_intensity": safe("buy_amount", "amount"),
        "cancel_pressure": safe("bid_cancel - ask_cancel", "bid_cancel + ask_cancel"),
        "cancel_intensity": safe("bid_cancel + ask_cancel", "volume"),
        "depth": "ln(1 + volume)",
        "spread": safe("high - low", "close"),
    },
    {
        "r_ret": cross_rank("day_ret"),
        "r_neg": cross_rank("(-day_ret)"),
        "r_net": cross_rank("net_flow"),
        "r_sell": cross_rank("sell_intensity"),
        "r_buy": cross_rank("buy_intensity"),
    },
    *residual("flow_resid", "day_ret", ["net_flow"]),
    {
        "sell_absorption": "r_ret + r_sell",
        "buy_absorption": "r_neg + r_buy",
        "buy_exhaustion": "(r_buy - 0.5e0) - (r_ret - 0.5e0)",
        "divergence": "r_ret - r_net",
        "efficiency": "(r_ret - 0.5e0) * (r_net - 0.5e0)",
    },
]


def _five(x: str, fn: str = "avg") -> str:
    return roll(fn, x, 5, 3, "rows")


RESPONSE = {
    "stable_imbalance_5d": f"({_five('net_flow')}) / nullif(case when ({_five('net_flow', 'stddev_samp')}) > 1e-9 then {_five('net_flow', 'stddev_samp')} end, 0)",
    "persistent_imbalance_5d": _five("net_flow"),
    "depth_quality_5d": f"({_five('depth')}) / (case when ({_five('depth', 'stddev_samp')}) > 1e-9 then {_five('depth', 'stddev_samp')} end)",
    "spread_quality_5d": f"-({_five('spread')})",
    "sell_absorption_5d": _five("sell_absorption"),
    "buy_absorption_5d": _five("buy_absorption"),
    "buy_exhaustion_5d": _five("buy_exhaustion"),
    "flow_price_divergence_5d": _five("divergence"),
    "flow_price_efficiency_5d": _five("efficiency"),
    "flow_price_residual_5d": _five("flow_resid"),
    "sell_absorption_consistency_5d": f"({_five('sell_absorption')}) * {agg('sum', 'case when sell_absorption > 1 then 1.0e0 else 0.0e0 end', 5, 'rows')} / {agg('count', 'sell_absorption', 5, 'rows')}",
    "persistent_cancel_pressure_5d": _five("cancel_pressure"),
    "persistent_cancel_intensity_5d": _five("cancel_intensity"),
    "cancel_pressure_consistency_5d": f"greatest({agg('sum', 'case when cancel_pressure > 0 then 1.0e0 else 0.0e0 end', 5, 'rows')}, {agg('sum', 'case when cancel_pressure < 0 then 1.0e0 else 0.0e0 end', 5, 'rows')}) / nullif({agg('count', 'cancel_pressure', 5, 'rows')}, 0) * ({_five('abs(cancel_pressure)')})",
    "cancel_shock_20d": prior_z("cancel_pressure", 20, 10, 0),
}

#: Shares of trades by size relative to lagged scales: fixed, average daily amount, average trade size.
NORMALISED_BASE = [
    {"adv": roll("avg", "amount", 20, 10, "range", 1), "ats_day": safe("amount", "trades")},
    {"ats": roll("avg", "ats_day", 20, 10, "range", 1)},
]
NORMALISED = {
    "fixed_mid_share": safe("mid_amount", "amount"),
    "adv_share": safe("amount", "adv"),
    "ats_multiple": safe("ats_day", "ats"),
    "amount_per_adv_stability": f"-({std('amount', 20)}) / nullif({mean('adv', 20)}, 0)",
}
