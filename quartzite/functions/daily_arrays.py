"""The daily factor families of daily_factors.py as NumPy over matrices of symbols by dates: one pass makes a family's windows by symbol.

Each function takes Matrices of the columns of PANEL and returns its factors by name. What needs all symbols of a date comes
in as columns (`market_ret`, or what `engine_dates` made) or is made afterwards (`engine_dates`, `broker_dates`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .matrices import Matrices, present, safe

EPS = 1e-6
#: What the families read of the weekly panel.
PANEL = ["open", "high", "low", "close", "volume", "amount", "turnover"]

Arrays = dict[str, np.ndarray]


def shared(p: Matrices) -> None:
    """The columns that the families share."""
    close, high, low = p["close"], p["high"], p["low"]
    for k in (1, 5, 20, 60, 120, 240):
        before = p.shift("close", k)
        p[f"ret_{k}d"] = safe(close - before, before)
        if k == 1:
            p["gain_"] = np.where(present(before), np.maximum(close - before, 0), np.nan)
            p["loss_"] = np.where(present(before), np.maximum(before - close, 0), np.nan)
    p["daily_range"] = high / np.where(low == 0, np.nan, low) - 1
    p["upper_shadow"], p["lower_shadow"] = safe(high - close, close), safe(close - low, close)
    for w in (5, 20, 60):
        p[f"volume_mean_{w}d"], p[f"amount_mean_{w}d"] = p.mean("volume", w), p.mean("amount", w)
    p["amount_std_20d"] = p.std("amount", 20)
    p["amount_cv_20d"] = safe(p["amount_std_20d"], p["amount_mean_20d"])
    p["amihud"] = safe(np.abs(p["ret_1d"]), p["amount"])
    p["volume_shock"], p["amount_shock"] = safe(p["volume"], p["volume_mean_20d"]), safe(p["amount"], p["amount_mean_20d"])
    p["volatility_20d"], p["volatility_60d"] = p.std("ret_1d", 20), p.std("ret_1d", 60)
    for w in (20, 60):
        p[f"high_low_mean_{w}d"] = p.mean("daily_range", w)
    p["daily_range_std_20d"], p["range_cv"] = p.std("daily_range", 20), p.cv("daily_range", 20)


def ratio(p: Matrices, x: str, w: int, v: int) -> np.ndarray:
    return safe(p[f"{x}_mean_{w}d"], p[f"{x}_mean_{v}d"])


def eod(p: Matrices) -> Arrays:
    shared(p)
    p["rsi_14"] = p.rsi("gain_", "loss_", 14, 7)
    for w in (20, 60):
        p[f"turnover_mean_{w}d"] = p.mean("turnover", w)
    out = {f"reversal_{w}d": -p[f"ret_{w}d"] for w in (20, 60, 120, 240)}
    out |= {f"momentum_{w}d": p[f"ret_{w}d"] for w in (20, 60)} | {"rsi": p["rsi_14"], "rsi_14_reversal": -p["rsi_14"]}
    out |= {f"{x}_{w}d_mean": p[f"{x}_mean_{w}d"] for x in ("volume", "amount", "turnover") for w in (20, 60)}
    for w in (20, 60):
        out |= {f"volatility_{w}": p[f"volatility_{w}d"], f"high_low_{w}d": p[f"high_low_mean_{w}d"], f"amount_to_volatility_{w}d": safe(p[f"amount_mean_{w}d"], p[f"volatility_{w}d"])}
    ret20, volume = p["ret_20d"], ratio(p, "volume", 5, 20)
    return out | {
        "volume_surge_no_return_20d": -(p["volume_shock"] / (np.abs(p["ret_5d"]) + EPS)),
        "moderate_volume_up_20d": ret20 * np.exp(-np.abs(volume - 1.5)),
        "overheated_turnover_proxy_20d": -(p["ret_5d"] * p["amount_mean_5d"] / np.where(p["amount_mean_20d"] == 0, np.nan, p["amount_mean_20d"])),
        "low_attention_reversal_20d": -ret20 / (ratio(p, "amount", 20, 60) + EPS),
        "volume_contraction_stability_20d": -ret20 / (p["volatility_20d"] * p["volume_mean_5d"] / np.where(p["volume_mean_20d"] == 0, np.nan, p["volume_mean_20d"]) + EPS),
        "upper_shadow_pressure_20d": -p.mean("upper_shadow", 20),
        "lower_shadow_support_20d": p.mean("lower_shadow", 20),
        "range_contraction_20d": -p["daily_range_std_20d"],
        "amount_stability_20d": -p["amount_cv_20d"],
        "price_volume_divergence_20d": -ret20 * (volume - 1),
        "amount_acceleration_20d": ratio(p, "amount", 5, 20) - ratio(p, "amount", 20, 60),
        "volume_price_efficiency_20d": ret20 / np.log(1 + p["amount_mean_20d"]),
    }


# The broker family ----------------------------------------------------------------------------------

#: What the dates of the broker family are made of.
BROKER_CROSSED = ["volume", "rsi_14", "ret_20d", "ret_5d"]


def broker(p: Matrices) -> Arrays:
    """All but what `broker_dates` makes of the dates, and the columns for that; `market_ret` is a column of p."""
    shared(p)
    p["rsi_14"] = p.rsi("gain_", "loss_", 14, 7)
    p["intraday_ret"] = safe(p["close"] - p["open"], p["open"])
    p["amount_shock_"] = p["amount"] / 1e4
    low, high, turnover, ret = p.roll("min", "turnover", 60, 20), p.roll("max", "turnover", 60, 20), p["turnover"], p["ret_1d"]
    p90 = np.where(p.agg("count", "turnover", 60) >= 20, p.agg("percentile 0.9", "turnover", 60), np.nan)
    gains = p.share(ret > 0, 20)
    return {
        "cn_turnover_percentile_20d": safe(turnover - low, high - low),
        "cn_turnover_change_rate_20d": safe(p.mean("turnover", 5, 3), p.mean("turnover", 20, 10)) - 1,
        "cn_volume_surge_moment_20d": p.mean(np.fmax(p["volume_shock"] - 1, 0), 20),
        "cn_amount_distribution_skew_20d": p.skew("amount_shock_", 20, 10),
        "cn_price_volume_divergence_20d": -p["ret_20d"] * (ratio(p, "volume", 5, 20) - 1),
        "cn_chase_behavior_20d": p.corr("intraday_ret", "volume", 20, 10),
        "cn_herding_proxy_20d": p.mean((ret - p["market_ret"]) * p["volume_shock"], 20),
        "cn_new_high_breakout_252d": safe(p["close"], p.roll("max", "high", 252, 120)) - 1,
        "cn_shadow_combo_20d": p.mean(p["lower_shadow"] - p["upper_shadow"], 20),
        "cn_limit_up_strength_20d": p.share(ret > 0.095, 20),
        "cn_turnover_concentration_20d": p.share(turnover >= p90, 20),
        "d4_turnover_shock_reversal_5d": -(p["ret_5d"] * turnover / np.where(p.mean("turnover", 20) == 0, np.nan, p.mean("turnover", 20))),
        "d4_consecutive_gain_exhaustion_20d": -(p["ret_20d"] * gains),
        **{n: p[n] for n in BROKER_CROSSED},
    }


def broker_dates(x: Arrays, ranks: Callable, z: Callable) -> Arrays:
    return {"cn_attention_shock_5d": -(z(x["volume"]) * x["ret_5d"]), "cn_rsi_momentum_gap_20d": ranks(x["rsi_14"]) - ranks(x["ret_20d"])}


# The engine family ----------------------------------------------------------------------------------

#: What the dates of the engine family are made of.
ENGINE_CROSSED = ["volume", "ret_5d", "ret_20d", "ret_60d", "volatility_20d", "amount_mean_20d", "amount_mean_5d", "amount_stab", "volume_stab", "range_stab", "low_vol_60", "amihud_stab"]


#: The factors that a date makes.
ENGINE_DATES = {
    "attention_shock_cs_5d", "amihud_amount_orth_20d", "relative_liquidity_strength_20d", "momentum_rank_dispersion_20d", "vol_liquidity_rank_gap_20d", "momentum_timescale_conflict_20d", "flow_price_rank_gap_20d",
    "composite_liquidity_stability_20d", "stability_quality_composite_20d", "low_vol_stability_rank_20d", "stable_reversal_blend_20d", "flow_price_divergence_20d",
    "residual_momentum_60d", "residual_liquidity_20d", "relative_vol_adjusted_liquidity_20d", "low_vol_liquidity_quality_60d", "residual_reversal_20d",
}


def engine_shared(p: Matrices) -> None:
    shared(p)
    p["amount_stab"], p["range_stab"], p["volume_stab"] = -p["amount_cv_20d"], -p["range_cv"], -p.cv("volume", 20)
    p["vol60_30"] = p.std("ret_1d", 60, 30)
    p["low_vol_60"] = -p["vol60_30"]
    p["amihud_cv"] = p.cv("amihud", 20)
    p["amihud_stab"] = -p["amihud_cv"]


def engine_inputs(p: Matrices) -> Arrays:
    engine_shared(p)
    return {n: p[n] for n in ENGINE_CROSSED}


def engine_dates(x: Arrays, ranks: Callable, z: Callable, residual: Callable) -> Arrays:
    """What a date makes of its symbols' ENGINE_CROSSED, a value a symbol: factors, and `rank_ret_20` for the windows after it."""
    ret20, vol, amount, stab = x["ret_20d"], x["volatility_20d"], x["amount_mean_20d"], x["amount_stab"]
    cv = -stab
    log_amount, reversal = np.log(np.where(amount == 0, np.nan, amount)), -ret20
    accel = safe(x["amount_mean_5d"], amount) - 1
    r5, r20, r60 = (ranks(x[f"ret_{w}d"]) for w in (5, 20, 60))
    r_stab, r_volume, r_range, r_low, r_low60 = (ranks(v) for v in (stab, x["volume_stab"], x["range_stab"], -vol, x["low_vol_60"]))
    r_quality, r_reversal = ranks(-(vol * cv)), ranks(reversal)
    there = amount[present(amount)]
    mean = there.mean() if len(there) else np.nan
    return {
        "rank_ret_20": r20,
        "attention_shock_cs_5d": -(z(x["volume"]) * x["ret_5d"]),
        "amihud_amount_orth_20d": residual(x["amihud_stab"], [stab, log_amount]),
        "relative_liquidity_strength_20d": amount / (mean if mean != 0 else np.nan),
        "momentum_rank_dispersion_20d": r20 - r5,
        "vol_liquidity_rank_gap_20d": ranks(vol) - ranks(amount),
        "momentum_timescale_conflict_20d": r5 - r60,
        "flow_price_rank_gap_20d": ranks(x["amount_mean_5d"]) - r20,
        "composite_liquidity_stability_20d": (r_stab + r_volume + r_range) / 3,
        "stability_quality_composite_20d": (r_stab + r_low + r_range) / 3,
        "low_vol_stability_rank_20d": (r_quality + r_range) / 2,
        "stable_reversal_blend_20d": (r_reversal + r_stab) / 2,
        "flow_price_divergence_20d": ranks(accel) - r20,
        "residual_momentum_60d": residual(x["ret_60d"], [ret20, vol, log_amount]),
        "residual_liquidity_20d": residual(stab, [log_amount, vol]),
        "relative_vol_adjusted_liquidity_20d": ranks(safe(amount, vol)),
        "low_vol_liquidity_quality_60d": (r_low60 + r_stab) / 2,
        "residual_reversal_20d": residual(reversal, [x["ret_60d"], vol]),
    }


def engine(p: Matrices) -> Arrays:
    """The factors by symbol; `rank_ret_20` is a column of p."""
    engine_shared(p)
    close, high, low, amount = p["close"], p["high"], p["low"], p["amount"]
    ret, ret5, ret20, ret60, vol, shock = p["ret_1d"], p["ret_5d"], p["ret_20d"], p["ret_60d"], p["volatility_20d"], p["volume_shock"]
    p["up_"], p["down_"] = np.where(present(ret), np.fmax(ret, 0), np.nan), np.where(present(ret), np.fmin(ret, 0), np.nan)
    p["ret_1d_lag"], p["amount_lag"], p["stab_lag"] = p.shift("ret_1d"), p.shift("amount"), p.shift("amount_stab")
    regime = safe(p.std("ret_1d", 5, 3), vol)
    move, span = close - p["open"], high - low + EPS
    rose, fell = np.where(move > 0, amount, 0), np.where(move < 0, amount, 0)
    inflow = (rose - fell) / (rose + fell + EPS)
    amihud_mean = p.mean("amihud", 20)
    p["corr_5_20"] = p.corr("ret_5d", "ret_20d", 20, 10)
    amount_dev = (amount - p.mean("amount", 20, 10)) * (p["amount_lag"] - p.mean("amount_lag", 20, 10))
    p["amount_auto"] = safe(p.mean(amount_dev, 20, 10), p["amount_std_20d"] * p.std("amount_lag", 20, 10))
    stab_dev = (p["amount_stab"] - p.mean("amount_stab", 20, 10)) * (p["stab_lag"] - p.mean("stab_lag", 20, 10))
    stab_size = p.std("amount_stab", 20, 10) * p.std("stab_lag", 20, 10)
    p["log_amount"] = np.log(np.where(amount == 0, np.nan, amount))
    p["log_amount_d1"] = p["log_amount"] - p.shift("log_amount")
    ret_mean, v5_20, max20 = p.mean("ret_1d", 20), ratio(p, "volume", 5, 20), p.roll("max", "ret_1d", 20, 10)
    skew20, skew60, skew60_s, skew120 = p.skew("ret_1d", 20, 10), p.skew("ret_1d", 60, 30), p.skew("ret_1d", 60, 20), p.skew("ret_1d", 120, 60)
    p["shadow"] = p["upper_shadow"] + p["lower_shadow"]
    rank_move = np.abs(p["rank_ret_20"] - p.shift("rank_ret_20"))
    td = p.td
    return {
        "trend_consistency_20d": p.mean(np.sign(ret), 20),
        "drawup_drawdown_ratio_20d": p.roll("sum", "up_", 20, 10) / (p.roll("max", -p["down_"], 20, 10) + EPS),
        "return_autocorr_5d": p.corr("ret_1d", "ret_1d_lag", 5, 3),
        "liquidity_stability_20d": -p["amount_cv_20d"],
        "liquidity_shock_20d": -(p["amount_shock"] * ret5),
        "liquidity_persistence_20d": p.corr("amount", "amount_lag", 19, 9),
        "liquidity_acceleration_20d": v5_20 - ratio(p, "volume", 20, 60),
        "volatility_level_20d": -vol,
        "volatility_regime_change_20d": regime - 1,
        "vol_of_vol_20d": -p.std("volatility_20d", 20),
        "range_expansion_20d": -safe(p["daily_range"], p["high_low_mean_20d"]),
        "overreaction_shock_5d": -(ret5 * shock),
        "underreaction_gap_20d": ret20 - ret5,
        "volume_price_divergence_20d": -ret20 * (v5_20 - 1),
        "close_location_value_20d": p.mean((close - low) / span, 20),
        "price_inefficiency_20d": -p.mean(np.abs(move) / span, 20),
        "net_volume_pressure_20d": p.mean(np.sign(move) * p["volume"], 20),
        "amihud_illiquidity_20d": -amihud_mean * 1e6,
        "amihud_shock_reversal_5d": -(p["amihud"] / np.where(amihud_mean == 0, np.nan, amihud_mean) * ret5),
        "max_daily_return_20d": -max20,
        "cn_trend_pv_20d": ret20 * p["volume_mean_5d"] / np.where(p["volume_mean_60d"] == 0, np.nan, p["volume_mean_60d"]),
        "loser_liquidity_reversal_5d": np.where(ret5 < 0, -(ret5 * shock), 0.0),
        "winner_sentiment_reversal_5d": np.where(ret5 > 0, -(ret5 * shock), 0.0),
        "net_inflow_asymmetry_20d": np.where(td + 1 >= 10, np.round(p.agg("sum", inflow, 20) / np.minimum(20, td + 1), 6) + 0.0, np.nan),
        "amount_acceleration_20d": ratio(p, "amount", 5, 20) - ratio(p, "amount", 20, 60),
        "flow_persistence_decay_20d": p["amount_auto"] - p.shift("amount_auto"),
        "intraday_reversal_intensity_20d": p.mean(safe((high + low) / 2.0 - close, close), 20),
        "range_entropy_20d": -p["range_cv"],
        "winner_crowding_exhaustion_20d": -(ret20 * shock),
        "loser_panic_stabilization_20d": np.fmax(-ret20, 0) * (1.0 - np.fmin(np.fmax(shock, 0), 2) / 2.0),
        "low_vol_liquidity_quality_20d": -(vol * p["amount_cv_20d"]),
        "tail_risk_min_return_20d": p.roll("min", "ret_1d", 20, 10),
        "volatility_adjusted_momentum_20d": safe(ret20, vol),
        "vol_liquidity_stress_20d": -(amihud_mean * vol) * 1e6,
        "liquidity_fragility_20d": safe(p.std("amihud", 5, 3), p.std("amihud", 20, 10)),
        "momentum_regime_flip_20d": p["corr_5_20"] - p.shift("corr_5_20", 5),
        "downside_tail_cluster_20d": p.hits(ret < -2 * vol, 20),
        "upside_fragility_20d": p.roll("max", "ret_1d", 5, 3) - ret_mean,
        "asymmetric_tail_ratio_20d": safe(p.mean(p["down_"] * p["down_"], 20), p.mean(p["up_"] * p["up_"], 20)),
        "momentum_rank_churn_20d": p.mean(rank_move, 20),
        "return_skew_shift_20d": skew20 - skew60,
        "skew_20d": -skew20,
        "skew_60d": -skew60_s,
        "skew_120d": -skew120,
        "amihud_stability_20d": -p["amihud_cv"],
        "return_stability_20d": -np.where(np.abs(ret_mean) > 1e-4, p.cv("ret_1d", 20), np.nan),
        "amount_stability_60d": -p.cv("amount", 60, 30),
        "shadow_stability_20d": -p.cv("shadow", 20),
        "liquidity_conditioned_momentum_20d": ret20 * p["amount_stab"],
        "liquidity_shock_recovery_5d": -(p["amihud"] - p.shift("amihud", 5)) * ret5 * 1e6,
        "triple_crowding_exhaustion_20d": -(ret20 * shock * regime),
        "trend_quality_composite_20d": ret20 * p.mean(safe(np.abs(move), high - low), 20) * p.share(ret > 0, 20),
        "liquidity_vol_regime_20d": safe(p["amount_shock"], regime),
        "tail_adjusted_momentum_60d": safe(ret60, p.std("down_", 60, 30)),
        "liquidity_accel_risk_filtered_20d": p.mean(p["log_amount_d1"] - p.shift("log_amount_d1"), 20) * -vol,
        "information_ratio_momentum_60d": safe(ret60, p["vol60_30"]),
        "information_ratio_momentum_120d": safe(p["ret_120d"], p.std("ret_1d", 120, 60)),
        "stability_signal_persistence_20d": safe(p.mean(stab_dev, 20, 10), np.where(stab_size > 1e-10, stab_size, np.nan)),
    }
