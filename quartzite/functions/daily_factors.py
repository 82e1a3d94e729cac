"""Factor formulas on daily bars: stages of shared panels, then a registry of name to SQL text."""

from __future__ import annotations

from .windows import agg, corr, cross, cross_rank, cross_z, cv, hits, mean, residual, roll, rsi, safe, share, shift, skew, std

EPS = "1e-6"

#: Panels that many formulas share.
BASE: list[dict[str, str]] = [
    {f"close_{k}": shift("close", k) for k in (1, 5, 20, 60, 120, 240)},
    {f"ret_{k}d": safe(f"close - close_{k}", f"close_{k}") for k in (1, 5, 20, 60, 120, 240)}
    | {"daily_range": f"high / nullif(low, 0) - 1", "upper_shadow": safe("high - close", "close"), "lower_shadow": safe("close - low", "close"), "gain": "greatest(close - close_1, 0)", "loss": "greatest(close_1 - close, 0)"}
    | {f"{x}_mean_{w}d": mean(x, w) for x in ("volume", "amount") for w in (5, 20, 60)}
    | {f"turnover_mean_{w}d": mean("turnover", w) for w in (20, 60)}
    | {"amount_std_20d": std("amount", 20), "log_amount": "ln(nullif(amount, 0))"},
    {
        "gain_": "case when close_1 is not null then gain end",
        "loss_": "case when close_1 is not null then loss end",
        "amount_cv_20d": safe("amount_std_20d", "amount_mean_20d"),
        "amihud": safe("abs(ret_1d)", "amount"),
        "volume_shock": safe("volume", "volume_mean_20d"),
        "amount_shock": safe("amount", "amount_mean_20d"),
        "market_ret": cross("avg", "ret_1d"),
        "log_amount_mean": "ln(nullif(amount_mean_20d, 0))",
        "log_amount_1": shift("log_amount", 1),
    }
    | {f"volatility_{w}d": std("ret_1d", w) for w in (20, 60)}
    | {"vol5": std("ret_1d", 5, 3), "vol60_30": std("ret_1d", 60, 30), "vol120_60": std("ret_1d", 120, 60)}
    | {f"high_low_mean_{w}d": mean("daily_range", w) for w in (20, 60)}
    | {"daily_range_std_20d": std("daily_range", 20), "range_cv": cv("daily_range", 20)},
    {
        "rsi_14": rsi("gain_", "loss_", 14, 7),
        "amihud_mean_20d": mean("amihud", 20),
        "amihud_cv": cv("amihud", 20),
        "vol_regime": safe("vol5", "volatility_20d"),
        "log_amount_d1": "log_amount - log_amount_1",
    },
]

EOD: dict[str, str] = {
    **{f"reversal_{w}d": f"-ret_{w}d" for w in (20, 60, 120, 240)},
    "momentum_20d": "ret_20d",
    "momentum_60d": "ret_60d",
    "rsi": "rsi_14",
    "rsi_14_reversal": "-rsi_14",
    **{f"{x}_{w}d_mean": f"{x}_mean_{w}d" for x in ("volume", "amount", "turnover") for w in (20, 60)},
    **{f"volatility_{w}": f"volatility_{w}d" for w in (20, 60)},
    **{f"high_low_{w}d": f"high_low_mean_{w}d" for w in (20, 60)},
    **{f"amount_to_volatility_{w}d": safe(f"amount_mean_{w}d", f"volatility_{w}d") for w in (20, 60)},
    "volume_surge_no_return_20d": f"-(volume_shock / (abs(ret_5d) + {EPS}))",
    "moderate_volume_up_20d": f"ret_20d * exp(-abs({safe('volume_mean_5d', 'volume_mean_20d')} - 1.5e0))",
    "overheated_turnover_proxy_20d": f"-(ret_5d * {safe('amount_mean_5d', 'amount_mean_20d')})",
    "low_attention_reversal_20d": f"-ret_20d / ({safe('amount_mean_20d', 'amount_mean_60d')} + {EPS})",
    "volume_contraction_stability_20d": f"-ret_20d / (volatility_20d * {safe('volume_mean_5d', 'volume_mean_20d')} + {EPS})",
    "upper_shadow_pressure_20d": f"-({mean('upper_shadow', 20)})",
    "lower_shadow_support_20d": mean("lower_shadow", 20),
    "range_contraction_20d": "-daily_range_std_20d",
    "amount_stability_20d": "-amount_cv_20d",
    "price_volume_divergence_20d": f"-ret_20d * ({safe('volume_mean_5d', 'volume_mean_20d')} - 1)",
    "amount_acceleration_20d": f"{safe('amount_mean_5d', 'amount_mean_20d')} - {safe('amount_mean_20d', 'amount_mean_60d')}",
    "volume_price_efficiency_20d": "ret_20d / ln(1 + amount_mean_20d)",
}

#: Second round of shared panels, for the engine and broker families.
ENGINE_BASE: list[dict[str, str]] = [
    {
        "up_": "case when ret_1d is not null then greatest(ret_1d, 0) end",
        "down_": "case when ret_1d is not null then least(ret_1d, 0) end",
        "ret_1d_lag": shift("ret_1d", 1),
        "amount_lag": shift("amount", 1),
        "amount_mean": mean("amount", 20, 10),
        "clv": f"(close - low) / (high - low + {EPS})",
        "inefficiency": f"abs(close - open) / (high - low + {EPS})",
        "efficiency": safe("abs(close - open)", "high - low"),
        "pressure": "sign(close - open) * volume",
        "inflow": f"((case when close > open then amount else 0 end) - (case when close < open then amount else 0 end)) / ((case when close > open then amount else 0 end) + (case when close < open then amount else 0 end) + {EPS})",
        "midpoint_gap": safe("(high + low) / 2.0e0 - close", "close"),
        "shadow": "upper_shadow + lower_shadow",
        "volume_z": cross_z("volume"),
        "rank_ret_5": cross_rank("ret_5d"),
        "rank_ret_20": cross_rank("ret_20d"),
        "rank_ret_60": cross_rank("ret_60d"),
        "rank_vol_20": cross_rank("volatility_20d"),
        "rank_amount_20": cross_rank("amount_mean_20d"),
        "rank_amount_5": cross_rank("amount_mean_5d"),
        "rank_rsi": cross_rank("rsi_14"),
        "amount_stab": "-amount_cv_20d",
        "amihud_5": shift("amihud", 5),
        "range_stab": "-range_cv",
        "volume_stab": f"-({cv('volume', 20)})",
        "quality": "-(volatility_20d * amount_cv_20d)",
        "low_vol": "-volatility_20d",
        "low_vol_60": "-vol60_30",
        "reversal": "-ret_20d",
        "amount_accel": f"{safe('amount_mean_5d', 'amount_mean_20d')} - 1",
        "log_amount_d2": f"log_amount_d1 - {shift('log_amount_d1', 1)}",
        "amihud_stab": "-amihud_cv",
        "corr_5_20": corr("ret_5d", "ret_20d", 20, 10),
        "rvl": safe("amount_mean_20d", "volatility_20d"),
        "intraday_ret": safe("close - open", "open"),
        "surge": "greatest(volume_shock - 1, 0)",
        "herding": "(ret_1d - market_ret) * volume_shock",
        "turn_p90": f"case when {agg('count', 'turnover', 60)} >= 20 then {agg('percentile', 'turnover, 0.9e0', 60)} end",
        "skew20": skew("ret_1d", 20, 10),
        "skew60": skew("ret_1d", 60, 30),
        "skew60_s": skew("ret_1d", 60, 20),
        "skew120": skew("ret_1d", 120, 60),
    },
    {
        "amount_lag_mean": mean("amount_lag", 20, 10),
        "amount_lag_std": std("amount_lag", 20, 10),
        "stab_lag": shift("amount_stab", 1),
        "stab_mean": mean("amount_stab", 20, 10),
        "stab_std": std("amount_stab", 20, 10),
        "rank_ret_20_lag": shift("rank_ret_20", 1),
        "rank_amount_stab": cross_rank("amount_stab"),
        "rank_volume_stab": cross_rank("volume_stab"),
        "rank_range_stab": cross_rank("range_stab"),
        "rank_low_vol": cross_rank("low_vol"),
        "rank_low_vol_60": cross_rank("low_vol_60"),
        "rank_quality": cross_rank("quality"),
        "rank_reversal": cross_rank("reversal"),
        "rank_accel": cross_rank("amount_accel"),
        "corr_5_20_lag": shift("corr_5_20", 5),
    },
    {
        "stab_lag_mean": mean("stab_lag", 20, 10),
        "stab_lag_std": std("stab_lag", 20, 10),
        "amount_dev": "(amount - amount_mean) * (amount_lag - amount_lag_mean)",
        "rank_move": "abs(rank_ret_20 - rank_ret_20_lag)",
    },
    {"stab_dev": "(amount_stab - stab_mean) * (stab_lag - stab_lag_mean)", "amount_auto": safe(mean("amount_dev", 20, 10), "amount_std_20d * amount_lag_std")},
    *residual("amihud_orth", "amihud_stab", ["amount_stab", "log_amount_mean"]),
    *residual("residual_momentum", "ret_60d", ["ret_20d", "volatility_20d", "log_amount_mean"]),
    *residual("residual_liquidity", "amount_stab", ["log_amount_mean", "volatility_20d"]),
    *residual("residual_reversal", "reversal", ["ret_60d", "volatility_20d"]),
]

ENGINE: dict[str, str] = {
    "trend_consistency_20d": mean("sign(ret_1d)", 20),
    "drawup_drawdown_ratio_20d": f"({roll('sum', 'up_', 20, 10)}) / ({roll('max', '(-down_)', 20, 10)} + {EPS})",
    "return_autocorr_5d": corr("ret_1d", "ret_1d_lag", 5, 3),
    "liquidity_stability_20d": "-amount_cv_20d",
    "liquidity_shock_20d": "-(amount_shock * ret_5d)",
    "liquidity_persistence_20d": corr("amount", "amount_lag", 19, 9),
    "liquidity_acceleration_20d": f"{safe('volume_mean_5d', 'volume_mean_20d')} - {safe('volume_mean_20d', 'volume_mean_60d')}",
    "volatility_level_20d": "-volatility_20d",
    "volatility_regime_change_20d": "vol_regime - 1",
    "vol_of_vol_20d": f"-({std('volatility_20d', 20)})",
    "range_expansion_20d": f"-({safe('daily_range', 'high_low_mean_20d')})",
    "overreaction_shock_5d": "-(ret_5d * volume_shock)",
    "underreaction_gap_20d": "ret_20d - ret_5d",
    "volume_price_divergence_20d": f"-ret_20d * ({safe('volume_mean_5d', 'volume_mean_20d')} - 1)",
    "close_location_value_20d": mean("clv", 20),
    "price_inefficiency_20d": f"-({mean('inefficiency', 20)})",
    "net_volume_pressure_20d": mean("pressure", 20),
    "amihud_illiquidity_20d": "-amihud_mean_20d * 1e6",
    "amihud_shock_reversal_5d": f"-({safe('amihud', 'amihud_mean_20d')} * ret_5d)",
    "max_daily_return_20d": f"-({roll('max', 'ret_1d', 20, 10)})",
    "cn_trend_pv_20d": f"ret_20d * {safe('volume_mean_5d', 'volume_mean_60d')}",
    "loser_liquidity_reversal_5d": "case when ret_5d < 0 then -(ret_5d * volume_shock) else 0.0e0 end",
    "winner_sentiment_reversal_5d": "case when ret_5d > 0 then -(ret_5d * volume_shock) else 0.0e0 end",
    "amihud_amount_orth_20d": "amihud_orth",
    "net_inflow_asymmetry_20d": f"case when td + 1 >= 10 then round({agg('sum', 'inflow', 20)} / least(20, td + 1), 6) end",
    "amount_acceleration_20d": f"{safe('amount_mean_5d', 'amount_mean_20d')} - {safe('amount_mean_20d', 'amount_mean_60d')}",
    "flow_persistence_decay_20d": f"amount_auto - {shift('amount_auto', 1)}",
    "intraday_reversal_intensity_20d": mean("midpoint_gap", 20),
    "range_entropy_20d": "-range_cv",
    "attention_shock_cs_5d": "-(volume_z * ret_5d)",
    "winner_crowding_exhaustion_20d": "-(ret_20d * volume_shock)",
    "loser_panic_stabilization_20d": "greatest(-ret_20d, 0) * (1.0e0 - least(greatest(volume_shock, 0), 2) / 2.0e0)",
    "relative_liquidity_strength_20d": safe("amount_mean_20d", cross("avg", "amount_mean_20d")),
    "momentum_rank_dispersion_20d": "rank_ret_20 - rank_ret_5",
    "low_vol_liquidity_quality_20d": "quality",
    "tail_risk_min_return_20d": roll("min", "ret_1d", 20, 10),
    "volatility_adjusted_momentum_20d": safe("ret_20d", "volatility_20d"),
    "vol_liquidity_stress_20d": "-(amihud_mean_20d * volatility_20d) * 1e6",
    "liquidity_fragility_20d": safe(std("amihud", 5, 3), std("amihud", 20, 10)),
    "vol_liquidity_rank_gap_20d": "rank_vol_20 - rank_amount_20",
    "momentum_timescale_conflict_20d": "rank_ret_5 - rank_ret_60",
    "flow_price_rank_gap_20d": "rank_amount_5 - rank_ret_20",
    "momentum_regime_flip_20d": "corr_5_20 - corr_5_20_lag",
    "downside_tail_cluster_20d": hits("ret_1d < -2 * volatility_20d", 20),
    "upside_fragility_20d": f"({roll('max', 'ret_1d', 5, 3)}) - ({mean('ret_1d', 20)})",
    "asymmetric_tail_ratio_20d": safe(mean("(down_ * down_)", 20), mean("(up_ * up_)", 20)),
    "momentum_rank_churn_20d": mean("rank_move", 20),
    "return_skew_shift_20d": "skew20 - skew60",
    "skew_20d": "-skew20",
    "skew_60d": "-skew60_s",
    "skew_120d": "-skew120",
    "composite_liquidity_stability_20d": "(rank_amount_stab + rank_volume_stab + rank_range_stab) / 3",
    "amihud_stability_20d": "-amihud_cv",
    "return_stability_20d": f"-(case when abs({mean('ret_1d', 20)}) > 1e-4 then {cv('ret_1d', 20)} end)",
    "amount_stability_60d": f"-({cv('amount', 60, 30)})",
    "shadow_stability_20d": f"-({cv('shadow', 20)})",
    "stability_quality_composite_20d": "(rank_amount_stab + rank_low_vol + rank_range_stab) / 3",
    "low_vol_stability_rank_20d": "(rank_quality + rank_range_stab) / 2",
    "stable_reversal_blend_20d": "(rank_reversal + rank_amount_stab) / 2",
    "liquidity_conditioned_momentum_20d": "ret_20d * amount_stab",
    "liquidity_shock_recovery_5d": "-(amihud - amihud_5) * ret_5d * 1e6",
    "triple_crowding_exhaustion_20d": "-(ret_20d * volume_shock * vol_regime)",
    "trend_quality_composite_20d": f"ret_20d * ({mean('efficiency', 20)}) * ({share('ret_1d > 0', 20)})",
    "liquidity_vol_regime_20d": safe("amount_shock", "vol_regime"),
    "tail_adjusted_momentum_60d": safe("ret_60d", std("down_", 60, 30)),
    "flow_price_divergence_20d": "rank_accel - rank_ret_20",
    "liquidity_accel_risk_filtered_20d": f"({mean('log_amount_d2', 20)}) * -volatility_20d",
    "residual_momentum_60d": "residual_momentum",
    "information_ratio_momentum_60d": safe("ret_60d", "vol60_30"),
    "information_ratio_momentum_120d": safe("ret_120d", "vol120_60"),
    "residual_liquidity_20d": "residual_liquidity",
    "relative_vol_adjusted_liquidity_20d": cross_rank("rvl"),
    "low_vol_liquidity_quality_60d": "(rank_low_vol_60 + rank_amount_stab) / 2",
    "stability_signal_persistence_20d": safe(mean("stab_dev", 20, 10), "case when stab_std * stab_lag_std > 1e-10 then stab_std * stab_lag_std end"),
    "residual_reversal_20d": "residual_reversal",
}

BROKER: dict[str, str] = {
    "cn_turnover_percentile_20d": safe(f"turnover - ({roll('min', 'turnover', 60, 20)})", f"({roll('max', 'turnover', 60, 20)}) - ({roll('min', 'turnover', 60, 20)})"),
    "cn_turnover_change_rate_20d": f"{safe(mean('turnover', 5, 3), mean('turnover', 20, 10))} - 1",
    "cn_volume_surge_moment_20d": mean("surge", 20),
    "cn_amount_distribution_skew_20d": skew("amount_shock_", 20, 10),
    "cn_price_volume_divergence_20d": f"-ret_20d * ({safe('volume_mean_5d', 'volume_mean_20d')} - 1)",
    "cn_chase_behavior_20d": corr("intraday_ret", "volume", 20, 10),
    "cn_herding_proxy_20d": mean("herding", 20),
    "cn_attention_shock_5d": "-(volume_z * ret_5d)",
    "cn_new_high_breakout_252d": f"{safe('close', roll('max', 'high', 252, 120))} - 1",
    "cn_rsi_momentum_gap_20d": "rank_rsi - rank_ret_20",
    "cn_shadow_combo_20d": mean("(lower_shadow - upper_shadow)", 20),
    "cn_limit_up_strength_20d": share("ret_1d > 0.095e0", 20),
    "cn_turnover_concentration_20d": share("turnover >= turn_p90", 20),
    "d4_turnover_shock_reversal_5d": f"-(ret_5d * {safe('turnover', 'turnover_mean_20d')})",
    "d4_consecutive_gain_exhaustion_20d": f"-(ret_20d * {share('ret_1d > 0', 20)})",
}
#: Skewness does not change with the scale: amounts in units that keep sums exact.
BROKER_BASE: list[dict[str, str]] = [{"amount_shock_": "amount / 1e4"}]

# The engine family in two passes over symbols with one over dates between them ------------------------

#: Cross-sections of the engine family: ranks by name, then what residuals are made of.
ENGINE_RANKS = {
    **{f"rank_ret_{w}": f"ret_{w}d" for w in (5, 20, 60)},
    "rank_vol_20": "volatility_20d",
    "rank_amount_20": "amount_mean_20d",
    "rank_amount_5": "amount_mean_5d",
    **{f"rank_{x}": x for x in ("amount_stab", "volume_stab", "range_stab", "low_vol", "low_vol_60", "quality", "reversal")},
    "rank_accel": "amount_accel",
    "rank_rvl": "rvl",
}
ENGINE_RESIDUALS = {
    "amihud_orth": ("amihud_stab", ["amount_stab", "log_amount_mean"]),
    "residual_momentum": ("ret_60d", ["ret_20d", "volatility_20d", "log_amount_mean"]),
    "residual_liquidity": ("amount_stab", ["log_amount_mean", "volatility_20d"]),
    "residual_reversal": ("reversal", ["ret_60d", "volatility_20d"]),
}
#: What the formulas say where the results of the pass over dates are columns.
ENGINE_CROSSED = {"relative_liquidity_strength_20d": safe("amount_mean_20d", "amount_mean_all"), "relative_vol_adjusted_liquidity_20d": "rank_rvl", "momentum_rank_churn_20d": "rank_churn"}


def _crosses(text: str) -> bool:
    return "partition by td" in text


def engine_stages() -> list[dict[str, str]]:
    """The stages by symbol alone: those of BASE and ENGINE_BASE without cross-sections and what is made of them."""
    later = {"rank_ret_20_lag", "rank_move", "herding"}
    stages = [{n: t for n, t in stage.items() if not _crosses(t) and n not in later} for stage in [*BASE, *ENGINE_BASE[:4]]]
    return [s for s in stages if s]
