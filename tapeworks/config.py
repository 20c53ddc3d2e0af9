"""Thresholds of the scoring, decision and validation rules.

Fixed values: they must equal the published thresholds for results to agree.
"""
from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Mapping
from typing import Any

DEFAULTS: dict[str, Any] = {
    "scoring": {"mapping": "percentile"},
    "signal": {"buy": 75.0, "watch": 65.0, "reduce": 50.0, "exit": 40.0},
    "risk": {
        "atr_stop": 1.5, "swing_buffer_atr": 0.2, "max_stop_pct": 0.06,
        "tp1_r": 2.0, "tp2_r": 3.0, "zone_low_atr": 0.25, "zone_high_atr": 0.15,
        "min_risk_pct": 0.01, "resistance_rows": 20, "resistance_min_rows": 20,
        "breakout_policy": "watch", "breakout_atr": 4.0,
    },
    "entry": {
        "lock_min_change": 0.095, "min_rr": 2.0, "max_vwap_dev": 0.08,
        "max_ma_dev": 0.12, "min_turnover": 20_000_000.0, "strong_bear": -0.5,
    },
    "exit": {"distribution": False, "cvd_slope_max": 0.0, "large_delta_max": 0.0},
    "features": {
        "window_days": 100, "flow_days": 5, "ma_rows": 20, "atr_rows": 14,
        "swing_rows": 10, "lending_days": 20, "industry_min": 5,
        "winsor_q": 0.01, "z_clip": 5.0, "holder_days": 60,
    },
    "large_trade": {"quantile": 0.95, "min_samples": 500},
    "holders": {"retail_max": 50_000, "large_min": 400_000, "super_min": 1_000_000,
                "change_coverage_min": 0.5, "lag_days": 5},
    "divergence": {"windows": [20, 60], "price_eps": 0.03, "flow_eps": 0.02, "min_points": 10},
    "cost_basis": {"state_eps": 0.01},
    "alerts": {"actions": ["BUY", "AVOID"], "lookback_days": 10, "min_turnover": 0.0},
    "heat": {"market_top": 300, "industry_days": 20, "industry_min": 5, "stock_days": 60},
    "backtest": {
        "fee": 0.001425, "tax": 0.003, "slippage": 0.001,
        "horizons": [1, 3, 5, 10, 20], "entry": "open",
        "buckets": [[50, 60], [60, 70], [70, 80], [80, 90], [90, 101]],
        "thresholds": [60, 65, 70, 75, 80, 85],
        "success": {"horizon": 5, "min_mfe": 0.06, "max_mae": 0.04},
    },
    "validation": {"min_names": 20},
    "filings": {"day": 21, "hour": 8, "publish_lag": 1, "stale_months": 2,
                "declaration_lag": 1, "window_days": 20, "bull_trend": 0.3, "min_honest_days": 20},
    "regime": {
        "ma_short": 20, "ma_long": 60, "slope_rows": 5, "vol_rows": 20,
        "above_short": 0.25, "above_long": 0.20, "slope": 0.20, "breadth": 0.25,
        "volatility": 0.10, "slope_scale": 0.02, "high_vol": 0.03,
    },
    "weights": {
        "composite": {"intraday": 0.35, "institutional": 0.30, "holder": 0.25, "market": 0.10},
        "intraday": {"large_trade_delta": 0.30, "cvd": 0.25, "absorption": 0.20,
                     "cvd_slope": 0.10, "trade_speed": 0.10, "price_efficiency": 0.05},
        "institutional": {"trust": 0.30, "foreign": 0.25, "dealer": 0.10,
                          "margin_change": -0.15, "sbl_change": 0.0, "short_change": -0.10},
        "holder": {"large": 0.60, "retail": -0.25, "count": -0.15},
        "market": {"trend": 0.65, "industry": 0.0},
    },
}

# Sections whose change makes stored features and scores out of date.
DATA_SECTIONS = ("scoring", "signal", "risk", "entry", "exit", "features", "large_trade",
                 "holders", "regime", "weights")


def settings(overrides: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, Any]:
    """Defaults with per-section overrides, e.g. ``{"signal": {"buy": 80}}``."""
    out = copy.deepcopy(DEFAULTS)
    for section, values in (overrides or {}).items():
        out[section].update(values)
    return out


def version_of(cfg: Mapping[str, Any]) -> str:
    """12-hex fingerprint of the data-affecting sections; stamped on every output row."""
    picked = {k: cfg[k] for k in DATA_SECTIONS}
    return hashlib.sha256(json.dumps(picked, sort_keys=True).encode()).hexdigest()[:12]
