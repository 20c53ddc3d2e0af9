"""Schemas of the stored tables; readers and tests use them instead of inference."""
from __future__ import annotations

_TIMES = "available_at TIMESTAMP"

STOCK = "symbol STRING, name STRING, market STRING, industry STRING, shares_outstanding BIGINT, website STRING"
DAILY_PRICE = (f"symbol STRING, data_date DATE, {_TIMES}, open DECIMAL(14,4), high DECIMAL(14,4), low DECIMAL(14,4), "
               "close DECIMAL(14,4), volume BIGINT, turnover DECIMAL(20,2)")
CORPORATE_ACTION = (f"symbol STRING, data_date DATE, {_TIMES}, kind STRING, prev_close DECIMAL(14,4), "
                    "reference_price DECIMAL(14,4), value DECIMAL(14,6), adj_factor DECIMAL(12,8), "
                    "share_factor DECIMAL(12,8)")
MARKET_INDEX = f"data_date DATE, {_TIMES}, index_close DECIMAL(14,2), turnover DECIMAL(20,2)"
INSTITUTIONAL = (f"symbol STRING, data_date DATE, {_TIMES}, foreign_net BIGINT, trust_net BIGINT, "
                 "dealer_self_net BIGINT, dealer_hedge_net BIGINT")
MARGIN = (f"symbol STRING, data_date DATE, {_TIMES}, margin_buy INT, margin_sell INT, margin_balance INT, "
          "short_sell INT, short_cover INT, short_balance INT")
LENDING = f"symbol STRING, data_date DATE, {_TIMES}, sbl_short_sell BIGINT, sbl_return BIGINT, sbl_balance BIGINT"
HOLDER_LEVELS = (f"symbol STRING, data_date DATE, {_TIMES}, level INT, holder_count INT, shares BIGINT, "
                 "ratio DECIMAL(10,6)")
HOLDER_SUMMARY = (f"symbol STRING, data_date DATE, {_TIMES}, retail_ratio DECIMAL(10,6), medium_ratio DECIMAL(10,6), "
                  "large_ratio DECIMAL(10,6), super_large_ratio DECIMAL(10,6), holder_count INT")
TICK = ("seq BIGINT, symbol STRING, data_date DATE, ts TIMESTAMP, price DOUBLE, volume INT, "
        "bid_price DOUBLE, ask_price DOUBLE, side INT")
FUTURES = (f"contract STRING, contract_month STRING, data_date DATE, {_TIMES}, open DECIMAL(14,2), high DECIMAL(14,2), "
           "low DECIMAL(14,2), close DECIMAL(14,2), change DECIMAL(14,2), change_pct DOUBLE, volume BIGINT, "
           "settlement_price DECIMAL(14,2), open_interest BIGINT")
HOLDING = (f"symbol STRING, market STRING, source STRING, data_date DATE, report_date DATE, {_TIMES}, title STRING, "
           "holder_name STRING, row_seq INT, current_shares BIGINT, pledged_shares BIGINT, ingestion_mode STRING, "
           "observed_at TIMESTAMP")
DECLARATION = (f"symbol STRING, data_date DATE, row_hash STRING, {_TIMES}, market STRING, reporter_role STRING, "
               "reporter_name STRING, method_category STRING, transfer_shares BIGINT, planned_own_shares BIGINT, "
               "planned_trust_shares BIGINT, amends_report_date DATE, superseded_on DATE, ingestion_mode STRING")
COVERAGE = "dataset STRING, market STRING, data_date DATE, scope_key STRING, row_count INT, ingestion_mode STRING"
SNAPSHOT = (f"symbol STRING, data_date DATE, {_TIMES}, chip_score DOUBLE, intraday_score DOUBLE, "
            "institutional_score DOUBLE, holder_score DOUBLE, market_score DOUBLE, action STRING, entry_low DOUBLE, "
            "entry_high DOUBLE, stop_loss DOUBLE, tp1 DOUBLE, tp2 DOUBLE, risk_reward DOUBLE, reasons ARRAY<STRING>, "
            "payload STRING, config_version STRING")
