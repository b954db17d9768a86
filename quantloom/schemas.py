"""Schemas and keys of the domain tables. Readers never infer a type."""

from __future__ import annotations

from pyspark.sql import types as T

# Factor and feature names and label horizons.
TRADITIONAL_FACTORS = [
    "momentum_5d", "momentum_20d", "momentum_60d", "volatility_20d", "volume_change_5d",
    "rsi_14", "market_return_5d", "sector_return_5d", "beta",
]
NEWS_FACTORS = [
    "news_sentiment", "news_importance", "news_surprise", "news_risk",
    "news_revenue_impact", "news_margin_impact", "news_coverage", "news_ai_score",
]
ALL_FACTORS = TRADITIONAL_FACTORS + NEWS_FACTORS
FEATURES = [f"z_{name}" for name in ALL_FACTORS if name != "news_coverage"]
HORIZONS = (1, 5, 10, 20)
SCORES = ["sentiment", "importance", "surprise", "risk", "revenue_impact", "margin_impact", "confidence"]
MODEL_COLUMNS = {"lightgbm": "lightgbm_pred", "xgboost": "xgboost_pred", "rf": "rf_pred"}
PREDICTION = "predicted_excess_return_5d"
TARGET = "future_excess_return_5d"


def _doubles(names: list[str]) -> str:
    return ", ".join(f"{name} double" for name in names)


_PRICE_BASE = (
    "date date, ticker string, open double, high double, low double, close double, volume bigint, vwap double, "
    "adj_factor double, source string, is_suspended boolean, is_imputed boolean, suspicious_return boolean"
)

_NEWS_BASE = (
    "news_id string, ticker string, title string, summary string, body string, source string, url string, "
    "published_at timestamp_ntz, market_session string, effective_date date, is_sec_filing boolean, "
    "content_hash string"
)

_COLUMNS = {
    "universe": (
        "date date, ticker string, company string, entry_date date, exit_date date, gics_sector string, "
        "gics_industry string, source string"
    ),
    "daily_prices": _PRICE_BASE,
    "benchmark_daily": "date date, " + _doubles(["spy_close", "qqq_close", "vix", "yield_2y", "yield_10y", "yield_spread"]),
    "raw_news": _NEWS_BASE,
    "news_scores": (
        f"news_id string, ticker string, effective_date date, {_doubles(SCORES)}, score_status string, "
        "prompt_version string, error_message string"
    ),
    "news_factors_raw": f"date date, ticker string, {_doubles(NEWS_FACTORS[:6])}, news_coverage bigint",
    "news_factors": f"date date, ticker string, {_doubles(NEWS_FACTORS[:6])}, news_coverage bigint, news_ai_score double",
    "factor_table": (
        f"date date, ticker string, gics_sector string, {_doubles(ALL_FACTORS)}, "
        + _doubles([f"z_{name}" for name in ALL_FACTORS])
    ),
    "model_predictions": (
        f"date date, ticker string, {PREDICTION} double, model_version string, " + _doubles(list(MODEL_COLUMNS.values()))
    ),
    "model_registry": (
        "model_version string, trained_at timestamp_ntz, train_start date, train_end date, validation_start date, "
        "validation_end date, test_start date, test_end date, holdout_start date, holdout_end date, "
        "holdout_rows bigint, feature_columns array<string>, params map<string,string>, metrics map<string,double>, "
        "artifact_dir string, notes string"
    ),
    "trading_signals": (
        f"date date, ticker string, {PREDICTION} double, prediction_rank bigint, signal string, "
        "target_weight double, model_version string"
    ),
    "portfolio_positions": "date date, ticker string, target_weight double, model_version string",
    "backtest_results": (
        "date date, " + _doubles(["portfolio_value", "strategy_return", "benchmark_value", "benchmark_return",
                                  "drawdown", "gross_exposure", "net_exposure", "turnover"]) + ", model_version string"
    ),
    "backtest_trades": (
        "date date, ticker string, " + _doubles(["from_weight", "to_weight", "trade_weight", "trade_value",
                                                 "transaction_cost"]) + ", model_version string"
    ),
    "execution_orders": (
        "order_id string, signal_date date, order_date date, ticker string, side string, "
        + _doubles(["target_weight", "current_weight", "order_weight", "estimated_order_value"])
        + ", model_version string, status string"
    ),
    "execution_fills": (
        "fill_id string, order_id string, fill_date date, ticker string, side string, "
        + _doubles(["fill_price", "fill_shares", "fill_value", "transaction_cost"])
        + ", execution_price_model string, model_version string"
    ),
    "current_positions": (
        "as_of_date date, ticker string, " + _doubles(["shares", "market_price", "market_value", "target_weight",
                                                       "current_weight", "unrealized_pnl"]) + ", model_version string"
    ),
}

KEYS = {
    "universe": ["date", "ticker"],
    "daily_prices": ["date", "ticker"],
    "benchmark_daily": ["date"],
    "raw_news": ["news_id"],
    "news_scores": ["news_id"],
    "news_factors_raw": ["date", "ticker"],
    "news_factors": ["date", "ticker"],
    "factor_table": ["date", "ticker"],
    "model_predictions": ["date", "ticker", "model_version"],
    "model_registry": ["model_version"],
    "trading_signals": ["date", "ticker", "model_version"],
    "portfolio_positions": ["date", "ticker", "model_version"],
    "backtest_results": ["date", "model_version"],
    "execution_orders": ["order_id"],
    "execution_fills": ["fill_id"],
    "current_positions": ["as_of_date", "ticker", "model_version"],
}

_TYPES = {
    "date": T.DateType(), "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(),
    "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
}


def _struct(columns: str) -> T.StructType:
    """`StructType.fromDDL` needs a running session; these constants must not."""
    pairs = (column.split(" ") for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES = {name: _struct(columns) for name, columns in _COLUMNS.items()}


def column_names(table: str) -> list[str]:
    return TABLES[table].fieldNames()
