"""Which tickers still need data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import vendor_ticker
from .landed import FILING_SOURCE

GRACE_DAYS = 3
MIN_BARS = 10


def _wanted(tickers: DataFrame) -> DataFrame:
    return tickers.select(vendor_ticker(F.col("ticker")).alias("ticker"))


def tickers_missing_prices(prices: DataFrame, tickers: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Wanted tickers whose bars do not reach from `start` to three days before `end` with more than ten rows."""
    covered = prices.groupBy("ticker").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("bars")
    ).where(
        (F.col("first") <= F.lit(start)) & (F.col("last") >= F.date_sub(F.lit(end), GRACE_DAYS))
        & (F.col("bars") > MIN_BARS)
    )
    return _wanted(tickers).join(covered, "ticker", "left_anti")


def tickers_missing_news(news: DataFrame, tickers: DataFrame, kind: str, min_rows: int) -> DataFrame:
    """Wanted tickers with fewer than `min_rows` articles: filings for kind `sec`, else all other sources."""
    if min_rows <= 0:
        return _wanted(tickers)
    of_kind = news.where(F.col("source") == FILING_SOURCE if kind == "sec" else F.col("source") != FILING_SOURCE)
    covered = of_kind.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    return _wanted(tickers).join(covered, "ticker", "left_anti")
