"""Price and news cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_ticker, session_and_effective_date
from ..schemas import column_names

MIN_NEWS_CHARS = 50
IMPUTED_SOURCE = "imputed_previous_close"
TEXTS = ("summary", "body")


def flag_suspicious_returns(prices: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Flag a close that moved more than `threshold` from the last known earlier close of its ticker; NaN is unknown."""
    earlier = by_ticker().rowsBetween(Window.unboundedPreceding, -1)
    close = F.nanvl(F.col("close").cast("double"), F.lit(None).cast("double"))
    previous = F.last(close, ignorenulls=True).over(earlier)
    jumped = F.abs(F.try_divide(close, previous) - 1) > threshold
    flag = F.coalesce("suspicious_return", F.lit(False)) | F.coalesce(jumped, F.lit(False))
    return prices.withColumn("suspicious_return", flag)


def fill_suspended_days(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Insert a bar at the last close for each calendar day a ticker has no row, once it has had a close.

    Each bar looks ahead to the next bar of its ticker and emits just the calendar positions between the two, so only
    rows of the result are ever produced. Rows on days outside the calendar are dropped. `calendar` has one row per
    trading day in column `date`, which bounds it, and it is broadcast.
    """
    days = calendar.select("date").distinct().withColumn(
        "_day", F.row_number().over(Window.orderBy("date"))
    )
    on_calendar = prices.join(F.broadcast(days), "date")
    known = F.last("close", ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    following = F.coalesce(F.lead("_day").over(by_ticker()), days.agg(F.max("_day") + 1).scalar())
    bars = on_calendar.withColumn("_known", known).withColumn("_next", following)
    gaps = (
        bars.where(F.col("_known").isNotNull() & (F.col("_next") > F.col("_day") + 1))
        .select("ticker", "_known", F.explode(F.sequence(F.col("_day") + 1, F.col("_next") - 1)).alias("_day"))
        .join(F.broadcast(days), "_day")
    )
    filled = gaps.select(
        "date", "ticker",
        *[F.col("_known").alias(c) for c in ("open", "high", "low", "close")],
        F.lit(0).cast("long").alias("volume"),
        F.lit(None).cast("double").alias("vwap"), F.lit(None).cast("double").alias("adj_factor"),
        F.lit(IMPUTED_SOURCE).alias("source"),
        F.lit(True).alias("is_suspended"), F.lit(True).alias("is_imputed"), F.lit(False).alias("suspicious_return"),
    )
    return bars.select(*filled.columns).unionByName(filled)


def prices_clean(prices: DataFrame) -> DataFrame:
    """The price columns without ingestion bookkeeping. Nothing is filtered."""
    return prices.select(*column_names("daily_prices"))


def with_texts(news: DataFrame, texts: DataFrame) -> DataFrame:
    """Articles whose texts lie apart, with them: `text_id` is the key of `texts` (text_id, summary, body).

    The texts are shuffled once, however many articles share one; the result carries one for each article and is best
    not shuffled or written again. News columns come first, in their order.
    """
    names = column_names("raw_news")
    others = [c for c in news.columns if c not in (*names, "text_id")]
    return news.join(texts, "text_id").select(*[c for c in names if c in (*news.columns, *TEXTS)], *others)


def clean_news(news: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Usable articles, the newest of each group of copies.

    `row_number() = 1` lets Spark drop copies on the map side, so a large group of copies is never shuffled whole. With
    `texts`, `news` has a `text_id` in place of summary and body and so has the result; texts are looked at (`with_texts`)
    but don't take part in the shuffle by copies.
    """
    whole = news if texts is None else with_texts(news.withColumn("_text_id", F.col("text_id")), texts).withColumnRenamed("_text_id", "text_id")
    usable = (F.length(F.coalesce("body", "summary", F.lit(""))) >= MIN_NEWS_CHARS) & F.col("effective_date").isNotNull()
    copies = Window.partitionBy(
        "ticker", "effective_date", F.coalesce(F.col("content_hash"), F.concat("title", "source"))
    ).orderBy(F.desc("published_at"), "news_id")
    kept = whole.where(usable).select(*news.columns)
    return kept.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1").drop("_copy")


def effective_session(df: DataFrame, ts_col: str = "published_at") -> DataFrame:
    """Add `market_session` and `effective_date` for a UTC wall-clock column."""
    session, effective = session_and_effective_date(F.col(ts_col))
    return df.withColumns({"market_session": session, "effective_date": effective})
