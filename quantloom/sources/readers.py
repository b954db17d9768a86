"""Readers of landed files into the domain tables. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_ticker, day_from_text, nonempty, pipe_sha256, session_and_effective_date
from ..operators.quality import flag_suspicious_returns
from ..schemas import column_names
from .csv_records import read_csv

UNIVERSE_HEADER = ["date", "ticker", "company", "entry_date", "exit_date", "gics_sector", "gics_industry", "source"]
PRICE_HEADER = ["date", "ticker", "open", "high", "low", "close", "volume", "vwap", "adj_factor", "source"]
# Each value may come under either name; the first non-empty one counts.
BENCHMARK_ALIASES = {"spy_close": ["SPY", "spy_close"], "qqq_close": ["QQQ", "qqq_close"], "vix": ["VIX", "vix"]}
NEWS_FIELDS = (
    "news_id string, ticker string, title string, summary string, body string, source string, url string, "
    "published_at string, market_session string, effective_date string, is_sec_filing string, content_hash string"
)
TRUE_WORDS = ("1", "true", "yes", "y")
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def _csv(spark: SparkSession, path: str, optional: list[str]) -> DataFrame:
    """All columns as text under their header names, whatever their order; absent optional ones as NULL.

    The session reads case-insensitively, so a header such as `VIX` also answers to `vix`. All files of a folder must
    have one header: another order or other names fail the read instead of swapping columns. A quoted value may span
    lines; a large file is read by many tasks all the same (`csv_records`).
    """
    named = read_csv(spark, path)
    present = {c.lower() for c in named.columns}
    return named.withColumns({c: F.lit(None).cast("string") for c in optional if c.lower() not in present})


def _number(name: str) -> Column:
    return _known(nonempty(F.col(name)))


def _known(text: Column) -> Column:
    """A number; text that reads as NaN is missing."""
    return F.nanvl(text.cast("double"), F.lit(None).cast("double"))


def _source() -> Column:
    return F.coalesce(nonempty(F.col("source")), F.lit("csv"))


def read_universe_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, UNIVERSE_HEADER[3:])
    return rows.select(
        day_from_text(F.col("date")).alias("date"), clean_ticker(F.col("ticker")).alias("ticker"),
        F.trim("company").alias("company"), day_from_text(F.col("entry_date")).alias("entry_date"),
        day_from_text(F.col("exit_date")).alias("exit_date"),
        nonempty(F.col("gics_sector")).alias("gics_sector"), nonempty(F.col("gics_industry")).alias("gics_industry"),
        _source().alias("source"),
    )


def read_prices_csv(spark: SparkSession, path: str, threshold: float = 0.5) -> DataFrame:
    """Prices with jumps inside the file already flagged. A volume may be written as a decimal."""
    rows = _csv(spark, path, PRICE_HEADER[2:])
    prices = rows.select(
        day_from_text(F.col("date")).alias("date"), clean_ticker(F.col("ticker")).alias("ticker"),
        *[_number(c).alias(c) for c in ("open", "high", "low", "close")],
        _number("volume").cast("long").alias("volume"),
        _number("vwap").alias("vwap"), _number("adj_factor").alias("adj_factor"), _source().alias("source"),
        *[F.lit(False).alias(c) for c in ("is_suspended", "is_imputed", "suspicious_return")],
    )
    return flag_suspicious_returns(prices, threshold)


def read_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    names = [alias for aliases in BENCHMARK_ALIASES.values() for alias in aliases]
    rows = _csv(spark, path, [*names, "yield_2y", "yield_10y", "yield_spread"])
    present = set(rows.columns)
    values = {
        target: _known(F.coalesce(*[nonempty(F.col(a)) for a in aliases if a in present], F.lit(None)))
        for target, aliases in BENCHMARK_ALIASES.items()
    }
    two, ten = _number("yield_2y"), _number("yield_10y")
    return rows.select(
        day_from_text(F.col("date")).alias("date"), *[value.alias(name) for name, value in values.items()],
        two.alias("yield_2y"), ten.alias("yield_10y"), F.coalesce(_number("yield_spread"), ten - two).alias("yield_spread"),
    )


def utc_wall_clock(text: Column) -> Column:
    """A time with or without an offset, as UTC wall-clock time; without one it is UTC already."""
    dated = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    instant = F.to_timestamp_ltz(F.when(dated.rlike(OFFSET), dated).otherwise(F.concat(dated, F.lit("Z"))))
    zone = F.current_timezone()
    return F.convert_timezone(zone, F.lit("UTC"), F.to_timestamp_ntz(F.date_format(instant, "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def news_from_json(raw: DataFrame, hash_ticker: bool = False) -> DataFrame:
    """Parsed news objects (all fields text) to news rows; empty text counts as missing where a default exists.

    With `hash_ticker` the default id also covers the ticker, so one article may be kept for several tickers.
    """
    published = utc_wall_clock(F.col("published_at"))
    parsed = raw.withColumn("_published", published)
    session, effective = session_and_effective_date(F.col("_published"))
    text = F.coalesce(nonempty(F.col("body")), nonempty(F.col("summary")))
    own_hash = pipe_sha256(F.col("title"), F.col("source"), text)
    content_hash = F.coalesce(nonempty(F.col("content_hash")), own_hash)
    default_id = pipe_sha256(clean_ticker(F.col("ticker")), content_hash) if hash_ticker else content_hash
    return parsed.select(
        F.coalesce(nonempty(F.col("news_id")), default_id).alias("news_id"),
        clean_ticker(F.col("ticker")).alias("ticker"), F.trim("title").alias("title"),
        "summary", "body", F.trim("source").alias("source"), "url", F.col("_published").alias("published_at"),
        F.coalesce(nonempty(F.col("market_session")), session).alias("market_session"),
        F.coalesce(day_from_text(F.col("effective_date")), effective).alias("effective_date"),
        F.coalesce(F.lower(F.trim("is_sec_filing")).isin(*TRUE_WORDS), F.lit(False)).alias("is_sec_filing"),
        content_hash.alias("content_hash"),
    ).select(*column_names("raw_news"))


def read_news_jsonl(spark: SparkSession, path: str, hash_ticker: bool = False) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a malformed line fails the read."""
    raw = spark.read.schema(NEWS_FIELDS).option("primitivesAsString", True).option("mode", "FAILFAST").json(path)
    return news_from_json(raw, hash_ticker)
