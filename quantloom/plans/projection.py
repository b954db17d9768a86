"""Derive the domain tables (prices, universe, benchmark, news) from the star-schema test tables.

Each table is computed from whole inputs, written once per session and input folder, and then shared by the
operators, as a stored table would be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import by_ticker, pipe_sha256, rolling, session_and_effective_date
from ..operators.quality import TEXTS, with_texts
from ..schemas import column_names
from ..session import materialize

MARKET = "SPY"
SMOOTHING_ROWS = 20
FIRST_SNAPSHOT = "1995-01-02"
SECOND_SNAPSHOT = "1998-01-05"
EXIT_DAY = "2000-06-30"

_stored: dict[tuple[str, str, str], DataFrame] = {}
_derived: dict[tuple[str, str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = materialize(build(spark, sf_dir), name)
    return _stored[key]


def derived(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What `build` makes of stored tables, planned once per session and folder, not written: a reader computes its columns only."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _derived:
        _derived[key] = build(spark, sf_dir)
    return _derived[key]


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "daily_prices", daily_bars)


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "universe", _universe)


def benchmark_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "benchmark_daily", _benchmark_daily)


def raw_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their texts. Not stored: texts that many articles share would be written once for each."""
    return with_texts(article_refs(spark, sf_dir), news_texts(spark, sf_dir))


def article_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with `text_id` in place of summary and body."""
    return stored(spark, sf_dir, "raw_news", _article_refs)


def news_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as a summary and, under a `text_id` of its own, as a body."""
    rows = numbered_documents(spark, sf_dir)
    nothing = F.lit(None).cast("string")
    summaries = rows.select((F.col("row") * 2).alias("text_id"), F.col("text").alias("summary"), nothing.alias("body"))
    return summaries.unionByName(rows.select((F.col("row") * 2 + 1).alias("text_id"), nothing.alias("summary"), F.col("text").alias("body")))


def numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a number for each row, as ids may repeat; written, so that a row keeps its number."""
    return stored(spark, sf_dir, "documents", lambda s, p: read_table(s, p, "documents").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source"
    ))


def ticker_of(number: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(number.cast("string"), 10, "0"))


def _spread(df: DataFrame) -> DataFrame:
    """Give every core work where an input has fewer splits than there are cores, as small test files do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _week(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per supplier and, as ticker SPY, over all suppliers. Sums are of whole cents, hence exact.

    Rows are exchanged once, by ticker; that serves the sums, these windows and any later window or join by ticker.
    """
    rows = read_table(spark, sf_dir, "lineitem").select(
        ticker_of(F.col("l_suppkey")).alias("ticker"), _week(F.col("l_shipdate")).alias("date"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("volume"),
    )
    sums = [F.sum("cents").alias("cents"), F.sum("volume").alias("volume")]
    market = rows.groupBy("date").agg(*sums).select(F.lit(MARKET).alias("ticker"), "date", "cents", "volume")
    bars = rows.union(market).repartition("ticker").groupBy("ticker", "date").agg(*sums)
    unit = F.try_divide(F.col("cents"), F.col("volume") * F.lit(100.0))
    bars = bars.withColumn("unit", unit).withColumn(
        "close", F.avg("unit").over(rolling(by_ticker(), SMOOTHING_ROWS))
    )
    return bars.withColumn("open", F.lag("close").over(by_ticker())).select(
        "date", "ticker", "open",
        F.greatest("open", "close").alias("high"),
        F.least("open", "close").alias("low"),
        "close", "volume",
        F.col("close").alias("vwap"),
        F.lit(1.0).alias("adj_factor"),
        F.lit("lineitem").alias("source"),
        F.lit(False).alias("is_suspended"),
        F.lit(False).alias("is_imputed"),
        F.lit(False).alias("suspicious_return"),
    )


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two membership snapshots: all suppliers first, then every third one re-classified to its nation."""
    key = F.col("s_suppkey")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    members = (
        read_table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    exit_date = F.when(key % 7 == 0, F.lit(EXIT_DAY).cast("date"))
    first = members.select(
        F.lit(FIRST_SNAPSHOT).cast("date").alias("date"), ticker_of(key).alias("ticker"),
        F.col("s_name").alias("company"),
        F.date_add(F.lit(FIRST_SNAPSHOT).cast("date"), (key % 5 * 90).cast("int")).alias("entry_date"),
        exit_date.alias("exit_date"), F.col("r_name").alias("gics_sector"), F.col("n_name").alias("gics_industry"),
        F.lit("suppliers").alias("source"),
    )
    second = members.where(key % 3 == 0).select(
        F.lit(SECOND_SNAPSHOT).cast("date").alias("date"), ticker_of(key).alias("ticker"),
        F.col("s_name").alias("company"), F.lit(None).cast("date").alias("entry_date"),
        exit_date.alias("exit_date"), F.col("n_name").alias("gics_sector"), F.col("n_name").alias("gics_industry"),
        F.lit("suppliers").alias("source"),
    )
    return first.unionByName(second)


def _benchmark_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = [F.lit(None).cast("double").alias(c) for c in ("qqq_close", "vix", "yield_2y", "yield_10y", "yield_spread")]
    market = daily_bars(spark, sf_dir).where(F.col("ticker") == MARKET)
    return market.select("date", F.col("close").alias("spy_close"), *missing)


def _article_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per order, with the whole text of a document; every fourth one lacks a content hash."""
    orders = _spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"))
    documents = numbered_documents(spark, sf_dir)
    suppliers = read_table(spark, sf_dir, "supplier").count()
    key = F.col("o_orderkey")
    published = F.date_trunc("week", "o_orderdate") + F.make_dt_interval(
        hours=F.lit(14), mins=(key % 360).cast("int")
    )
    joined = orders.withColumn("doc_id", key % F.lit(documents.count())).join(documents, "doc_id")
    news = joined.select(
        F.concat(F.lit("n"), key.cast("string")).alias("news_id"),
        ticker_of(key % F.lit(suppliers)).alias("ticker"),
        F.concat_ws(" ", "o_orderpriority", "source").alias("title"),
        F.when(key % 10 == 0, F.lit("SEC EDGAR")).otherwise(F.col("source")).alias("source"),
        F.lit(None).cast("string").alias("url"),
        published.cast("timestamp_ntz").alias("published_at"),
        (key % 10 == 0).alias("is_sec_filing"),
        # Even keys have their text as a summary, odd ones as a body.
        (F.col("row") * 2 + F.when(key % 2 == 0, 0).otherwise(1)).alias("text_id"), "text",
    )
    session, effective = session_and_effective_date(F.col("published_at"))
    has_hash = F.substring("news_id", 2, 20).cast("long") % 4 != 0
    return news.select(
        "*", session.alias("market_session"), effective.alias("effective_date"),
        F.when(has_hash, pipe_sha256(F.col("title"), F.col("source"), F.col("text"))).alias("content_hash"),
    ).select(*[c for c in column_names("raw_news") if c not in TEXTS], "text_id")
