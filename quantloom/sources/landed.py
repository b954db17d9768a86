"""Landed vendor payloads (nested news, filings, membership snapshots, wide prices) to domain tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nonempty, pipe_sha256, session_and_effective_date, vendor_ticker
from ..schemas import column_names
from .readers import utc_wall_clock

# Vendor names, id prefixes, filing forms and text templates.
DEFAULT_PROVIDER = "Yahoo Finance"
NESTED_PREFIX, FILING_PREFIX = "yf_", "sec_"
FILING_SOURCE = "SEC EDGAR"
FILING_FORMS = ("8-K", "10-Q", "10-K")
FILING_HOUR = 12
FILING_URL = "https://www.sec.gov/Archives/edgar/data/{cik}/{compact}/{doc}"
SNAPSHOT_COLUMNS = ("Symbol", "Security", "GICS Sector", "GICS Sub-Industry")
SNAPSHOT_SOURCE = "wikipedia_current"
WIDE_SOURCE = "yfinance"
WIDE_FIELDS = ("Open", "High", "Low", "Close", "Volume")


#: Members looked up at the root of a payload and in its `content` object, one parse each.
ROOT_MEMBERS = ("content", "title", "summary", "publisher", "link", "providerPublishTime")
ARTICLE_MEMBERS = ("title", "summary", "description", "provider", "clickThroughUrl", "canonicalUrl", "pubDate", "providerPublishTime")


def _first_text(*values: str) -> Column:
    """The first non-empty of several columns. Objects count as their JSON text; an empty object is empty."""
    return F.coalesce(*[F.nullif(nonempty(F.col(value)), F.lit("{}")) for value in values])


def _member_or_text(value: Column, member: str) -> Column:
    """A field of a JSON object, or the value itself when it is plain text."""
    return F.when(value.startswith("{"), F.get_json_object(value, f"$.{member}")).otherwise(value)


def normalize_nested_news(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Nested vendor articles (`ticker`, JSON text `payload`) to news rows; articles without a title are dropped.

    Fields are looked up in the `content` object if there is one, else at the root.
    """
    root = landed.select("*", F.json_tuple(payload, *ROOT_MEMBERS).alias(*[f"_root_{m}" for m in ROOT_MEMBERS]))
    article = F.when(F.col("_root_content").startswith("{"), F.col("_root_content")).otherwise(F.col(payload))
    members = root.select("*", F.json_tuple(article, *ARTICLE_MEMBERS).alias(*[f"_in_{m}" for m in ARTICLE_MEMBERS])).drop("_root_content", payload)
    found = members.withColumns({
        "title": _first_text("_in_title", "_root_title"),
        "_summary": _first_text("_in_summary", "_in_description", "_root_summary"),
        "_provider": _first_text("_in_provider", "_root_publisher"),
        "_link": _first_text("_in_clickThroughUrl", "_in_canonicalUrl", "_root_link"),
        "_time": _first_text("_in_pubDate", "_in_providerPublishTime", "_root_providerPublishTime"),
    }).where(F.col("title").isNotNull())
    epoch = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(F.col("_time").try_cast("double")).cast("timestamp_ntz")
    )
    numeric = F.col("_time").rlike(r"^\d+(\.\d+)?$")
    published = F.when(numeric, epoch).when(F.col("_time").isNotNull(), utc_wall_clock(F.col("_time"))).otherwise(
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
    )
    shaped = found.withColumns({
        "source": F.coalesce(nonempty(_member_or_text(F.col("_provider"), "displayName")), F.lit(DEFAULT_PROVIDER)),
        "url": nonempty(_member_or_text(F.col("_link"), "url")),
        "published_at": published,
    })
    print_ = pipe_sha256(F.col("ticker"), F.col("title"), F.col("_summary"), F.col("source"), F.col("url"))
    session, effective = session_and_effective_date(F.col("published_at"))
    text = F.coalesce("_summary", "title")
    return shaped.withColumns({
        "content_hash": print_, "news_id": F.concat(F.lit(NESTED_PREFIX), print_), "ticker": F.upper("ticker"),
        "summary": text, "body": text, "market_session": session, "effective_date": effective,
        "is_sec_filing": F.lit(False),
    }).select(*[c for c in landed.columns if c not in ("ticker", payload)], *column_names("raw_news"))


def limit_new_per_ticker(landed: DataFrame, limit_per_ticker: int = 10, payload: str = "payload") -> DataFrame:
    """News rows from the first `limit_per_ticker` articles of each ticker, each `news_id` once, first seen first.

    `landed` has `ticker`, `seq` (order of arrival) and `payload`. The last arrival that counts is found for each ticker from
    tickers and numbers alone and sent to all tasks, as tickers are bounded; only articles up to it are shuffled.
    """
    tidy = landed.withColumn("ticker", vendor_ticker(F.col("ticker"))).where(F.col("ticker") != "")
    arrival = Window.partitionBy("ticker").orderBy("seq")
    last = (
        tidy.select("ticker", "seq").withColumn("_rn", F.row_number().over(arrival)).where(F.col("_rn") == limit_per_ticker)
        .select(F.col("ticker").alias("_full"), F.col("seq").alias("_last"))
    )
    # NULL arrives first; a ticker with fewer articles keeps all.
    early = F.col("_full").isNull() | F.col("seq").isNull() | (F.col("seq") <= F.col("_last"))
    within = tidy.join(F.broadcast(last), F.col("ticker") == F.col("_full"), "left").where(early).drop("_full", "_last")
    first = within.withColumn("_rn", F.row_number().over(arrival)).where(F.col("_rn") <= limit_per_ticker).drop("_rn")
    news = normalize_nested_news(first, payload)
    seen = Window.partitionBy("news_id").orderBy("seq", "ticker")
    once = news.withColumn("_rn", F.row_number().over(seen)).where("_rn = 1")
    return once.select(*column_names("raw_news"))


_RECENT = (
    "struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>"
)


def explode_filings(
    landed: DataFrame, forms: Sequence[str] = FILING_FORMS, since: dt.date | None = None, limit_per_ticker: int = 20,
    payload: str = "payload",
) -> DataFrame:
    """Filing payloads (`ticker`, `cik`, JSON text of four parallel arrays) to news rows.

    A row carries one array, so the limit is a slice of the filtered array and needs no shuffle.
    """
    recent = F.from_json(F.get_json_object(payload, "$.filings.recent"), _RECENT)
    parsed = landed.withColumns({"ticker": vendor_ticker(F.col("ticker")), "_recent": recent})
    arrays = [F.col("_recent").getField(name) for name in ("form", "filingDate", "accessionNumber", "primaryDocument")]
    shortest = F.least(*[F.size(F.coalesce(a, F.array().cast("array<string>"))) for a in arrays])
    rows = F.slice(F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, ("form", "filed", "accession", "doc"))]), F.lit(1), shortest)

    def wanted(filing: Column) -> Column:
        allowed = filing["form"].isin(*forms)
        return allowed if since is None else allowed & (filing["filed"].cast("date") >= F.lit(since))

    kept = F.slice(F.filter(rows, wanted), 1, limit_per_ticker)
    filings = parsed.where((F.col("ticker") != "") & F.col("cik").isNotNull()).select(
        "ticker", F.col("cik").cast("string").alias("cik"), F.inline(kept)
    )
    compact = F.replace("accession", F.lit("-"), F.lit(""))
    pieces = FILING_URL.replace("{cik}", "|cik|").replace("{compact}", "|compact|").replace("{doc}", "|doc|").split("|")
    named = {"cik": F.col("cik"), "compact": compact, "doc": F.col("doc")}
    url = F.concat(*[named.get(piece, F.lit(piece)) for piece in pieces if piece])
    filed = F.col("filed").cast("date")
    published = filed.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(FILING_HOUR))
    session, effective = session_and_effective_date(F.col("published_at"))
    summary = F.concat(
        "ticker", F.lit(" filed Form "), "form", F.lit(" with the SEC on "), "filed", F.lit(". Accession number: "),
        "accession", F.lit("."),
    )
    shaped = filings.withColumns({
        "url": url, "published_at": published, "summary": summary, "body": summary,
        "title": F.concat("ticker", F.lit(" SEC filing: "), "form", F.lit(" filed "), "filed"),
        "source": F.lit(FILING_SOURCE), "is_sec_filing": F.lit(True),
    })
    print_ = pipe_sha256(F.col("ticker"), F.col("form"), F.col("filed"), F.col("accession"), F.col("url"))
    return shaped.withColumns({
        "content_hash": print_, "news_id": F.concat(F.lit(FILING_PREFIX), print_),
        "market_session": session, "effective_date": effective,
    }).select(*column_names("raw_news"))


def universe_from_snapshot(landed: DataFrame, as_of: dt.date) -> DataFrame:
    """A landed table of current members to universe rows stamped `as_of`, without membership dates."""
    missing = sorted(set(SNAPSHOT_COLUMNS) - set(landed.columns))
    if missing:
        raise ValueError(f"Membership snapshot lacks columns: {missing}")
    unknown = F.lit(None).cast("date")
    return landed.select(
        F.lit(as_of).cast("date").alias("date"), vendor_ticker(F.col("Symbol")).alias("ticker"),
        F.col("Security").alias("company"), unknown.alias("entry_date"), unknown.alias("exit_date"),
        F.col("`GICS Sector`").alias("gics_sector"), F.col("`GICS Sub-Industry`").alias("gics_industry"),
        F.lit(SNAPSHOT_SOURCE).alias("source"),
    )


def prices_from_wide(landed: DataFrame, separator: str = "|") -> DataFrame:
    """A wide vendor frame (`Date`, then `TICKER|Open` ... `TICKER|Volume`) to price rows.

    Not-a-number becomes NULL and rows without any value are dropped. Jumps are not flagged on this path.
    """
    tickers = dict.fromkeys(c.rsplit(separator, 1)[0] for c in landed.columns if separator in c)
    bars = F.array(*[
        F.struct(F.lit(ticker.upper()).alias("ticker"), *[
            (F.nanvl(F.col(f"`{ticker}{separator}{f}`").cast("double"), F.lit(None).cast("double"))
             if f"{ticker}{separator}{f}" in landed.columns else F.lit(None).cast("double")).alias(f.lower())
            for f in WIDE_FIELDS
        ])
        for ticker in tickers
    ])
    long = landed.select(F.to_date("Date").alias("date"), F.inline(bars))
    fields = [f.lower() for f in WIDE_FIELDS]
    return long.where(F.coalesce(*fields).isNotNull()).select(
        "date", "ticker", "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"),
        F.lit(None).cast("double").alias("vwap"), F.lit(1.0).alias("adj_factor"), F.lit(WIDE_SOURCE).alias("source"),
        *[F.lit(False).alias(c) for c in ("is_suspended", "is_imputed", "suspicious_return")],
    )
