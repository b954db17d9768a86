import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import quality as Q
from quantloom.operators import universe as U
from quantloom.schemas import TABLES


def day(text):
    return dt.date.fromisoformat(text)


@pytest.mark.parametrize("moment,session,effective", [
    ("2026-06-12 21:00:00", "pre_or_post_market", "2026-06-15"),  # Friday after the close
    ("2026-06-13 15:00:00", "off_hours", "2026-06-15"),  # Saturday
    ("2026-06-15 13:29:59", "pre_or_post_market", "2026-06-16"),  # before the open: next day
    ("2026-06-15 13:30:00", "regular", "2026-06-15"),
    ("2026-06-15 19:59:59", "regular", "2026-06-15"),
    ("2026-06-15 20:00:00", "pre_or_post_market", "2026-06-16"),
    ("2026-01-15 14:29:59", "pre_or_post_market", "2026-01-16"),  # winter time
    ("2026-01-15 14:30:00", "regular", "2026-01-15"),
])
def test_session_clock(spark, moment, session, effective):
    row = Q.effective_session(spark.sql(f"SELECT TIMESTAMP_NTZ '{moment}' AS published_at")).first()
    assert (row["market_session"], row["effective_date"]) == (session, day(effective))


def bars(spark, rows):
    full = [(day(d), t, c, c, c, c, 5, None, 1.0, "x", False, False, False) for d, t, c in rows]
    return spark.createDataFrame(full, TABLES["daily_prices"])


def test_flags_look_past_missing_closes_and_zero(spark):
    rows = [("2020-01-01", "a", 10.0), ("2020-01-02", "a", None), ("2020-01-03", "a", 16.0), ("2020-01-06", "a", 0.0), ("2020-01-07", "a", 5.0)]
    flags = [r["suspicious_return"] for r in Q.flag_suspicious_returns(bars(spark, rows)).orderBy("date").collect()]
    assert flags == [False, False, True, True, False]


def test_fill_inserts_gaps_only_after_a_close_and_drops_other_days(spark):
    rows = [("2020-01-02", "a", 3.0), ("2020-01-05", "a", 4.0), ("2020-01-03", "b", None)]
    calendar = spark.createDataFrame([(day(f"2020-01-0{i}"),) for i in (1, 2, 3, 4, 6)], "date date")
    filled = {(r["ticker"], r["date"].day): r for r in Q.fill_suspended_days(bars(spark, rows), calendar).collect()}
    assert sorted(filled) == [("a", 2), ("a", 3), ("a", 4), ("a", 6), ("b", 3)]
    assert filled["a", 6]["close"] == 3.0 and filled["a", 6]["is_imputed"] and filled["a", 6]["volume"] == 0
    assert not filled["a", 2]["is_imputed"]


def test_clean_news_keeps_newest_copy_and_long_enough_text(spark):
    text = "x" * 50
    base = {"ticker": "A", "title": "t", "source": "s", "effective_date": day("2020-01-02"), "is_sec_filing": False}
    rows = [
        {**base, "news_id": "1", "body": text, "content_hash": "h", "published_at": dt.datetime(2020, 1, 1)},
        {**base, "news_id": "2", "body": text, "content_hash": "h", "published_at": dt.datetime(2020, 1, 2)},
        {**base, "news_id": "3", "body": text[1:], "content_hash": "k", "published_at": dt.datetime(2020, 1, 2)},
        {**base, "news_id": "4", "summary": text, "published_at": dt.datetime(2020, 1, 2)},
        {**base, "news_id": "5", "summary": text, "published_at": dt.datetime(2020, 1, 3)},
        {**base, "news_id": "6", "body": text, "content_hash": "z", "effective_date": None, "published_at": dt.datetime(2020, 1, 3)},
    ]
    names = TABLES["raw_news"].fieldNames()
    frame = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES["raw_news"])
    assert sorted(r["news_id"] for r in Q.clean_news(frame).collect()) == ["2", "5"]


def test_copies_are_pruned_before_the_shuffle(spark):
    frame = spark.createDataFrame([], TABLES["raw_news"])
    plan = Q.clean_news(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_point_in_time_panel_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    start = dt.date(2020, 1, 1)

    def some_day(n=120):
        return start + dt.timedelta(days=int(rng.integers(0, n)))

    spans, seen = [], set()
    for i in range(150):
        ticker, snap = f"t{rng.integers(0, 12)}", some_day()
        if (ticker, snap) in seen:
            continue
        seen.add((ticker, snap))
        spans.append((snap, ticker, "c", some_day() if rng.random() < 0.7 else None, some_day() if rng.random() < 0.7 else None, f"s{i}", "i", "x"))
    prices = [(str(start + dt.timedelta(days=n)), f"t{t}", 1.0) for t in range(13) for n in range(0, 120, 3)]
    found = U.panel_point_in_time(spark.createDataFrame(spans, TABLES["universe"]), bars(spark, prices)).collect()
    expected = {}
    for text, ticker, _ in prices:
        when = day(text)
        fits = [s for s in spans if s[1] == ticker and (s[3] or s[0]) <= when <= (s[4] or dt.date.max)]
        if fits:
            expected[when, ticker] = max(fits, key=lambda s: (s[0], s[3] is not None, s[3] or start))[5]
    assert {(r["date"], r["ticker"]): r["gics_sector"] for r in found} == expected


def test_verdict_reasons_and_choice(spark):
    spans = [(day("2020-01-01"), "t0", "c", day("2020-03-01"), day("2020-02-01"), "s", "i", "x"), (day("2020-01-01"), "t1", "c", None, None, "s", "i", "x")]
    universe, prices = spark.createDataFrame(spans, TABLES["universe"]), bars(spark, [("2020-01-05", "t1", 1.0)])
    verdict = U.pit_verdict(U.universe_coverage(universe, prices)).first()
    assert verdict["dated_ratio"] == 1.0 and not verdict["has_serious_pit_history"]
    assert verdict["rejection_reasons"] == [
        "some rows have entry_date after exit_date", "does not contain enough removed historical tickers",
        "active member count at price start is implausible", "active member count at price end is implausible",
    ]
    assert U.choose_panel(universe, prices)[1] == U.LATEST_FALLBACK
    with pytest.raises(RuntimeError):
        U.choose_panel(universe, prices, require_pit=True)
    empty = U.pit_verdict(U.universe_coverage(universe.limit(0), prices)).first()
    assert empty["total_rows"] == 0 and empty["rejection_reasons"][0] == "no constituent rows"
