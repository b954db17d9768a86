import datetime as dt
import json

import pytest

from quantloom.operators import news as N
from quantloom.schemas import SCORES, TABLES
from quantloom.sinks import tables as K
from quantloom.sinks.snapshots import read_table
from quantloom.sources import landed as V
from quantloom.sources import readers as C


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_universe_and_prices_csv(spark, tmp_path):
    path = write(tmp_path, "u.csv", "﻿date,ticker,company,entry_date,exit_date,gics_sector,gics_industry,source\n2026-06-18, abc ,\"Example, Inc\" ,2000-01-03T00:00,,,Pharma,\n")
    row = C.read_universe_csv(spark, path).first()
    assert (row["ticker"], row["company"], row["entry_date"], row["exit_date"]) == ("ABC", "Example, Inc", dt.date(2000, 1, 3), None)
    assert (row["gics_sector"], row["source"]) == (None, "csv")
    path = write(tmp_path, "p.csv", "date,ticker,open,high,low,close,volume,vwap,adj_factor,source\n2026-06-15,AAPL,1,2,1,2,50.7,,1.0,x\n2026-06-16,AAPL,1,2,1,4,7,,1.0,\n")
    rows = C.read_prices_csv(spark, path).orderBy("date").collect()
    assert [r["volume"] for r in rows] == [50, 7] and [r["suspicious_return"] for r in rows] == [False, True]
    assert rows[0]["vwap"] is None and rows[1]["source"] == "csv"


def test_benchmark_csv_aliases_and_spread(spark, tmp_path):
    path = write(tmp_path, "b.csv", "date,SPY,QQQ,VIX,yield_2y,yield_10y\n2024-03-04,410.25,388.50,21.5,3.10,2.85\n2024-03-05,409.75,391.00,NaN,,2.80\n")
    rows = C.read_benchmark_csv(spark, path).orderBy("date").collect()
    assert rows[0]["yield_spread"] == pytest.approx(-0.25) and rows[1]["yield_spread"] is None
    assert rows[0]["spy_close"] == 410.25 and rows[0]["vix"] == 21.5 and rows[1]["vix"] is None
    lower = write(tmp_path, "l.csv", "date,spy_close,qqq_close,vix,yield_2y,yield_10y,yield_spread\n2026-06-15,1,2,3,4,5,9\n")
    row = C.read_benchmark_csv(spark, lower).first()
    assert (row["spy_close"], row["qqq_close"], row["vix"], row["yield_spread"]) == (1.0, 2.0, 3.0, 9.0)


def test_news_jsonl(spark, tmp_path):
    base = {"ticker": "aapl", "title": " T ", "source": "S", "summary": "sum", "body": ""}
    lines = [
        {**base, "published_at": "2026-06-15T20:30:00Z", "is_sec_filing": "Yes"},
        {**base, "published_at": "2026-06-15T16:30:00-04:00", "is_sec_filing": True, "news_id": "n2"},
        {**base, "published_at": "2026-06-15T14:30:00", "market_session": "given", "effective_date": "2026-01-01"},
    ]
    path = write(tmp_path, "n.jsonl", "\n\n".join(json.dumps(x) for x in lines) + "\n")
    rows = C.read_news_jsonl(spark, path).collect()
    assert [r["published_at"].hour for r in rows] == [20, 20, 14]
    assert [r["is_sec_filing"] for r in rows] == [True, True, False]
    assert (rows[0]["market_session"], rows[0]["effective_date"]) == ("pre_or_post_market", dt.date(2026, 6, 16))
    assert (rows[2]["market_session"], rows[2]["effective_date"]) == ("given", dt.date(2026, 1, 1))
    assert rows[0]["news_id"] == rows[0]["content_hash"] and rows[1]["news_id"] == "n2" and rows[0]["ticker"] == "AAPL"


def test_nested_news_shapes(spark):
    nested = {"content": {"title": "A", "summary": "s", "pubDate": "2026-06-15T15:00:00Z", "provider": {"displayName": "P"}, "clickThroughUrl": {"url": "u"}}}
    flat = {"title": "B", "publisher": "Q", "link": "v", "providerPublishTime": 1781535600}
    landed = spark.createDataFrame([("aa", json.dumps(nested)), ("aa", json.dumps(flat)), ("aa", json.dumps({"content": {}}))], "ticker string, payload string")
    rows = {r["title"]: r for r in V.normalize_nested_news(landed).collect()}
    assert set(rows) == {"A", "B"}
    assert (rows["A"]["source"], rows["A"]["url"], rows["A"]["market_session"]) == ("P", "u", "regular")
    assert (rows["B"]["source"], rows["B"]["url"], rows["B"]["summary"]) == ("Q", "v", "B")
    assert rows["B"]["published_at"] == dt.datetime(2026, 6, 15, 15)


def test_filings_limit_counts_kept_forms(spark):
    recent = {"form": ["4", "8-K", "10-Q", "10-K"], "filingDate": ["2026-01-05"] * 4, "accessionNumber": ["0-1", "0-2", "0-3", "0-4"], "primaryDocument": ["a", "b", "c", "d"]}
    landed = spark.createDataFrame([("x.y", 7, json.dumps({"filings": {"recent": recent}}))], "ticker string, cik long, payload string")
    rows = V.explode_filings(landed, limit_per_ticker=2).orderBy("url").collect()
    assert [r["title"] for r in rows] == ["X-Y SEC filing: 8-K filed 2026-01-05", "X-Y SEC filing: 10-Q filed 2026-01-05"]
    assert rows[0]["url"].endswith("/7/02/b") and rows[0]["is_sec_filing"]
    assert V.explode_filings(landed, since=dt.date(2026, 2, 1)).isEmpty()


def test_wide_prices_drop_empty_rows(spark):
    wide = spark.createDataFrame([("2026-01-05", 1.0, float("nan"), float("nan")), ("2026-01-06", 2.0, 3.0, 9.0)], "Date string, `aa|Close` double, `bb|Close` double, `bb|Volume` double")
    rows = {(r["ticker"], r["date"].day): r for r in V.prices_from_wide(wide).collect()}
    assert sorted(rows) == [("AA", 5), ("AA", 6), ("BB", 6)] and rows["BB", 6]["volume"] == 9 and rows["AA", 5]["open"] is None


def test_snapshot_needs_its_columns(spark):
    with pytest.raises(ValueError):
        V.universe_from_snapshot(spark.createDataFrame([("A",)], "Symbol string"), dt.date(2026, 1, 1))


def test_lexicon_scores(spark):
    frame = spark.createDataFrame(
        [("Profit Surge!", "\"growth\", (lawsuit) growth", False, None), ("plain", None, True, "regular")],
        "title string, summary string, is_sec_filing boolean, market_session string",
    )
    first, second = N.score_news_lexicon(frame).collect()
    assert first["sentiment"] == pytest.approx(0.5) and first["risk"] == pytest.approx(0.40) and first["surprise"] == pytest.approx(0.2)
    assert first["revenue_impact"] == pytest.approx(0.4) and first["margin_impact"] == pytest.approx(0.25) and first["confidence"] == pytest.approx(0.85)
    assert second["importance"] == pytest.approx(0.25 + 6 / 800 + 0.15) and second["surprise"] == pytest.approx(0.1)


def test_scorer_responses_and_status(spark):
    good = dict.fromkeys(SCORES, 0.5) | {"sentiment": -3}
    bodies = [json.dumps(good), json.dumps({k: 0.1 for k in SCORES[1:]}), "{broken"]
    rows = [(str(i), "A", dt.date(2026, 1, 5), json.dumps({"choices": [{"message": {"content": b}}]})) for i, b in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "news_id string, ticker string, effective_date date, response string")
    got = N.apply_score_status(N.parse_scored_responses(frame), "v").orderBy("news_id").collect()
    assert [r["score_status"] for r in got] == ["success", "failed", "failed"]
    assert got[0]["sentiment"] == -1.0 and got[0]["error_message"] is None
    assert got[1]["importance"] is None and got[2]["error_message"]


def test_upsert_last_row_wins_and_other_partitions_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "date string, k int, v int, seq int"
    K.upsert_table(spark, path, spark.createDataFrame([("d1", 1, 1, 0), ("d2", 1, 1, 0)], schema), ["date", "k"], "date", "seq")
    K.upsert_table(spark, path, spark.createDataFrame([("d1", 1, 5, 1), ("d1", 1, 6, 2), ("d1", 2, 7, 3)], schema), ["date", "k"], "date", "seq")
    assert sorted(tuple(r) for r in read_table(spark, path).select("date", "k", "v").collect()) == [("d1", 1, 6), ("d1", 2, 7), ("d2", 1, 1)]
    assert set(TABLES) >= {"daily_prices", "backtest_trades"}


def test_upsert_table_loses_no_row(spark, tmp_path):
    path = str(tmp_path / "t")
    K.upsert_table(spark, path, spark.createDataFrame([("d1", "a", 1.0), ("d1", "b", 2.0), ("d2", "c", 3.0)], "d string, k string, v double"), ["k"], "d")
    K.upsert_table(spark, path, spark.createDataFrame([("x", "a", "d1", 9.0)], "more string, k string, d string, v double"), ["k"], "d")
    K.upsert_table(spark, path, spark.createDataFrame([("d3", "c")], "d string, k string"), ["k"], "d")
    rows = read_table(spark, path).orderBy("k").collect()
    assert [(r["d"], r["k"], r["v"], r["more"]) for r in rows] == [("d1", "a", 9.0, "x"), ("d1", "b", 2.0, None), ("d3", "c", None, None)]


def test_an_empty_version_replaces_the_old_one(spark, tmp_path):
    path, rows = str(tmp_path / "m"), spark.createDataFrame([("t", 1.0)], "ticker string, v double")
    K.replace_model_version(rows, path, "a")
    K.replace_model_version(rows, path, "b")
    K.replace_model_version(rows.limit(0), path, "b")
    assert [r["model_version"] for r in read_table(spark, path).collect()] == ["a"]


def test_csv_with_quoted_newline_and_with_differing_headers(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'date,ticker,company,entry_date,exit_date\n2022-05-02,QQ,"Two\nlines",2001-02-03,\n2022-05-02,RR,One,,\n')
    rows = {r["ticker"]: r["company"] for r in C.read_universe_csv(spark, path).collect()}
    assert rows == {"QQ": "Two\nlines", "RR": "One"}
    folder = tmp_path / "prices"
    folder.mkdir()
    write(folder, "a.csv", "date,ticker,open,close\n2022-05-02,QQ,1,2\n")
    write(folder, "b.csv", "date,ticker,close,open\n2022-05-03,QQ,2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        C.read_prices_csv(spark, str(folder)).collect()
