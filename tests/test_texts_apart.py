"""Articles whose texts lie apart: same rows, and texts stay out of what is shuffled and stored."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quantloom.operators import news as N
from quantloom.operators import quality as Q
from quantloom.plans import projection as D
from quantloom.schemas import TABLES
from quantloom.sources import landed as V

SF_DIR = "/root/testdata/sf0.001"


def articles(spark):
    """(news_id, text_id): copies, a short text, a NULL text, a NULL key and a repeated news_id."""
    at = dt.datetime(2020, 1, 1, 12)
    rows = [
        ("1", "A", "t", "s", at, "h", 0), ("2", "A", "t", "s", at + dt.timedelta(hours=1), "h", 1), ("3", "A", "t", "s", at, "k", 2),
        ("4", "B", "t", "s", at, None, 3), ("5", None, "u", "s", at, None, 0), ("6", "C", None, "s", at, None, 1), ("6", "D", "v", None, at, "h", 0),
    ]
    texts = [(0, "x" * 60, None), (1, None, "y" * 60), (2, None, "z" * 49), (3, None, None)]
    refs = spark.createDataFrame(rows, "news_id string, ticker string, title string, source string, published_at timestamp_ntz, content_hash string, text_id long")
    refs = refs.select("*", F.lit(None).cast("string").alias("url"), F.lit("regular").alias("market_session"),
                       F.lit(dt.date(2020, 1, 1)).alias("effective_date"), F.lit(False).alias("is_sec_filing"))
    return refs, spark.createDataFrame(texts, "text_id long, summary string, body string")


def test_clean_news_with_texts_apart_equals_whole_articles(spark):
    refs, texts = articles(spark)
    whole = Q.with_texts(refs, texts)
    assert whole.columns == TABLES["raw_news"].fieldNames()
    apart = Q.clean_news(refs, texts)
    assert apart.columns == refs.columns
    expected = sorted(map(str, Q.clean_news(whole).collect()))
    assert sorted(map(str, Q.with_texts(apart, texts).collect())) == expected and len(expected) == 4


def test_pending_news_with_texts_apart(spark):
    refs, texts = articles(spark)
    scores = spark.createDataFrame([("2", "v", "success")], "news_id string, prompt_version string, score_status string")
    rows = N.pending_news(refs, scores, "v", 3, texts=texts).collect()
    assert rows == N.pending_news(Q.with_texts(refs, texts), scores, "v", 3).collect() and len(rows) == 3


def test_stored_articles_hold_no_text(spark):
    assert not {"summary", "body", "text"} & set(D.article_refs(spark, SF_DIR).columns)
    assert D.raw_news(spark, SF_DIR).columns == TABLES["raw_news"].fieldNames()


def test_limit_per_ticker_shuffles_only_articles_within_it(spark):
    rows = [("a" if i % 2 else "b", i if i > 2 else None, json.dumps({"title": f"t{i}", "link": f"l{i}"})) for i in range(60)]
    landed = spark.createDataFrame([*rows, ("c", 5, json.dumps({"title": "only", "content": {"title": "in", "provider": {"displayName": "p"}}}))],
                                   "ticker string, seq long, payload string")
    plan = V.limit_new_per_ticker(landed, 4)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()
    found = {(r["ticker"], r["title"]) for r in plan.collect()}
    assert found == {("A", "t1"), ("A", "t3"), ("A", "t5"), ("A", "t7"), ("B", "t0"), ("B", "t2"), ("B", "t4"), ("B", "t6"), ("C", "in")}


def test_nested_news_parses_a_payload_twice_at_most(spark):
    landed = spark.createDataFrame([("a", "{}")], "ticker string, payload string")
    plan = V.normalize_nested_news(landed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_tuple(") == 2 and "get_json_object(payload" not in plan
