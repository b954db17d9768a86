"""Lexicon scoring cuts each text once and finds the same words as cutting, stripping and comparing by Spark's functions."""

from pyspark.sql import functions as F

from quantloom.operators import news as N

TEXTS = [
    "x the. ..of,  and ", "", " ... ", None, "\x85the\x85loss!?", "The (OF) \x1fthe\x1f of\x1d in's 'is'", "the\x1cof and",
    "cost.of to; GROWTH, İs Kost  sales᠎", " in  to　", "in in in (in) [in", "(the ", "the)\x0b\x0c",
]


def by_spark(words):
    tokens = F.split(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    stripped = F.transform(tokens, lambda token: F.btrim(token, F.lit(N.STRIPPED_CHARACTERS)))
    return F.array_intersect(stripped, F.lit(words))


def test_found_words_equal_split_and_strip(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "at int, text string").withColumn("text", F.lower("text"))
    for words in (["the", "of", "and", "to", "in", "is", "loss", "cost"], ["", "the", "a b", "the.", "x"]):
        found = frame.select("at", F.sort_array(by_spark(words)).alias("old"), F.sort_array(F.arrow_udf(N.found_words(words), "array<string>")("text")).alias("new"))
        rows = found.collect()
        assert [r["new"] for r in rows] == [r["old"] for r in rows] and any(r["new"] for r in rows)


def test_scoring_cuts_a_text_once(spark):
    news = spark.createDataFrame([("t", "the loss.", "regular", False)], "title string, summary string, market_session string, is_sec_filing boolean")
    scored = N.score_news_lexicon(news, {"positive": ["the"], "negative": ["loss"]})
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" not in plan and "lambdafunction" not in plan and plan.count("lower(") == 1
    assert scored.first()["importance"] == 0.25 + 11 / 800 + 0.1
