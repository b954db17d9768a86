"""News scoring and its aggregation to factors."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp
from ..schemas import SCORES, column_names
from .quality import with_texts

# The scoring word lists, stripped characters and factor weights.
DEFAULT_LEXICON = {
    "positive": [
        "beat", "beats", "raise", "raises", "growth", "record", "upgrade", "surge", "profit", "strong", "launch",
        "approval", "partnership", "announces", "expands",
    ],
    "negative": [
        "miss", "cuts", "cut", "downgrade", "lawsuit", "probe", "fall", "falls", "weak", "recall", "risk", "warning",
        "loss", "decline", "delay",
    ],
    "risk": ["lawsuit", "probe", "recall", "warning", "regulatory", "fraud", "breach", "default"],
    "surprise": ["unexpected", "surprise", "beats", "misses", "guidance", "upgrade", "downgrade"],
    "revenue": ["revenue", "sales", "orders", "demand", "growth", "launch", "partnership"],
    "margin": ["margin", "cost", "pricing", "profit", "efficiency", "layoff", "expense"],
}
STRIPPED_CHARACTERS = ".,:;!?()[]{}\"'"
AI_SCORE_WEIGHTS = {
    "news_sentiment": 0.35, "news_importance": 0.20, "news_surprise": 0.15, "news_risk": -0.20,
    "news_revenue_impact": 0.10,
}
SIGNED_SCORES = ("sentiment", "revenue_impact", "margin_impact")
MAX_ERROR_CHARS = 1000
#: The white space of the regular expression (?U)\s; Python's `split` takes U+001C to U+001F for white space, too.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _unscored(clean: DataFrame, scores: DataFrame, version: str, retry_failed: bool = False) -> DataFrame:
    done = scores.where(F.col("prompt_version") == version).where(F.col("score_status").isNotNull())
    if retry_failed:
        done = done.where(F.col("score_status") != "failed")
    return clean.join(done.select("news_id"), "news_id", "left_anti")


def pending_news(
    clean: DataFrame, scores: DataFrame, version: str, limit: int = 100, retry_failed: bool = False, texts: DataFrame | None = None
) -> DataFrame:
    """The first `limit` clean articles without a score of this prompt version, oldest first.

    With `texts`, `clean` has a `text_id` in place of its texts, and only the chosen articles get theirs.
    """
    columns = ["news_id", "ticker", "effective_date", "title", "summary", "market_session", "is_sec_filing"]
    order = ["effective_date", "ticker", "published_at", "news_id"]
    first = _unscored(clean, scores, version, retry_failed).orderBy(*order).limit(limit)
    if texts is not None:
        first = with_texts(first, texts).orderBy(*order)
    return first.select(*columns)


def pending_news_count(clean: DataFrame, scores: DataFrame, version: str) -> DataFrame:
    return _unscored(clean, scores, version).agg(F.count(F.lit(1)).alias("pending"))


def found_words(listed: Sequence[str]) -> Callable[[pa.Array], pa.Array]:
    """For an Arrow function over texts: which of the `listed` words are a token of the text, NULL for NULL.

    Tokens lie between white space and are stripped of `STRIPPED_CHARACTERS`. Each text is cut once, whatever the number
    of words, and only its different tokens are stripped.
    """
    wanted, stripped, token = frozenset(listed), STRIPPED_CHARACTERS, re.compile(f"[^{WHITE_SPACE}]+")

    def run(texts: pa.Array) -> pa.Array:
        whole = texts.buffers()[-1]
        held = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
        # Of bytes less 28 only those of U+001C to U+001F are below 4.
        cut = token.findall if (held - np.uint8(28) < 4).any() else str.split

        def found(text: str | None) -> list[str] | None:
            if text is None:
                return None
            tokens = set(cut(text)) or {""}
            return list(wanted.intersection([x.strip(stripped) for x in tokens]))

        return pa.array(map(found, texts.to_pylist()), pa.list_(pa.string()), size=len(texts))

    return run


def score_news_lexicon(news: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Score each article by the distinct lexicon words in its title and summary.

    Words are compared after the text is lower-cased, cut at white space and stripped of punctuation. Adds the seven
    scores. The lexicon is a parameter.
    """
    lexicon = {**DEFAULT_LEXICON, **(lexicon or {})}
    listed = sorted({word for words in lexicon.values() for word in words})
    text = F.lower(F.concat(F.col("title"), F.lit(" "), F.coalesce("summary", F.lit(""))))
    tokens = news.withColumn("_text", text).withColumn("_found", F.arrow_udf(found_words(listed), "array<string>")("_text"))

    def hits(kind: str) -> Column:
        return F.size(F.array_intersect("_found", F.lit(lexicon[kind])))

    counted = tokens.withColumns({f"_{kind}": hits(kind) for kind in lexicon})
    pos, neg, risk, surprise, revenue, margin = (
        F.col(f"_{kind}") for kind in ("positive", "negative", "risk", "surprise", "revenue", "margin")
    )
    filing = F.when(F.col("is_sec_filing"), 0.15).otherwise(0.0)
    off_session = F.when(F.col("market_session").eqNullSafe("regular"), 0.0).otherwise(0.10)
    scored = counted.withColumn("sentiment", clamp((pos - neg) / F.lit(4.0), -1, 1))
    scored = scored.withColumns({
        "importance": clamp(0.25 + F.length("_text") / F.lit(800.0) + filing + 0.05 * (pos + neg), 0, 1),
        "surprise": clamp(0.10 + 0.20 * surprise + off_session, 0, 1),
        "risk": clamp(0.05 + 0.25 * risk + 0.10 * neg, 0, 1),
        "revenue_impact": clamp(F.col("sentiment") * 0.60 + 0.10 * revenue, -1, 1),
        "margin_impact": clamp(F.col("sentiment") * 0.50 + 0.10 * margin - 0.10 * risk, -1, 1),
        "confidence": clamp(0.55 + 0.10 * F.least(pos + neg + risk + surprise, F.lit(3)), 0, 0.9),
    })
    return scored.drop("_text", "_found", *[f"_{kind}" for kind in lexicon])


def parse_scored_responses(responses: DataFrame, payload: str = "response") -> DataFrame:
    """Read landed scorer responses: seven numbers inside a JSON text inside the response.

    All seven must be present and numeric; otherwise every score is NULL and `error_message` says so.
    """
    content = F.get_json_object(payload, "$.choices[0].message.content")
    # One parse for each response: a tuple of texts.
    numbers = responses.select("*", F.json_tuple(content, *SCORES).alias(*[f"_{name}" for name in SCORES]))
    parsed = numbers.withColumns({f"_{name}": F.col(f"_{name}").try_cast("double") for name in SCORES})
    complete = F.lit(True)
    for name in SCORES:
        complete = complete & F.col(f"_{name}").isNotNull()
    bounded = {
        name: F.when(complete, clamp(F.col(f"_{name}"), -1 if name in SIGNED_SCORES else 0, 1)) for name in SCORES
    }
    error = F.when(~complete, F.concat(F.lit("incomplete scorer response: "), F.coalesce(content, F.lit("no content"))))
    return parsed.withColumns({**bounded, "error_message": error}).drop(*[f"_{name}" for name in SCORES])


def apply_score_status(scored: DataFrame, version: str) -> DataFrame:
    """Turn scored or failed articles into rows of the score table; upsert them by `news_id`."""
    failed = F.col("sentiment").isNull()
    message = F.col("error_message") if "error_message" in scored.columns else F.lit(None).cast("string")
    return scored.withColumns({
        **{name: F.when(~failed, F.col(name)) for name in SCORES},
        "score_status": F.when(failed, "failed").otherwise("success"),
        "prompt_version": F.lit(version),
        "error_message": F.when(failed, F.substring(message, 1, MAX_ERROR_CHARS)),
    }).select(*column_names("news_scores"))


def aggregate_news_raw(scores: DataFrame) -> DataFrame:
    """Per date and ticker: means weighted by importance and confidence, maxima and the article count."""
    weight = F.col("importance") * F.col("confidence")
    total = F.sum(weight)

    def weighted(name: str) -> Column:
        return F.when(total == 0, F.avg(name)).otherwise(F.try_divide(F.sum(F.col(name) * weight), total))

    return scores.where("score_status = 'success'").groupBy(F.col("effective_date").alias("date"), "ticker").agg(
        weighted("sentiment").alias("news_sentiment"),
        F.avg("importance").alias("news_importance"),
        F.max("surprise").alias("news_surprise"),
        F.max("risk").alias("news_risk"),
        weighted("revenue_impact").alias("news_revenue_impact"),
        weighted("margin_impact").alias("news_margin_impact"),
        F.count("news_id").alias("news_coverage"),
    )


def news_ai_score(raw: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    terms = [F.lit(w) * F.col(name) for name, w in (weights or AI_SCORE_WEIGHTS).items()]
    return raw.withColumn("news_ai_score", sum(terms[1:], terms[0]))
