"""A corpus pipeline: reject poor documents, keep one of each group of near copies, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet in the shared folder
and reads it again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bpe, jaccard, mixing, queries, ranking
from quantloom.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; without labels all. NULL and empty texts are scored like any other."""
    return ranking.accepted(docs, queries.table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard likeness 0.8 or more) one row: that of the least id.

    Of several texts under that id in one component, and of a component without ids, the text of the least hash stays; of
    repeated rows one. Unlike texts of one id are documents of their own. Texts without words are no copies of each
    other and all stay.
    """
    found = jaccard.near_components(docs.select("doc_id", "text"), size=5, percent=80)
    leaders = found.where("n_shingles > 0 and leads and doc_id <=> component_id").groupBy("group").agg(F.min("text_key").alias("key")).select("key")
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # Joined and grouped by the same key, so the texts are shuffled once; whole rows travel in one column, whatever their names.
    keyed = docs.where(worded).select(jaccard.text_key(F.col("doc_id"), F.col("text")).alias("key"), F.struct("*").alias("row"))
    kept = keyed.join(leaders.hint("merge"), "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return kept.select("row.*").union(docs.where(~worded))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson draws so that a source's share goes with the square root of its volume.

    NULL is a source of its own, a NULL text an empty one; each of several equal rows is drawn by the same number.
    """
    return mixing.mixed_rows(docs).select("mix_row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document as digests, and their decoded text's digest; a NULL text is an empty one."""
    return queries.digests(bpe.round_trip(docs.select("doc_id", "text"), queries.BPE_FILE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_copies", near_copies), ("mixed", mixed), ("encoded", encoded),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
