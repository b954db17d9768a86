"""Token counts as delta-maintained rollups.

Totals are sums, so a change of a document is a few signed numbers: an insert adds its counts, a delete takes them away, a
revision takes away the old and adds the new. A batch of changes is summed by source, language and tokenizer version,
written to files of its own, and counts from the moment that one entry with its name is added to the table's log. A batch
whose name is there already changes nothing, and one that fails half-way leaves files that no entry names, so commits are
idempotent and no replay can lose a batch. Totals are the sum over all committed batches; compacting replaces their
files by one set of sums, in one entry, and the names stay known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sinks import snapshots

KEYS = ("source", "lang", "tokenizer")
MEASURES = ("documents", "tokens", "characters")


def white_space_tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def word_and_mark_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits or other non-ASCII characters, and single marks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9\\x{80}-\\x{10FFFF}]+|[!-/:-@\\[-`{-~]")).cast("long")


def counted(docs: DataFrame, tokenizers: dict[str, Column]) -> DataFrame:
    """Each document's id, source, language and characters, and its tokens under the name of each tokenizer version."""
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("characters"), *[c.cast("long").alias(t) for t, c in tokenizers.items()],
    )


def changes(counts: DataFrame, sign: int, tokenizer: str) -> DataFrame:
    """One signed row for each counted document: +1 inserts, -1 deletes."""
    return counts.select(
        "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("documents"),
        (sign * F.col(tokenizer)).alias("tokens"), (sign * F.col("characters")).alias("characters"),
    )


def summed(rows: DataFrame) -> DataFrame:
    """Measures added by key."""
    return rows.groupBy(*KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])


def commit(path: str, batch: str, rows: DataFrame) -> bool:
    """Sum a batch of signed rows and append it under its name; whether it was new. A batch that counts already stays as it is.

    Sums are partial before they are shuffled, so a hot source costs no hot task. Groups that cancel out are kept as
    zeros. A batch without rows is written too, as a batch of none.
    """
    if not batch or not all(c.isalnum() or c in "-_" for c in batch):
        raise ValueError("a batch name has letters, digits, - and _")
    return snapshots.append_batch(summed(rows), path, batch)


def compact(spark: SparkSession, path: str) -> None:
    """Replace the files of all committed batches by their sums, in one commit."""
    snapshots.compact(spark, path, summed)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(source, lang, tokenizer, documents, tokens, characters) over all committed batches; groups without documents go.

    NULL sources and languages are groups of their own.
    """
    return summed(snapshots.read_table(spark, path)).where("documents <> 0 or tokens <> 0 or characters <> 0")


def maintain(docs: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """The totals after four batches over `docs`: all inserted, toxic ones deleted, low-quality ones counted anew, one batch replayed.

    Deleted are documents with a label toxic = 1; revised, with word-and-mark tokens under 'v2', those with quality = 0
    that aren't deleted. Repeated documents are inserted and deleted each; several labels of one document count as the
    highest toxic and the lowest quality. A NULL text is empty. Extra columns are ignored; empty tables give no totals.
    """
    spark = docs.sparkSession
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    toxic, poor = marks.where("toxic = 1").select("doc_id"), marks.where("quality = 0 and coalesce(toxic, 0) <> 1").select("doc_id")
    versions = {"v1": white_space_tokens(F.col("text")), "v2": word_and_mark_tokens(F.col("text"))}
    counts = materialize(counted(docs, versions), "counts")
    removed, revised = counts.join(toxic, "doc_id", "left_semi"), counts.join(poor, "doc_id", "left_semi")
    commit(path, "inserts", changes(counts, 1, "v1"))
    commit(path, "deletes", changes(removed, -1, "v1"))
    revision = changes(revised, -1, "v1").union(changes(revised, 1, "v2"))
    commit(path, "revisions", revision)
    commit(path, "revisions", revision)  # the replay of a batch whose commit wasn't acknowledged
    return totals(spark, path)
