"""Preference formatting: the common turns of two conversations once as a prompt, the rest as masked completions.

Two conversations share a prompt as long as they have the same turns: up to the first turn number at which their turns
(role and text) differ. Turns are compared by a grouped aggregate, not by gathering conversations. What is rendered is
put out in chunks of a bounded number of turns, each with the spans of characters that count for the loss: the
assistant's words and their end mark in completions, nothing in a prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Turn numbers in a row of output.
CHUNK = 64
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    """A turn as text: its role, its text and an end mark."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _assembled(turns: Column) -> Column:
    """(text, spans) of sorted turns (turn, role, text, part): spans are 'start-end', in characters, joined by blanks."""

    def add(acc: Column, t: Column) -> Column:
        begin = F.length(acc["text"]) + F.length(t["role"]) + 5
        end = begin + F.length(t["text"]) + 7
        span = F.concat(F.lit(" "), begin.cast("string"), F.lit("-"), end.cast("string"))
        counts = (t["role"] == "assistant") & (t["part"] != "prompt")
        return F.struct(
            F.concat(acc["text"], rendered(t["role"], t["text"])).alias("text"),
            F.concat(acc["spans"], F.when(counts, span).otherwise("")).alias("spans"),
        )

    return F.aggregate(turns, F.struct(F.lit("").alias("text"), F.lit("").alias("spans")), add, lambda acc: F.struct(acc["text"].alias("text"), F.ltrim(acc["spans"]).alias("spans")))


def format_pairs(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(pair_id, part, chunk, piece, n_turns, text, loss_spans) from turns (pair_id, side, turn, role, text), side 'chosen' or 'rejected'.

    part is 'prompt', 'chosen' or 'rejected'; chunk is the turn number divided by `chunk`, so a long conversation is several
    rows whose texts follow each other; where a number is repeated or NULL, every `chunk` turns of a chunk are a piece
    (from 0), so no row gathers more. A part without turns has no row; a pair of one side has no prompt. Turns are
    ordered by number, then role and text. Repeated rows are one turn; a NULL role or text is empty, a NULL turn comes
    before all others, and rows without pair or side are left out. Other columns are ignored.
    """
    given = turns.where("pair_id is not null and side in ('chosen', 'rejected')").select(
        "pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), "side",
    )
    sides = materialize(
        given.groupBy("pair_id", "turn", "role", "text").agg(F.max(F.col("side") == "chosen").alias("chosen"), F.max(F.col("side") == "rejected").alias("rejected")),
        "turns",
    )
    parting = sides.where("not (chosen and rejected)").groupBy("pair_id").agg(F.min("turn").alias("parting"))
    placed = sides.join(parting, "pair_id", "left").withColumn(
        "part",
        F.explode(
            F.when(F.col("parting").isNull() | (F.col("turn") < F.col("parting")), F.array(F.lit("prompt"))).otherwise(
                F.array_compact(F.array(F.when(F.col("chosen"), "chosen"), F.when(F.col("rejected"), "rejected")))
            )
        ),
    )
    # The window deals rows by the keys that the grouping needs, so they are shuffled once; it holds one row at a time.
    order = Window.partitionBy("pair_id", "part", "chunk").orderBy("turn", "role", "text")
    piece = F.floor((F.row_number().over(order) - 1) / chunk)
    numbered = placed.withColumn("chunk", F.floor(F.col("turn") / chunk)).withColumn("piece", piece)
    grouped = numbered.groupBy("pair_id", "part", "chunk", "piece").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "part"))).alias("turns")
    )
    done = grouped.withColumn("out", _assembled(F.col("turns")))
    return done.select("pair_id", "part", "chunk", "piece", F.size("turns").cast("long").alias("n_turns"), F.col("out.text").alias("text"), F.col("out.spans").alias("loss_spans"))


def exchanged_endings(conversations: DataFrame) -> DataFrame:
    """One pair for each conversation: chosen is itself, rejected the same with its last assistant turn from another one.

    The other is that of id 2k for 2k + 1 and the reverse. A conversation whose other has no assistant turn loses its own;
    one without assistant turns is rejected as it stands, so all of it is prompt. Of several last turns (same number)
    the greatest text is exchanged. Rows without id make no pair.
    """
    given = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = given.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    last = materialize(last, "endings")
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("ending"))
    ends = last.join(other, "pair_id", "left").select("pair_id", "last", "ending")
    met = given.join(ends, "pair_id", "left")
    is_last = F.coalesce(
        (F.col("role") == "assistant") & (F.coalesce("turn", F.lit(-1)) == F.col("last.turn")) & (F.coalesce("text", F.lit("")) == F.col("last.text")), F.lit(False)
    )
    sides = F.array_compact(F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("body")),
        F.when(~is_last, F.struct(F.lit("rejected").alias("side"), F.col("text").alias("body")))
        .when(F.col("ending").isNotNull(), F.struct(F.lit("rejected").alias("side"), F.col("ending").alias("body"))),
    ))
    return met.select("pair_id", "turn", "role", F.inline(sides)).withColumnRenamed("body", "text")
