"""Mixing sources to target weights by Poisson replication.

A document of a source that should appear `rate` times on average is repeated by inverting the Poisson distribution of
that mean at a number in [0, 1) taken from a hash of its id, so the same input always gives the same mixture, document
by document and without any order or state. A large mean is a sum of equal ones, each inverted at a number of its own.
Copies are then shuffled over all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Largest mean that is inverted as a whole, as exp(-rate) vanishes beyond; a larger one is split into equal parts.
PART_RATE = 700.0
#: Hexadecimal digits of a hash that make a number: 52 bits, exact in a double.
DIGITS = 13


def unit(seed: Column) -> Column:
    """A number in [0, 1) from the hash of a text."""
    return F.conv(F.substring(F.md5(seed), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... for a Poisson X of this mean, far enough for 52 bits."""
    ks = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(ks, start, step, lambda acc: acc["c"])


def target_rates(docs: DataFrame, weights: DataFrame | None, temperature: float, epochs: float) -> DataFrame:
    """(mix_source, mix_parts, steps): for each source the parts its mean number of copies has, and the Poisson steps of one.

    A source's volume is the characters of its texts plus one for each document. Its share of the output should be its
    weight: given, or volume ** temperature. The output has `epochs` times the input's volume on average.
    """
    volume = docs.groupBy(F.col("source").alias("mix_source")).agg(
        F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).cast("double").alias("volume")
    )
    if weights is None:
        wished = volume.withColumn("wish", F.pow("volume", F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("given_source")).agg(F.sum("weight").cast("double").alias("wish"))
        wished = volume.join(given, F.col("mix_source").eqNullSafe(F.col("given_source")), "left").select(
            "mix_source", "volume", F.coalesce("wish", F.lit(0.0)).alias("wish")
        )
    stored = materialize(wished, "volumes")
    totals = stored.agg(F.sum("volume").alias("v"), F.sum("wish").alias("w")).first()
    rate = F.col("wish") / F.lit(float(totals["w"] or 1.0)) * F.lit(float(totals["v"] or 0.0) * epochs) / F.col("volume")
    parts = F.greatest(F.ceil(rate / PART_RATE), F.lit(1)).cast("int")
    return materialize(stored.select("mix_source", parts.alias("mix_parts"), poisson_steps(rate / parts).alias("steps")), "rates")


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """The columns of `docs`, with copy_no (from 1) and shuffle_key, one row for each copy, in shuffled order.

    `weights` has (source, weight); a source that it lacks gets none, repeated rows add up. A NULL source is a source
    of its own, a NULL text counts as empty. Repeated rows have equal ids and so equal numbers of copies; a row without
    id takes its number from its text. Other columns are carried along, whatever their names; copy_no and shuffle_key of
    `docs` itself give way to the operator's.
    An empty table gives an empty result. Only volumes are summed by source (partial sums), so a hot source is no
    hot task; the table of rates is joined as a stored table, whose size Spark knows.
    """
    own = [f"mix_row.`{c}`" for c in docs.columns if c.lower() not in ("copy_no", "shuffle_key")]
    return mixed_rows(docs, weights, temperature, epochs, seed).select(*own, "copy_no", "shuffle_key")


def mixed_rows(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """`mix` with the whole row of `docs` in the one column mix_row, so that no name of it meets another."""
    rates = target_rates(docs, weights, temperature, epochs)
    doc_id, text = F.col("mix_row.doc_id").cast("string"), F.coalesce("mix_row.text", F.lit(""))
    identity = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id, F.concat(F.lit("text "), F.md5(text))))
    drawn = docs.select(F.struct("*").alias("mix_row")).join(rates, F.col("mix_row.source").eqNullSafe(F.col("mix_source")))
    # The first part's number is the hash of the id alone.
    numbers = F.transform(
        F.sequence(F.lit(1), F.col("mix_parts")),
        lambda part: unit(F.concat(identity, F.when(part > 1, F.concat(F.lit(":part "), part.cast("string"))).otherwise(""))),
    )
    copies = F.aggregate(numbers, F.lit(0), lambda total, u: total + F.size(F.filter("steps", lambda c: c <= u)))
    repeated = drawn.withColumn("mix_copies", copies).withColumn("copy_no", F.explode(F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies")))))
    keyed = repeated.withColumn("shuffle_key", F.md5(F.concat(identity, F.lit(":"), F.col("copy_no").cast("string"))))
    return keyed.select("mix_row", "copy_no", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
