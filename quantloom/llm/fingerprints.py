"""One-permutation MinHash: shingles are hashed once and binned; empty bins are filled by optimal densification.

Everything is a column expression. A shingle's hash has its bin in the top bits; after sorting the hashes, the first of
each bin is its minimum, of which the low bits are kept. An empty bin takes the value of the first non-empty bin along a
hash-made sequence of its own, the same for all texts: a few single probes, then a whole permutation. Two
fingerprints' likeness is the share of equal places, corrected for places that agree by chance in so few bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SIZE = 5
BIN_BITS = 7
BITS = 8
PROBES = 4
#: Stands for a missing id, before all others.
NO_ID = -(2**63)
BLANKS = " \t\n\x0b\x0c\r"
SEPARATOR = "[\\x20\\x09-\\x0D]+"


def _bin(value: Column) -> Column:
    return F.shiftright(value, 64 - BIN_BITS)


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words; a text without words has one empty word."""
    return F.transform(F.split(F.lower(F.btrim(text, F.lit(BLANKS))), SEPARATOR), lambda w: F.xxhash64(w))


def shingles(h: Column) -> Column:
    """Hashes of SIZE words in a row; none for fewer words."""
    starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (SIZE - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, SIZE)]))


def least_of_bins(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """`df` with `out`: the least hash of each bin that has any, ascending."""
    ordered = f"_sorted_{out}"
    s = F.col(ordered)
    df = df.withColumn(ordered, F.sort_array(hashes))
    return df.withColumn(out, F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))).drop(ordered)


def densified(df: DataFrame, least: str, out: str) -> DataFrame:
    """`df` with `out`: a number of BITS bits, less half their range, for each bin, empty bins filled."""
    known, low, half = f"_known_{out}", (1 << BITS) - 1, 1 << (BIN_BITS - 1)
    f, m = F.col(least), F.col(known)

    def value(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low))

    def fill(b: Column) -> Column:
        probes = [m[F.pmod(F.xxhash64(b, F.lit(t)), F.lit(2 * half)) - half] for t in range(PROBES)]
        rest = F.array_min(F.transform(f, lambda x: F.struct(F.xxhash64(b, _bin(x), F.lit("rest")).alias("place"), value(x).alias("v"))))["v"]
        return F.coalesce(*probes, rest)

    df = df.withColumn(known, F.map_from_arrays(F.transform(f, _bin), F.transform(f, value)))
    bins = F.sequence(F.lit(-half).cast("bigint"), F.lit(half - 1).cast("bigint"))
    present = F.transform(f, lambda x: _bin(x) * (low + 1) + value(x))
    filled = F.transform(F.array_except(bins, F.map_keys(m)), lambda b: b * (low + 1) + fill(b))
    coded = F.sort_array(F.concat(present, filled))
    return df.withColumn(out, F.transform(coded, lambda c: (c.bitwiseAND(F.lit(low)) - (low + 1) // 2).cast("tinyint"))).drop(known)


def with_fingerprints(df: DataFrame, begin: str, ends: dict[str, str]) -> DataFrame:
    """`df` with a fingerprint of begin + end under each name of `ends`.

    `begin` must be empty or end with a separator; what it holds is split, hashed and binned once for all ends. A text
    of fewer than five words is one shingle.
    """
    df = df.withColumn("_h", F.when(F.col(begin) == "", F.array().cast("array<bigint>")).otherwise(word_hashes(F.col(begin))))
    df = least_of_bins(df.withColumn("_s", shingles(F.col("_h"))), "_s", "_least").drop("_s")
    last = F.slice(F.col("_h"), F.greatest(F.size("_h") - (SIZE - 2), F.lit(1)), SIZE - 1)
    for name, end in ends.items():
        rest = F.when((F.btrim(F.col(end), F.lit(BLANKS)) == "") & (F.size("_h") > 0), F.array().cast("array<bigint>")).otherwise(word_hashes(F.col(end)))
        df = df.withColumn("_r", rest).withColumn("_t", F.concat(last, F.col("_r")))
        short = F.size("_h") + F.size("_r") < SIZE
        df = df.withColumn(
            "_u", F.when(short, F.array(F.xxhash64(F.concat("_h", "_r")))).otherwise(F.concat("_least", shingles(F.col("_t"))))
        )
        df = densified(least_of_bins(df, "_u", "_v"), "_v", name).drop("_r", "_t", "_u", "_v")
    return df.drop("_h", "_least")


def packed(fingerprint: Column) -> Column:
    """Two hexadecimal digits for each bin."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.lower(F.hex(v.cast("int") + (1 << (BITS - 1)))), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, 0 to 1: the share of equal places less the 2^-bits that agree by chance."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (equal / F.lit(float(1 << BIN_BITS)) - chance) / (1 - chance))


def successors(keys: DataFrame, *order: str) -> DataFrame:
    """Each row of `keys` (unique by `order`) with next_<column> of the row after it; after the last comes the first.

    Rows are range-partitioned and written with their partition, so no window spans the table: the last row of a
    partition takes the first of the next from a list of one row for each partition.
    """
    ranged = materialize(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    row = F.struct(*order)
    heads = ranged.groupBy("_part").agg(F.min(row).alias("_head"))
    following = Window.orderBy("_part")  # one row for each partition of the table
    after = heads.select(
        "_part", F.coalesce(F.lead("_head").over(following), F.first("_head").over(following)).alias("_after")
    )
    inside = ranged.withColumn("_next", F.lead(row).over(Window.partitionBy("_part").orderBy(*order)))
    return inside.join(after, "_part").withColumn("_next", F.coalesce("_next", "_after")).select(
        *keys.columns, *[F.col("_next")[c].alias(f"next_{c}") for c in order]
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; one row for each row of `docs`.

    The edited text is the text with its last quarter (n_chars / 4, rounded down) replaced by as many first characters
    of the next document, by ascending doc_id, the first after the last. NULL texts are empty. Repeated rows are one
    document in that order and give equal rows; rows of one doc_id with different texts follow each other by a hash of
    the text; a NULL doc_id comes first. Other columns of `docs` are ignored. An empty table gives an empty result.
    """
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = given.withColumn("h", F.xxhash64("text"))
    keys = keyed.groupBy("doc_id", "h").agg(F.max(F.length("text")).alias("n"))
    order = materialize(successors(keys, "doc_id", "h"), "order")
    # Both uses of `each` have the same columns and conditions, so one exchange of the texts serves both.
    each = keyed.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.count("*").alias("times")).where("times > 0")
    asked = order.select(
        F.col("next_doc_id").alias("doc_id"), F.col("next_h").alias("h"), F.floor(F.col("n") / 4).cast("int").alias("most"),
        F.col("doc_id").alias("for_id"), F.col("h").alias("for_h"),
    )
    heads = each.join(asked, ["doc_id", "h"]).select(
        F.col("for_id").alias("doc_id"), F.col("for_h").alias("h"), "most", F.expr("substring(text, 1, most)").alias("head")
    )
    own = each.join(heads, ["doc_id", "h"])
    kept = F.expr("substring(text, 1, cast(n_chars - most as int))")
    split = (
        own.withColumn("n_chars", F.length("text").cast("long")).withColumn("kept", kept)
        .withColumn("begin", F.regexp_extract("kept", "(?s)^.*[\\x20\\x09-\\x0D]", 0))
        .withColumn("edited", F.concat("kept", "head"))
        .withColumn("end", F.expr("substring(text, length(begin) + 1)"))
        .withColumn("new_end", F.expr("substring(edited, length(begin) + 1)"))
    )
    made = with_fingerprints(split, "begin", {"own": "end", "new": "new_end"})
    stored = materialize(
        made.select("doc_id", "h", "times", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "new"), "fingerprints"
    )
    following = stored.select(F.col("doc_id").alias("next_doc_id"), F.col("h").alias("next_h"), F.col("own").alias("n_own"))
    beside = order.select("doc_id", "h", "next_doc_id", "next_h").join(following, ["next_doc_id", "next_h"]).select("doc_id", "h", "n_own")
    result = stored.join(beside, ["doc_id", "h"])
    return result.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("n_own")).alias("near_next"),
    )
