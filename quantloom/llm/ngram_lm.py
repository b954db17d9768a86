"""Language-model scores by deleted interpolation.

Tokens are lower-cased words and one end per text; the token before a text's first one is an end too. With t a token, s the
one before it and K the number of distinct training tokens and one for all others,

    P(t | s) = a ML(t | s) + b ML(t) + c / K

where a context s without training tokens has ML(t) in place of ML(t | s). The weights (a, b, c) belong to the bucket of the
context's frequency, a power of two. They are learned by expectation-maximisation: a fold of the training texts is held out,
the estimates come from the other training texts, and the weights are those that make the held-out counts likeliest. The
final estimates use all training texts.

All words and all pairs count. Their counts are sums of partial sums by hash and stay distributed tables. Texts get the
counts of their words first, then each distinct pair of a text is joined to the pair table: at most one row for each text
and pair, so a frequent one isn't a hot key. The commonest words' counts, at most `CACHED`, are sent to the tasks, which
only spares their rows in the first join. The driver holds these and sums of the held-out counts by likeness of their
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import Words, find_words, list_array, mix64, text_slices

#: Most words whose counts are sent to the tasks instead of joined.
CACHED = 400_000
#: Held-out pairs are summed by cells of so many to each doubling of a probability; a cell counts with its means.
CELLS = 8
#: Training texts held out for the weights: one of so many.
FOLDS = 10
ROUNDS = 60
#: Held-out tokens that each part of the mixture is given beforehand, so that no weight becomes 0.
PRIOR = 1.0
#: Words gathered before their distinct ones are handed on.
GATHERED = 2_000_000

KEPT, HELD, TEST = 0, 1, 2
END_WORD = 0x5EEDED0E7D
_U = np.uint64


def role(doc_id: Column) -> Column:
    """TEST where crc32 of the id as text leaves 1 on division by 5; of the others, one of FOLDS is HELD. No id: as ''."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    fold = F.floor(crc / 5) % FOLDS
    return F.when(crc % 5 == 1, TEST).when(fold == 0, HELD).otherwise(KEPT).cast("int")


def _grouped(keys: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their numbers in kept and in held-out texts."""
    distinct, place = np.unique(keys, return_inverse=True)
    kept = np.bincount(place, weights=roles == KEPT, minlength=len(distinct)).astype(np.int64)
    return distinct, kept, np.bincount(place, minlength=len(distinct)) - kept


def _counting(keys_of):
    """For `mapInArrow` over (text, role) of training texts: (key, kept, held) of what `keys_of` finds in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            distinct, kept, held = _grouped(np.concatenate(keys), np.concatenate(roles))
            keys.clear()
            roles.clear()
            return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(kept), pa.array(held)], names=["key", "kept", "held"])

        keys, roles = [], []
        for batch in batches:
            all_roles = batch.column("role").to_numpy()
            for part in text_slices(batch.column("text")):
                found, rows = keys_of(find_words(part))
                keys.append(found)
                roles.append(all_roles[part.first + rows])
                if sum(map(len, keys)) >= GATHERED:
                    yield flush()
        if keys:
            yield flush()

    return run


def word_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative word hashes and an end for each text."""
    n = len(words.counts)
    return (
        np.concatenate([words.hashes >> _U(1), np.full(n, END_WORD, dtype=_U)]),
        np.concatenate([words.rows, np.arange(n)]),
    )


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every token's word hash and row, by row and place, an end last in each text; and the place of each text's first token."""
    n = len(words.counts)
    sizes = words.counts + 1
    ends = np.cumsum(sizes) - 1
    tokens = np.full(int(sizes.sum()), END_WORD, dtype=_U)
    inner = np.ones(len(tokens), dtype=bool)
    inner[ends] = False
    tokens[inner] = words.hashes >> _U(1)
    return tokens, np.repeat(np.arange(n), sizes), ends - sizes + 1


def before(values: np.ndarray, first) -> np.ndarray:
    """What stands one place before; a text's last token is an end, so the token before the next text's first is one."""
    return np.concatenate([np.full(min(len(values), 1), first, dtype=values.dtype), values[:-1]])


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """Non-negative hashes of each token and the one before it."""
    return mix64(before(tokens, END_WORD) * _U(0x9E3779B97F4A7C15) + mix64(tokens)) >> _U(1)


def pair_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    tokens, rows, _ = tokens_of(words)
    return pair_hashes(tokens), rows


def bucket(frequency: np.ndarray) -> np.ndarray:
    """The power of two below a context's frequency."""
    return np.floor(np.log2(np.maximum(frequency, 1))).astype(int)


def likeliest(buckets: np.ndarray, amount: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Weights by bucket (pair, single, uniform) by expectation-maximisation on `amount` tokens whose three probabilities,
    in proportion, are columns of `parts`. A bucket without tokens keeps a third each."""
    weights = np.full((int(buckets.max(initial=0)) + 1, 3), 1 / 3)
    found = np.unique(buckets)
    total = np.bincount(buckets, weights=amount, minlength=len(weights))[found]
    for _ in range(ROUNDS):
        mixed = weights[buckets].T * parts
        shares = amount * mixed / mixed.sum(axis=0)
        for k in range(3):
            weights[found, k] = (np.bincount(buckets, weights=shares[k], minlength=len(weights))[found] + PRIOR) / (total + 3 * PRIOR)
    return weights


def learn_weights(kept: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by bucket (pair, single, uniform), and each context's bucket, where all counts fit in one array.

    `kept` and `held` are counts by (context, class). Without held-out counts in a bucket its weights stay at a third.
    """
    buckets = bucket((kept + held).sum(axis=1))
    context, klass = np.nonzero(held)
    parts = np.stack(
        [
            kept[context, klass] / np.maximum(kept.sum(axis=1)[context], 1),
            kept.sum(axis=0)[klass] / max(kept.sum(), 1),
            np.full(len(context), 1 / kept.shape[1]),
        ]
    )
    learned = likeliest(buckets[context], held[context, klass].astype(float), parts)
    return padded(learned, int(buckets.max(initial=0))), buckets


def padded(weights: np.ndarray, last: int) -> np.ndarray:
    """Weights for the buckets to `last`; those that none was learned for have a third each."""
    return np.concatenate([weights, np.full((max(0, last + 1 - len(weights)), 3), 1 / 3)])


def class_scores(kept: np.ndarray, held: np.ndarray) -> np.ndarray:
    """log10 of the interpolated probability by (context, class), estimated from all training texts: the model of this
    module where all counts fit in one array, which is what its tests compare with."""
    weights, buckets = learn_weights(kept, held)
    counts = kept + held
    single = counts.sum(axis=0) / max(counts.sum(), 1)
    seen = counts.sum(axis=1, keepdims=True)
    pair = np.where(seen > 0, counts / np.maximum(seen, 1), single[None, :])
    w = weights[buckets]
    return np.log10(w[:, :1] * pair + w[:, 1:2] * single[None, :] + w[:, 2:] / counts.shape[1])


@dataclass
class Counts:
    """Ascending word hashes with their numbers in kept and held-out texts."""

    hashes: np.ndarray
    kept: np.ndarray
    held: np.ndarray

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is here, and its two numbers (0 if not)."""
        if not len(self.hashes):
            return np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        place = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        found = self.hashes[place] == words
        return found, np.where(found, self.kept[place], 0), np.where(found, self.held[place], 0)


def distinct_in_rows(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's keys the distinct ones: where one of each stands, how often it is there, and offsets by row."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    starts = np.flatnonzero(new)
    return order[starts], np.diff(np.append(starts, len(k))), np.searchsorted(r[starts], np.arange(n + 1))


def _asking(cache: Counts):
    """For `mapInArrow` over (uid, doc_id, role, text): the row, with the distinct words that `cache` lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                words = find_words(part)
                n = part.last - part.first
                hashes = words.hashes >> _U(1)
                asked = ~cache.of(hashes)[0]
                hashes, rows = hashes[asked], words.rows[asked]
                at, _, offsets = distinct_in_rows(hashes, rows, n)
                columns = batch.slice(part.first, n)
                yield pa.RecordBatch.from_arrays(
                    [*[columns.column(c) for c in ("uid", "doc_id", "role", "text")], list_array(offsets, hashes[at].view(np.int64), pa.int64())],
                    names=["uid", "doc_id", "role", "text", "words"],
                )

    return run


def _counted_tokens(batch: pa.RecordBatch, part, cache: Counts):
    """Of a slice of rows (text, answers): tokens, rows, firsts, and each token's numbers in kept and held-out texts."""
    answers = batch.column("answers").slice(part.first, part.last - part.first).flatten()
    keys, at = np.unique(answers.field("key").to_numpy().view(_U), return_index=True)
    own = Counts(keys, answers.field("kept").to_numpy()[at], answers.field("held").to_numpy()[at])
    tokens, rows, firsts = tokens_of(find_words(part))
    (_, kept, held), (_, own_kept, own_held) = cache.of(tokens), own.of(tokens)
    return tokens, rows, firsts, kept + own_kept, held + own_held


def _held_pairs(cache: Counts, ends: tuple[int, int], kept_total: int, kinds: int):
    """For `mapInArrow` over held-out texts: the distinct pairs of a row with their numbers, the context's bucket and kept
    number, and the token's probability alone as a multiple of 1 / kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                tokens, rows, _, kept, held = _counted_tokens(batch, part, cache)
                at, times, _ = distinct_in_rows(pair_hashes(tokens), rows, part.last - part.first)
                context = before(kept, ends[0])
                level = bucket(context + before(held, ends[1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pair_hashes(tokens)[at].view(np.int64)), pa.array(times.astype(np.int64)), pa.array(level[at].astype(np.int32)),
                        pa.array(context[at]), pa.array(kept[at] / max(kept_total, 1) * kinds),
                    ],
                    names=["key", "n", "bucket", "context", "single"],
                )

    return run


def _scoring(cache: Counts, ends: int, weights: np.ndarray, total: int, kinds: int):
    """For `mapInArrow` over (uid, doc_id, text, answers): a row's sums as if no pair were known, and its distinct pairs.

    A pair that training texts have c times multiplies the probability without it by 1 + c * gain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                tokens, rows, firsts, kept, held = _counted_tokens(batch, part, cache)
                n = part.last - part.first
                count = kept + held
                context = before(count, ends)
                w = weights[bucket(context)]
                single = count / max(total, 1)
                alone = (w[:, 1] + np.where(context > 0, 0.0, w[:, 0])) * single + w[:, 2] / kinds
                gain = w[:, 0] / np.maximum(context, 1) / alone
                possible = (context > 0) & (count > 0)
                keys, owner = pair_hashes(tokens)[possible], rows[possible]
                at, times, offsets = distinct_in_rows(keys, owner, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("uid").slice(part.first, n), batch.column("doc_id").slice(part.first, n),
                        pa.array(np.bincount(rows, minlength=n)), pa.array(np.add.reduceat(count > 0, firsts, dtype=np.int64)),
                        pa.array(np.add.reduceat(np.log10((count + 0.5) / (total + 0.5 * kinds)), firsts)), pa.array(np.add.reduceat(np.log10(alone), firsts)),
                        list_array(offsets, keys[at].view(np.int64), pa.int64()), list_array(offsets, times, pa.int32()),
                        list_array(offsets, gain[possible][at], pa.float64()),
                    ],
                    names=["uid", "doc_id", "n_tokens", "n_known", "base", "model", "keys", "times", "gains"],
                )

    return run


def with_counts(given: DataFrame, vocabulary: DataFrame, cache: Counts) -> DataFrame:
    """(uid, doc_id, role, text, answers): rows of `given` with the numbers of those of their words that `cache` lacks."""
    asking = given.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "role", "text").mapInArrow(
        _asking(cache), "uid long, doc_id long, role int, text string, words array<long>"
    )
    rows = asking.withColumn("key", F.explode(F.concat(F.array(F.lit(-1).cast("long") - F.col("uid")), F.col("words"))))
    mine = F.col("key") < 0
    rows = rows.select("uid", "key", *[F.when(mine, F.col(c)).alias(c) for c in ("doc_id", "role", "text")])
    return rows.join(vocabulary, "key", "left").groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("role").alias("role"), F.first("text", ignorenulls=True).alias("text"),
        F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("key", "kept", "held"))).alias("answers"),
    )


def weights_by_bucket(held: DataFrame, pairs: DataFrame) -> np.ndarray:
    """The likeliest weights for held-out pairs, from sums over cells of alike probabilities."""
    pair = F.coalesce("kept", F.lit(0)) / F.greatest(F.col("context"), F.lit(1)) * F.col("kinds")
    cell = lambda c: F.when(F.col(c) > 0, F.floor(F.log2(c) * CELLS))
    cells = (
        held.join(pairs.where("held > 0").select("key", "kept"), "key", "left").select("bucket", "n", pair.alias("pair"), "single")
        .groupBy("bucket", cell("pair").alias("p"), cell("single").alias("s"))
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("pair")).alias("pair"), F.sum(F.col("n") * F.col("single")).alias("single")).toPandas()
    )
    amount = cells["n"].to_numpy(dtype=float)
    parts = np.stack([cells["pair"].to_numpy(dtype=float) / amount, cells["single"].to_numpy(dtype=float) / amount, np.ones(len(cells))])
    return padded(likeliest(cells["bucket"].to_numpy(dtype=np.int64), amount, parts), 63)


def common_words(vocabulary: DataFrame) -> Counts:
    """The counts of the words with a frequency of some power of two or more: the least one that has at most `CACHED`."""
    level = F.length(F.bin(F.col("kept") + F.col("held")))
    by_level = sorted(((r["level"], r["count"]) for r in vocabulary.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, many = 64, 0
    for at, number in by_level:
        many += number
        if many > CACHED:
            break
        least = at
    found = vocabulary.where((level >= least) | (F.col("key") == END_WORD)).toPandas().sort_values("key")
    return Counts(*[found[c].to_numpy().astype(np.int64) for c in ("key", "kept", "held")])


def score_texts(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A NULL text is empty: one end. A NULL doc_id counts as the empty text for its fold. Repeated rows are scored (and
    counted) each. Other columns are ignored. An empty table gives an empty result; without training texts all counts are
    0. Scores are log10 of probabilities, summed over the tokens of a text.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), role(F.col("doc_id")).alias("role"))
    training = given.where(F.col("role") != TEST).select("text", "role")

    def counted(keys_of, name: str) -> DataFrame:
        partial = training.mapInArrow(_counting(keys_of), "key long, kept long, held long")
        return materialize(partial.groupBy("key").agg(F.sum("kept").alias("kept"), F.sum("held").alias("held")), name)

    vocabulary, pairs = counted(word_keys, "vocabulary"), counted(pair_keys, "pairs")
    totals = vocabulary.agg(F.sum("kept").alias("kept"), F.sum("held").alias("held"), F.count("*").alias("v")).first()
    kept, n, kinds = int(totals["kept"] or 0), int(totals["kept"] or 0) + int(totals["held"] or 0), int(totals["v"]) + 1
    cache = common_words(vocabulary)
    cache.hashes = cache.hashes.view(_U)
    _, ends_kept, ends_held = (int(x[0]) for x in cache.of(np.array([END_WORD], dtype=_U)))
    texts = materialize(with_counts(given, vocabulary, cache), "texts")
    held = texts.where(F.col("role") == HELD).select("text", "answers").mapInArrow(
        _held_pairs(cache, (ends_kept, ends_held), kept, kinds), "key long, n long, bucket int, context long, single double"
    )
    weights = weights_by_bucket(held.withColumn("kinds", F.lit(float(kinds))), pairs)

    stream = texts.select("uid", "doc_id", "text", "answers").mapInArrow(
        _scoring(cache, ends_kept + ends_held, weights, n, kinds),
        "uid long, doc_id long, n_tokens long, n_known long, base double, model double, keys array<long>, times array<int>, gains array<double>",
    )
    pair = "struct<key:long,n:int,gain:double>"
    own = F.struct(F.lit(-1).cast("long") - F.col("uid"), F.lit(0), F.lit(0.0)).cast(pair)
    met = F.arrays_zip(F.col("keys").alias("key"), F.col("times").alias("n"), F.col("gains").alias("gain")).cast(f"array<{pair}>")
    rows = stream.withColumn("w", F.explode(F.concat(F.array(own), met)))
    mine = F.col("w.key") < 0
    rows = rows.select(
        "uid", F.col("w.key").alias("key"), F.col("w.n").alias("n"), F.col("w.gain").alias("gain"),
        *[F.when(mine, F.col(c)).alias(c) for c in ("doc_id", "n_tokens", "n_known", "base", "model")],
    )
    c = F.coalesce(F.col("kept") + F.col("held"), F.lit(0))
    summed = rows.join(pairs, "key", "left").groupBy("uid").agg(
        *[F.max(x).alias(x) for x in ("doc_id", "n_tokens", "n_known", "base", "model")], F.sum(F.col("n") * F.log10(1 + c * F.col("gain"))).alias("more")
    )
    return summed.select(
        "doc_id", (role(F.col("doc_id")) == TEST).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("model") + F.col("more")).alias("score"),
    )
