"""MinHash near-duplicates with sequential Bayesian verification of banded candidates.

1. *Signatures.* A document's set holds its distinct hashed shingles; documents with equal sets are one class. Each class
   has `BANDS` x `ROWS` minima of as many hash functions, 16 bits each.
2. *Bands.* Classes with the same minima in a band are candidates of each other. By (1 - s^ROWS)^BANDS a pair at the
   likeness asked for (0.8) has no common band once in 400 million. All classes of a band bucket meet at its least one.
3. *Verification.* Signatures are compared a batch of minima at a time. Of m equal ones among n, the likeness has the
   posterior Beta(m + 1, n - m + 1), and a pair is given up as soon as the chance that it reaches the asked likeness is
   below `MISS`. Survivors are verified by the exact intersection of their full sets, so that no false link is kept.
4. *Order of work.* First every class is compared with the least of its buckets only; that joins a large group of copies in
   linear work. Then, within a bucket, only classes that are still apart are compared with each other and with the rest,
   in chunks of bounded size, each pair of chunks as one piece of work. No pair is left out, none is written as a row.
5. *Components* of the links give each document the smallest doc_id it can reach.

Python runs in Arrow batches over numpy arrays; Spark partitions, groups, joins and shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import components
from .jaccard import Forest, filtered_scan
from .words import find_words, list_array, mix64, shingle_sets, text_slices

SIZE = 4
PERCENT = 80
BANDS = 50
ROWS = 5
#: Minima compared at a time.
BATCH = 25
#: Chance of the asked likeness below which a pair is given up.
MISS = 1e-9
#: Classes and set elements in a chunk of a bucket group, at most about so many.
CHUNK_CLASSES = 512
CHUNK_ELEMENTS = 1 << 18

PIECE = ["hub", "a", "b"]
_U = np.uint64
_SEEDS = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_FLIPS, _FACTORS = _SEEDS[::2], _SEEDS[1::2] | _U(1)


def minima(offsets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The 16-bit minima of every set, `BANDS` x `ROWS` columns; zeros for an empty set."""
    found = np.zeros((len(offsets) - 1, BANDS * ROWS), dtype=np.uint16)
    live = np.flatnonzero(np.diff(offsets))
    if len(live):
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat((tokens ^ _FLIPS[k]) * _FACTORS[k], offsets[live])
            found[live, k] = mix64(least) >> _U(48)
    return found


def set_names(offsets: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of every set, which do not depend on the order of its elements."""
    names = []
    for salt in (307, 401):
        running = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(tokens + _U(salt)), dtype=_U)])
        names.append(mix64(running[offsets[1:]] - running[offsets[:-1]] + np.diff(offsets).astype(_U)).view(np.int64))
    return names


def sign(size: int):
    """For `mapInArrow` over (doc_id, row_key, text): id, key, set size, the set's name and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                offsets, tokens = shingle_sets(find_words(part), size)
                signature, width = minima(offsets, tokens).tobytes(), 2 * BANDS * ROWS
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(part.first, part.last - part.first) for c in ("doc_id", "row_key")],
                        pa.array(np.diff(offsets), pa.int64()), *map(pa.array, set_names(offsets, tokens)),
                        pa.array([signature[i : i + width] for i in range(0, len(signature), width)], pa.binary()),
                    ],
                    names=["doc_id", "row_key", "n", "node", "check", "signature"],
                )

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BANDS * ROWS)


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For `mapInArrow` over (node, signature): a hash of the minima of each band."""
    for batch in batches:
        values = _signatures(batch.column("signature")).astype(_U).reshape(len(batch), BANDS, ROWS)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), (len(batch), BANDS))
        for k in range(ROWS):
            keys = mix64(keys * _U(0xD6E8FEB86659FD93) + values[:, :, k])
        offsets = np.arange(len(batch) + 1) * BANDS
        yield pa.RecordBatch.from_arrays([batch.column("node"), list_array(offsets, keys.ravel().view(np.int64), pa.int64())], names=["node", "keys"])


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """After each batch of minima, the fewest equal ones with which a pair is still compared.

    With a uniform prior, P(likeness >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    t, cuts = percent / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                cuts.append(m)
                break
    return cuts


def survivors(own: np.ndarray, others: np.ndarray, alive: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Of the rows `alive` of `others`, those that sequential comparison with `own` doesn't give up."""
    equal = np.zeros(len(alive), dtype=np.int64)
    for k, cut in enumerate(cuts):
        if not len(alive):
            break
        at = slice(k * BATCH, (k + 1) * BATCH)
        equal += (others[alive, at] == own[at]).sum(axis=1)
        kept = equal >= cut
        alive, equal = alive[kept], equal[kept]
    return alive


def piece_pairs(piece: dict, percent: int, cuts: list[int], apart) -> Iterator[tuple[int, np.ndarray]]:
    """For each class on the left of a piece, the classes on its right that may be linked; `apart(i, js)` picks those to compare."""
    side, n, signature = piece["side"], piece["n"], piece["signature"]
    lone = piece["key"][1] == piece["key"][2]
    left = np.flatnonzero(side == 0)
    right = left if lone else np.flatnonzero(side == 1)
    for i in left.tolist():
        js = right[right > i] if lone else right
        js = js[(100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])) & (n[js] > 0)]
        js = js[apart(i, js)]
        yield i, survivors(signature[i], signature, js, cuts)


def pieces(batches: Iterator[pa.RecordBatch], read) -> Iterator[dict]:
    """Pieces of rows sorted by `PIECE`, running across batches; `read(batch)` gives arrays or lists by column."""
    held: list[dict] = []

    def whole() -> dict:
        lists = [c for c, x in held[0].items() if isinstance(x, list)]
        return {c: sum((h[c] for h in held), []) if c in lists else np.concatenate([h[c] for h in held]) for c in held[0]}

    current = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in PIECE])
        columns = read(batch)
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
            key = tuple(keys[:, begin].tolist())
            if key != current and held:
                yield whole() | {"key": current}
                held = []
            current = key
            held.append({c: x[begin:end] for c, x in columns.items()})
    if held:
        yield whole() | {"key": current}


def _plain(batch: pa.RecordBatch) -> dict:
    return {c: batch.column(c).to_numpy() for c in ("side", "node", "n", "root")} | {"signature": _signatures(batch.column("signature"))}


def compare(percent: int):
    """For `mapInArrow` over rows sorted by piece: the classes that have a surviving partner in their piece."""
    schema = pa.schema([(c, pa.int64()) for c in (*PIECE, "side", "node")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = least_matches(percent)
        for piece in pieces(batches, _plain):
            root, reached = piece["root"], np.zeros(len(piece["node"]), dtype=bool)
            for i, js in piece_pairs(piece, percent, cuts, lambda i, js: root[js] != root[i]):
                reached[js] = True
                reached[i] |= len(js) > 0
            if reached.any():
                key = [np.full(reached.sum(), k) for k in piece["key"]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, key), *(pa.array(piece[c][reached]) for c in ("side", "node"))], schema=schema)

    return run


def verify(size: int, percent: int):
    """For `mapInArrow` over rows sorted by piece, with texts: the exact links, as few as join what they join."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def read(batch: pa.RecordBatch) -> dict:
        sets: list[np.ndarray] = []
        names = batch.column("node").to_numpy()
        for part in text_slices(batch.column("text")):
            offsets, tokens = shingle_sets(find_words(part), size)
            right = set_names(offsets, tokens)[0] == names[part.first : part.last]  # another row's text can only have come by an equal key
            sets += [tokens[offsets[i] : offsets[i + 1]].copy() if right[i] else tokens[:0] for i in range(len(right))]
        return _plain(batch) | {"sets": sets}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = least_matches(percent)
        for piece in pieces(batches, read):
            sets, names = piece["sets"], piece["node"]
            _, group = np.unique(piece["root"], return_inverse=True)
            forest = Forest(int(group.max()) + 1)
            roots = np.arange(len(forest.parent))
            links: list[tuple[int, int]] = []
            for i, js in piece_pairs(piece, percent, cuts, lambda i, js: roots[group[js]] != roots[group[i]]):
                joined = False
                for j in js.tolist():
                    if forest.root(group[i]) == forest.root(group[j]):
                        continue
                    small, large = sorted((sets[i], sets[j]), key=len)
                    at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
                    common = int((large[at] == small).sum()) if len(large) else 0
                    if common and 100 * common >= percent * (len(small) + len(large) - common):
                        forest.join(int(group[i]), int(group[j]))
                        links.append((names[i], names[j]))
                        joined = True
                if joined:
                    roots = np.array([forest.root(x) for x in range(len(roots))])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], schema=schema)

    return run


def row_key(doc_id: Column, text: Column) -> Column:
    """What a row's text is found by again."""
    return F.xxhash64(F.coalesce(doc_id, F.lit(-1)), doc_id.isNull(), F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` as (doc_id, n_shingles, component_id, kept); partners have a Jaccard likeness of `percent` % or more.

    Words are split at ASCII white space, A-Z lower-cased; sets are distinct shingles of `size` words, fewer words make
    one shingle. NULL and empty texts have an empty set, link with nothing and are their own component. Repeated rows and
    equal texts are in one component; several texts under one id are rows of their own that need not be. `kept` is whether
    doc_id is component_id. A row without id shares its class's component; where no row of a component has an id,
    component_id is NULL and all its rows are kept. Other columns of `docs` are ignored; an empty table gives an empty
    result. Shingles are compared by 64-bit hashes. A link at exactly the asked likeness is missed about once in 10^8
    times; higher ones more rarely. The bands are laid out for likenesses of 0.8 and more.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    given = given.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    signed = materialize(given.mapInArrow(sign(size), "doc_id long, row_key long, n long, node long, check long, signature binary"), "signed")
    classes = materialize(
        signed.where("n > 0").groupBy("node", "check", "n").agg(F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key"), F.min("signature").alias("signature")),
        "classes",
    )
    # One exchange serves the counts by key and the rows they are joined to.
    keyed = classes.select("node", "signature").mapInArrow(bands, "node long, keys array<long>").select("node", F.explode("keys").alias("key")).repartition(parts, "key")
    met = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    members = materialize(keyed.join(met, "key").where("node <> hub").select("node", "hub").distinct(), "members")

    facts = classes.select("node", "row_key", "n", "signature")
    sides = "hub long, a long, b long, side long, node long"

    def checked(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        """The links in pieces given as (hub, a, b, side, node)."""

        def informed(some: DataFrame) -> DataFrame:
            known = some.join(facts.hint("merge"), "node")
            known = known.join(roots.hint("merge"), "node", "left") if roots is not None else known.withColumn("root", F.lit(None).cast("long"))
            return known.withColumn("root", F.coalesce("root", "node"))

        def dealt(some: DataFrame) -> DataFrame:
            return some.repartition(parts, *PIECE).sortWithinPartitions(*PIECE, "side", "node")

        left = materialize(dealt(informed(rows).drop("row_key")).mapInArrow(compare(percent), sides), "survivors")
        wanted = materialize(left.select("node").distinct().join(facts.select("node", "row_key").hint("merge"), "node").select("row_key").distinct(), "wanted")
        with filtered_scan(spark):
            found = given.select("row_key", "text").join(wanted.where("row_key > -9223372036854775808").hint("merge"), "row_key", "left_semi")  # with a condition, Spark takes the filter to be selective
            texts = found.groupBy("row_key").agg(F.any_value("text").alias("text"))
            full = dealt(informed(left).join(texts.hint("merge"), "row_key"))
            return materialize(full.mapInArrow(verify(size, percent), "a long, b long"), "links")

    def chunked(sized: DataFrame, by: list[str]) -> DataFrame:
        counts = sized.groupBy(*by).agg(F.ceil(F.greatest(F.sum("n") / CHUNK_ELEMENTS, F.count("*") / CHUNK_CLASSES)).cast("long").alias("chunks"))
        return sized.join(counts, by).withColumn("chunk", F.pmod(F.xxhash64("node", "hub"), F.col("chunks")))

    # Every class with the least of its buckets, the star of a bucket group.
    sized = members.join(classes.select("node", "n").hint("merge"), "node")
    ray = chunked(sized, ["hub"]).select("hub", F.lit(-1).cast("long").alias("a"), F.col("chunk").alias("b"), F.lit(1).cast("long").alias("side"), "node")
    heart = ray.select("hub", "a", "b", F.lit(0).cast("long").alias("side"), F.col("hub").alias("node")).distinct()
    first = checked(ray.union(heart), None)
    roots = materialize(components(first).select("node", "root"), "roots")
    # What the stars left apart: class by class within the group, and against the classes that its least one is linked to.
    rooted = sized.join(roots.hint("merge"), "node", "left").withColumn("own", F.coalesce("root", "node")).drop("root")
    centre = roots.select(F.col("node").alias("hub"), F.col("root").alias("centre"))
    rooted = materialize(rooted.join(centre.hint("merge"), "hub", "left").select("hub", "node", "n", (F.col("own") != F.coalesce("centre", "hub")).alias("apart")), "apart")
    open_groups = rooted.groupBy("hub").agg(F.count("*").alias("all"), F.count_if("apart").alias("open")).where("open > 0 and all > 1").select("hub")
    rest = rooted.join(open_groups, "hub")
    near = chunked(rest, ["hub", "apart"])
    spans = near.groupBy("hub").agg(
        F.coalesce(F.max(F.when(~F.col("apart"), F.col("chunks"))), F.lit(0)).alias("tied"), F.max(F.when(F.col("apart"), F.col("chunks"))).alias("loose")
    )
    # Chunks of the loose classes are numbered after those of the tied ones; a tied chunk meets loose ones only.
    placed = near.join(spans, "hub").withColumn("own", F.col("chunk") + F.when(F.col("apart"), F.col("tied")).otherwise(0))
    others = F.when(F.col("apart"), F.sequence(F.lit(0).cast("long"), F.col("tied") + F.col("loose") - 1)).otherwise(F.sequence(F.col("tied"), F.col("tied") + F.col("loose") - 1))
    crossed = placed.withColumn("other", F.explode(others)).select(
        "hub", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("long").alias("side"), "node"
    )
    links = first.union(checked(crossed, roots))
    joined = classes.select("node", "check", "least_id").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = joined.join(least, "root").select("node", "check", "component_id")
    answer = signed.select("doc_id", "n", "node", "check").join(labels, ["node", "check"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return answer.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
