"""N-gram Jaccard join: partitioned universe, pigeonhole over segments, one-deletion neighbourhoods, exact checks.

A document's set holds its distinct hashed shingles. Two sets of sizes a and b with a Jaccard likeness of p % or more
differ in at most H = (a + b)(100 - p) / (100 + p) elements. Set sizes fall into bands so narrow that partners lie in
the same or the next band, and each band has its own H.

1. *Classes.* Documents with equal sets are one class; one member stands for it.
2. *Segments.* The universe of shingles is cut by hash into somewhat more than H + 1 segments. At most H elements differ,
   so of any H + 1 segments two partners have one in common: every class is indexed by the hashes of its segment subsets.
   The spare segments allow a class to leave out its empty ones, which are alike in unlike texts; the few classes with
   more empty segments than spare ones index them too, so that two of these meet as well.
3. *Allocation.* A segment that many classes share costs pairs: f(f - 1)/2. Where that is more than the signatures which
   its members' one-deletion neighbourhoods would take, the segment is left alone and its members are indexed again
   in half as many, twice as long segments, each with its subset and all subsets with one element less. Two partners
   then differ by at most one element in one segment. A pair is found in an uncrowded segment, or both of its members
   have a crowded one and it is found in the second index, so no link is lost.
4. *Checks.* Classes with a common key meet at the least class of that key. Groups are cut into chunks of bounded size.
   Each chunk by itself, with its group's least class, is one piece of work; that joins a large group of copies in linear
   work. A class first goes to one group only, that of the least class it meets, and to its other groups where their
   members don't hang together yet. Only the groups that still don't take the second index, or every pair of their chunks. First only short histograms of the sets are sent: two sets differ in at
   least as many elements as their histograms do, so members without any partner within reach drop out, and so do those whose
   partners within reach are all joined to them already. For the rest
   a task multiplies incidence matrices of the sets and keeps the exact links, as a spanning forest. Pairs are never
   written as rows.
5. *Components* of the links give each document the smallest doc_id it can reach.

Python runs in Arrow batches over numpy arrays; Spark partitions, groups, joins and shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release
from .graph import components
from .words import find_words, freed, list_array, mix64, shingle_sets, text_slices

SIZE = 3
PERCENT = 90
#: Set elements in a chunk of a group; what one piece of checking holds at a time is twice that.
CHUNK_ELEMENTS = 1 << 18
#: Shares of spare segments to choose from.
SPARE = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)
#: Classes that a task remembers to have indexed.
SEEN = 50_000
#: Classes in a chunk of a group, at most about so many.
CHUNK_CLASSES = 1024
#: Buckets of a histogram of a set, a byte each.
BUCKETS = 128
#: Vocabulary columns multiplied at a time.
COLUMNS = 2048
#: Rounds in which keys, and groups to check, are exchanged where they are many: the files of a round are removed with its end.
KEY_ROUNDS = 2
CHECK_ROUNDS = 3
#: Shingles, and members to check, from which on they are many.
MANY_SHINGLES = 5_000_000
MANY_MEMBERS = 10_000
#: Bytes of text whose sets are made at once.
PART_BYTES = 1 << 20

_U = np.uint64


class Bands:
    """Size bands `low[i]` to `high[i]`; by the band of the larger partner, the most elements in which partners differ
    (`differing`) and the number of segments."""

    def __init__(self, percent: int, largest: int):
        low = [1]
        while low[-1] * 100 // percent < largest:
            low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low)
        self.high = self.low * 100 // percent
        self.differing = 2 * self.high * (100 - percent) // (100 + percent)
        # The smallest set in a band's segments is `percent` of its low end; its share of empty ones should be spare.
        smallest = np.maximum(self.low * percent / 100, 1)
        segments = self.differing + 1
        for spare in SPARE:
            more = np.ceil((self.differing + 1) * (1 + spare)).astype(np.int64)
            segments = np.where(2 * np.exp(-smallest / segments) > segments / (self.differing + 1) - 1, more, segments)
        self.segments = np.where(self.differing > 0, segments, 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


def _segment_sums(tokens: np.ndarray, sizes: np.ndarray, segments: np.ndarray, salt: int):
    """Sum of mixed elements by (set, segment): the first cell of each set, cell bounds in `tokens`, and the sums.

    An element's segment grows with its value and a set is ascending, so each segment is a run.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate([[0], np.cumsum(segments)])
    high = tokens >> _U(32)
    cell = first[owner] + ((high * segments[owner].astype(_U)) >> _U(32)).astype(np.int64)
    bounds = np.searchsorted(cell, np.arange(first[-1] + 1))
    mixed = mix64(tokens ^ _U(salt))
    running = np.concatenate([np.zeros(1, _U), np.cumsum(mixed, dtype=_U)])
    return first, bounds, running[bounds[1:]] - running[bounds[:-1]], mixed, cell


def _cell_salt(bands: np.ndarray, segments: np.ndarray, salt: int) -> np.ndarray:
    """A number for each (band, segment), by set and segment in order."""
    place = np.arange(segments.sum()) - np.repeat(np.cumsum(segments) - segments, segments)
    return mix64((np.repeat(bands, segments).astype(_U) << _U(32)) + place.astype(_U) + _U(salt))


def segment_keys(tokens: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the first index, each set under its own band and the next: counts by set, and the keys."""
    keys, counts = [], np.zeros(len(sizes), dtype=np.int64)
    owners = []
    for ahead in (0, 1):
        band = bands.of(np.maximum(sizes, 1)) + ahead
        differing = bands.differing[band]
        segments = np.where(sizes > 0, bands.segments[band], 0)
        live = segments > 0
        if not live.any():
            continue
        inside = np.repeat(live, sizes)
        first, bounds, sums, _, _ = _segment_sums(tokens[inside], sizes[live], segments[live], 0)
        owner = np.repeat(np.flatnonzero(live), segments[live])
        empty = bounds[1:] == bounds[:-1]
        spare = segments[live] - bands.differing[band[live]] - 1
        wanted = ~empty | np.repeat(np.add.reduceat(empty, first[:-1], dtype=np.int64) > spare, segments[live])
        keys.append(mix64(sums + _cell_salt(band[live], segments[live], 11))[wanted])
        owners.append(owner[wanted])
        counts += np.bincount(owner[wanted], minlength=len(sizes))
    if not keys:
        return counts, np.zeros(0, _U)
    owner = np.concatenate(owners)
    return counts, np.concatenate(keys)[np.argsort(owner, kind="stable")]


def deletion_keys(tokens: np.ndarray, size: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the second index for one set: subsets of the longer segments, and those with one element deleted."""
    whole, without = [], []
    for ahead in (0, 1):
        band = bands.of(np.array([size])) + ahead
        segments = (bands.differing[band] + 2) // 2
        _, _, sums, mixed, cell = _segment_sums(tokens, np.array([size]), segments, 77)
        salt = _cell_salt(band, segments, 13)
        whole.append(mix64(sums + salt))
        without.append(mix64(sums[cell] - mixed + salt[cell]))
    return np.concatenate(whole), np.concatenate(without)


def _long(values: np.ndarray) -> np.ndarray:
    return values.astype(_U).view(np.int64)


def _set_hashes(offsets: np.ndarray, tokens: np.ndarray, salt: int) -> np.ndarray:
    running = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(tokens + _U(salt)), dtype=_U)])
    return mix64(running[offsets[1:]] - running[offsets[:-1]] + np.diff(offsets).astype(_U))


def name_sets(size: int):
    """For `mapInArrow` over (doc_id, text_key, text): the id and key, the set's size and a 128-bit hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text"), PART_BYTES):
                offsets, tokens = shingle_sets(find_words(part), size)
                hashes = [pa.array(_long(_set_hashes(offsets, tokens, salt))) for salt in (101, 211)]
                sizes = np.diff(offsets)
                cell = np.repeat(np.arange(len(sizes)), sizes) * BUCKETS + (mix64(tokens ^ _U(5)) % _U(BUCKETS)).astype(np.int64)
                histogram = np.minimum(np.bincount(cell, minlength=len(sizes) * BUCKETS), 255).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(part.first, part.last - part.first) for c in ("doc_id", "text_key")], pa.array(sizes, pa.int64()), *hashes,
                        pa.array([histogram[i : i + BUCKETS] for i in range(0, len(histogram), BUCKETS)], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n", "node", "check", "histogram"],
                )

    return run


def index_sets(size: int, percent: int):
    """For `mapInArrow` over (text): class, set size and the keys of the first index. A task does so once for a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent, 1 << 20), set()
        for batch in batches:
            for part in text_slices(batch.column("text"), PART_BYTES):
                offsets, tokens = shingle_sets(find_words(part), size)
                sizes = np.diff(offsets)
                if len(sizes) and sizes.max() * 2 > bands.high[-1]:
                    bands = Bands(percent, int(sizes.max()) * 4)
                nodes = _long(_set_hashes(offsets, tokens, 101))
                new = np.zeros(len(nodes), dtype=bool)
                for row, node in enumerate(nodes.tolist()):
                    if node not in seen:
                        seen.add(node)
                        new[row] = True
                if len(seen) > SEEN:
                    seen.clear()
                counts, keys = segment_keys(tokens[np.repeat(new, sizes)], sizes[new], bands)
                key_offsets = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[new]), pa.array(sizes[new], pa.int64()), list_array(key_offsets, _long(keys), pa.int64())], names=["node", "n", "keys"]
                )

    return run


def set_rows(size: int):
    """For `mapInArrow` over (node, text): the class and its set; a text that isn't of the class, which took an equal key, is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text"), PART_BYTES):
                offsets, tokens = shingle_sets(find_words(part), size)
                nodes = batch.column("node").slice(part.first, part.last - part.first)
                own = pa.array(_long(_set_hashes(offsets, tokens, 101)) == nodes.to_numpy())
                found = pa.RecordBatch.from_arrays([nodes, list_array(offsets, _long(tokens), pa.int64())], names=["node", "elements"])
                yield found.filter(own)

    return run


def crowded_rows(percent: int):
    """For `mapInArrow` over (node, elements): the keys of the second index, exact ones flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, 1 << 20)
        for batch in batches:
            column = batch.column("elements")
            values = column.values.to_numpy(zero_copy_only=False).view(_U)
            offsets = column.offsets.to_numpy()
            for row, node in enumerate(batch.column("node").to_numpy()):
                tokens = values[offsets[row] : offsets[row + 1]]
                if len(tokens) * 2 > bands.high[-1]:
                    bands = Bands(percent, len(tokens) * 4)
                whole, without = deletion_keys(tokens, len(tokens), bands)
                n = len(whole) + len(without)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, node)), pa.array(_long(np.concatenate([whole, without]))), pa.array(np.arange(n) < len(whole))],
                    names=["node", "key", "exact"],
                )

    return run


class Forest:
    """Union-find over the rows of one piece of work."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def exact_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard likeness is `percent` or more, by exact intersections."""
    n, forest, links = len(sets), Forest(len(sets)), []
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * common >= percent * (sizes.sum() - common) else []
    vocabulary, place, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    column = np.cumsum(shared > 1) - 1  # elements of a single set meet nothing
    useful = shared[place] > 1
    owner, place = owner[useful], column[place[useful]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((n, n), dtype=np.float32)
    width = int(place[-1]) + 1 if len(place) else 0
    for begin in range(0, width, COLUMNS):
        a, b = np.searchsorted(place, [begin, begin + COLUMNS])
        block = np.zeros((n, min(COLUMNS, width - begin)), dtype=np.float32)
        block[owner[a:b], place[a:b] - begin] = 1
        common += block @ block.T
    for i in range(n - 1):
        both = common[i, i + 1 :].astype(np.int64)
        for j in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[i + 1 :] - both)):
            if forest.join(i, i + 1 + int(j)):
                links.append((i, i + 1 + int(j)))
    return links


def pieces_of(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple[tuple, list, list] | None]:
    """Pieces (key, nodes, values) of rows sorted by (hub, a, b), running across batches; None after each batch."""
    current, nodes, values = None, [], []
    for batch in batches:
        column = batch.column(value)
        if pa.types.is_list(column.type):
            flat, offsets = column.values.to_numpy(zero_copy_only=False).view(_U), column.offsets.to_numpy()
            found = [flat[a:b].copy() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        else:
            found = [np.frombuffer(x, np.uint8) for x in column.to_pylist()]
        keys = zip(*(batch.column(c).to_pylist() for c in ("hub", "a", "b")), strict=True)
        for key, node, one in zip(keys, batch.column("node").to_pylist(), found, strict=True):
            if key != current:
                if len(nodes) > 1:
                    yield current, nodes, values
                current, nodes, values = key, [], []
            nodes.append(node)
            values.append(one)
        yield None
    if len(nodes) > 1:
        yield current, nodes, values


def within_reach(sizes: np.ndarray, histograms: np.ndarray, roots: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have any partner of another root whose size and histogram allow a link."""
    n = len(sizes)
    reached = np.zeros(n, dtype=bool)
    for i in range(n - 1):
        differ = np.abs(histograms[i + 1 :] - histograms[i]).sum(axis=1)
        both = sizes[i + 1 :] + sizes[i]
        # Of d differing elements among `both`, (both - d) / 2 are common to the (both + d) / 2 of the union.
        near = (100 * (both - differ) >= percent * (both + differ)) & (roots[i + 1 :] != roots[i])
        reached[i] |= near.any()
        reached[i + 1 :] |= near
    return reached


def prune_groups(percent: int):
    """For `mapInArrow` over rows sorted by (hub, a, b): the members that have a partner within reach to which they aren't joined yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        schema = pa.schema([(c, pa.int64()) for c in ("hub", "a", "b", "node")])
        for piece in pieces_of(batches, "sketch"):
            if piece:
                key, nodes, values = piece
                sketches = np.stack(values)
                sizes, roots = sketches[:, BUCKETS:].copy().view(">i8").T
                reached = within_reach(sizes, sketches[:, :BUCKETS].astype(np.int64), roots, percent)
                kept += [(*key, nodes[i]) for i in np.flatnonzero(reached)]
            elif kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], schema=schema)
                kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], schema=schema)

    return run


def check_groups(percent: int):
    """For `mapInArrow` over rows sorted by (hub, a, b): the links found in each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        for piece in pieces_of(batches, "elements"):
            if piece:
                _, nodes, sets = piece
                for i, j in exact_links(sets, percent):
                    left.append(nodes[i])
                    right.append(nodes[j])
            else:
                yield found()
                left, right = [], []
        yield found()

    return run


@contextmanager
def filtered_scan(spark: SparkSession) -> Iterator[None]:
    """Lets Spark put a Bloom filter of a join's smaller side into the scan of the larger one, whatever that one's size."""
    settings = {
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
        # The filter is left out where a side is small enough for a broadcast; these joins are merged at every size.
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def in_rounds(rounds: int, written: Callable[[int], DataFrame], name: str, distinct: bool = False) -> DataFrame:
    """The union of the tables that `written` returns for each round, as one table."""
    tables = [written(number) for number in range(rounds)]
    if rounds == 1:
        return tables[0]
    whole = reduce(DataFrame.union, tables)
    joined = materialize(whole.distinct() if distinct else whole, name)
    release(*tables)
    return joined


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` as (doc_id, n_shingles, component_id); partners have a Jaccard likeness of `percent` % or more.

    Words are split at ASCII white space, A-Z lower-cased; sets are distinct shingles of `size` words, fewer words make
    one shingle. NULL and empty texts have an empty set, link with nothing and are their own component. Repeated rows
    and equal texts are in one component; the result has as many rows as `docs`. A row without id shares its class's
    component; where no row of a component has an id, component_id is NULL. Several texts under one id are rows of their
    own, each in the component of its text. Other columns of `docs` are ignored.
    Shingles and sets are compared by 64-bit and 128-bit hashes. An empty table gives an empty result.
    """
    return near_components(docs, size, percent, id_col, text_col).drop("text_key", "group", "leads")


def text_key(doc_id: Column, text: Column) -> Column:
    """What a row is known by: a hash of its id and text."""
    return F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(-1)), doc_id.isNull(), F.coalesce(text, F.lit("")))


def near_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`near_duplicates` with `text_key`, which tells texts of one id and rows without id apart.

    Also `group`, a number of the component (NULL without words), and `leads`: whether the row is of the class that stands for its component, which is that of the least id, of
    several texts under that id the one of the least set hash; in a component without ids the least text key.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", text_key(F.col("doc_id"), F.col("text")).alias("text_key"), "text"
    )
    # Sides that grow with the input are merged at every size, never broadcast where they happen to be small.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    indexed = materialize(given.mapInArrow(freed(name_sets(size)), "doc_id long, text_key long, n long, node long, check long, histogram binary"), "indexed")
    classes = materialize(
        indexed.where("n > 0").groupBy("node", "check", "n").agg(
            F.min("doc_id").alias("least_id"), F.min("text_key").alias("text_key"), F.min("histogram").alias("histogram")
        ),
        "classes",
    )
    first = classes.select("node", "text_key")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = materialize(nodes.distinct().join(first.hint("merge"), "node"), "wanted")
        # With a condition, Spark takes the filter to be selective; it makes none of an aggregate, as distinct() would be.
        keys = wanted.select("text_key").where("text_key > -9223372036854775808")
        with filtered_scan(spark):
            # Only rows of one id and one text have one key, and of those one text goes on.
            texts = given.select("text_key", "text").join(keys.hint("merge"), "text_key", "left_semi").groupBy("text_key").agg(F.any_value("text").alias("text"))
            named = wanted.join(texts.hint("merge"), "text_key").select("node", "text")
            found = materialize(named.mapInArrow(freed(set_rows(size)), "node long, elements array<long>"), "sets")
        release(wanted)
        return found

    shingles = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    key_rounds = KEY_ROUNDS if shingles >= MANY_SHINGLES else 1

    def members_of(number: int) -> DataFrame:
        """Classes that share a key of this round."""
        # One exchange serves the counts by key and the rows they are joined to.
        signatures = (
            given.select("text").mapInArrow(freed(index_sets(size, percent)), "node long, n long, keys array<long>")
            .select("node", "n", F.explode("keys").alias("key")).where("key is not null and n is not null")
            .where(F.pmod("key", F.lit(key_rounds)) == number).repartition(parts, "key")
        )
        met = (
            signatures.groupBy("key").agg(F.count("*").alias("f"), F.min("node").alias("hub"), F.max("node").alias("last"), F.max("n").alias("most"))
            .where("hub < last").select("key", "hub", "most", (F.col("f") - 1 > 2 * F.col("most")).alias("crowded"))
        )
        return materialize(signatures.join(met, "key").where("n <= most").select("node", "n", "hub", "crowded").distinct(), "members")

    members = in_rounds(key_rounds, members_of, "members", distinct=True)
    key = ["hub", "a", "b"]
    facts = classes.select("node", "n", "histogram")

    def chunk_count() -> Column:
        return F.ceil(F.greatest(F.sum("n") / CHUNK_ELEMENTS, F.count("*") / CHUNK_CLASSES)).cast("long")

    def chunked(sized: DataFrame) -> DataFrame:
        """(hub, node, chunk, chunks): the members (hub, node, n) of each group in chunks of bounded size."""
        chunks = sized.groupBy("hub").agg(chunk_count().alias("chunks"))
        return sized.join(chunks, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "chunks")

    def eight_bytes(number: str) -> Column:
        return F.unhex(F.lpad(F.hex(number), 16, "0"))

    def checked(pieces: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        """The links in pieces given as (hub, a, b, node), between classes that `roots` doesn't join."""
        sketched = pieces.join(facts.hint("merge"), "node")
        sketched = sketched.withColumn("root", F.col("node")) if roots is None else rooted(sketched, roots)
        sketched = sketched.select(*key, "node", F.concat("histogram", eight_bytes("n"), eight_bytes("root")).alias("sketch"))
        near = materialize(
            sketched.repartition(parts, *key).sortWithinPartitions(*key, "node").mapInArrow(freed(prune_groups(percent)), "hub long, a long, b long, node long"), "near"
        )
        rounds = CHECK_ROUNDS if near.count() >= MANY_MEMBERS else 1

        def links_of(number: int) -> DataFrame:
            some = near.where(F.pmod(F.xxhash64("hub"), F.lit(rounds)) == number)
            sets = sets_of(some.select("node"))
            full = some.join(sets.hint("merge"), "node").repartition(parts, *key).sortWithinPartitions(*key, "node")
            links = materialize(full.mapInArrow(freed(check_groups(percent)), "a long, b long"), "links")
            release(sets)
            return links

        links = in_rounds(rounds, links_of, "links")
        release(near)
        return links

    def alone(placed: DataFrame) -> DataFrame:
        """Each chunk by itself, with its group's least class: linear work, and enough for all but few large groups."""
        rows = placed.select("hub", F.col("chunk").alias("a"), F.col("chunk").alias("b"), "node")
        return rows.union(rows.select("hub", "a", "b", F.col("hub").alias("node")).distinct()).distinct()

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    # Near copies share a key in nearly every segment, each with a least class of its own; one such group joins most of them.
    sized = members.select("node", "n", "hub").distinct()
    own = sized.groupBy("node").agg(F.min("hub").alias("own"))
    owned = materialize(sized.join(own.hint("merge"), "node").select("node", "n", "hub", (F.col("hub") == F.col("own")).alias("is_own")), "owned")
    own_links = checked(alone(chunked(owned.where("is_own").select("node", "n", "hub"))))
    apart = F.min("root") < F.max("root")
    # A group that was checked whole, in one piece, has no more links to find.
    whole = F.bool_and(F.col("is_own") | (F.col("node") == F.col("hub"))) & (chunk_count() == 1)
    own_roots = materialize(components(own_links), "joined")
    left = rooted(owned, own_roots).groupBy("hub").agg(apart.alias("apart"), whole.alias("whole")).where("apart and not whole").select("hub")
    placed = materialize(chunked(owned.select("node", "n", "hub").join(left, "hub")), "placed")
    first_links = own_links.union(checked(alone(placed), own_roots))
    first_roots = materialize(components(first_links), "joined")
    # Groups of several chunks that don't hang together yet.
    apart = materialize(rooted(placed.where("chunks > 1"), first_roots).groupBy("hub").agg(apart.alias("apart")).where("apart").select("hub"), "apart")
    open_members = materialize(members.join(apart, "hub").select("node", "n", "hub", "crowded").distinct(), "open")
    open_sets = sets_of(open_members.where("crowded").select("node"))
    second = materialize(open_sets.mapInArrow(freed(crowded_rows(percent)), "node long, key long, exact boolean"), "deleted")
    release(open_sets)
    meeting = (
        second.groupBy("key").agg(F.max("exact").alias("exact"), F.min("node").alias("hub"), F.max("node").alias("last"))
        .where("exact and hub < last").select("key", "hub")
    )
    groups = materialize(
        open_members.where("not crowded").select("node", "n", "hub").union(
            second.join(meeting, "key").select("node", "hub").distinct().join(open_members.select("node", "n").distinct(), "node").select("node", "n", "hub")
        ).distinct(),
        "groups",
    )
    others = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    paired = chunked(groups).withColumn("other", F.explode(others)).select(
        "hub", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "node"
    )
    links = first_links.union(checked(paired, first_roots))
    roots = components(links)
    joined = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # NULL is the greatest here, so that a class with an id comes before those without.
    order = F.struct(F.col("least_id").isNull(), F.coalesce("least_id", F.lit(0)), F.when(F.col("least_id").isNull(), F.col("text_key")).otherwise(F.col("node")))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min(order).alias("leader"))
    labels = joined.join(least, "root").select("node", "check", "component_id", "root", (order == F.col("leader")).alias("leads"))
    return (
        indexed.select("doc_id", "text_key", "n", "node", "check").join(labels, ["node", "check"], "left")
        .select(
            "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.col("root").alias("group"), F.coalesce("leads", F.lit(True)).alias("leads"),
        )
    )
