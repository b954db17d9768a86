"""Ranked lexical search by two trees: one over the items, one over the documents of a task.

The score of a document for an item is the sum, over the item's terms, of the term's weight times a value that grows with
the term's count in the document and falls with its length. All values are whole numbers.

1. *Items.* Each item's distinct terms, in blocks of at most `BLOCK_TERMS` of them, so that what a task is given has a fixed
   bound however many items there are. Every block is one pass over the documents' postings.
2. *Postings.* One scan of the texts gives each document's length and the counts of those terms that items ask for. Numbers
   of documents and terms, and each term's document frequency, are sums over all of them.
3. *Trees.* Documents of a batch, those with the same leading term next to each other, are leaves of `LEAF`, nodes of
   `FANOUT` leaves and so on; items likewise, down to single ones. A node of documents holds each term's greatest value below
   it, a node of items each term's weight where any item below has the term: their maxima by coordinate.
4. *Search.* The product of two nodes' maxima bounds every score below both. A pair of nodes is left, with the whole batch
   of items and documents below, when the bound lies under the weakest k-th best score of its items so far. The best
   documents of a task's earlier batches raise that score for the later ones. What remains is scored exactly.
5. *Merge.* Each task's best k by item are ranked by Spark.

Bounds are taken in doubles with a margin, scores in 64-bit integers, so nothing that belongs to the answer is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .words import byte_table, find_words, list_array, text_slices

K = 10
#: Distinct terms of items in a block, at most (a single item's own may be more).
BLOCK_TERMS = 1 << 17
#: Documents in a leaf, nodes under a node, and documents in the tree of a batch.
LEAF = 16
FANOUT = 8
BATCH = LEAF * FANOUT * FANOUT * 4
#: Bounds are raised by this share, well above what summing doubles can lose.
MARGIN = 1 + 1e-9

_IS_TERM = np.zeros(256, dtype=bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
NO_TERM = ~_IS_TERM
TERM_TABLE = byte_table(5, True, bytes(np.flatnonzero(NO_TERM).tolist()))

_I = np.int64


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For `mapInArrow` over (item_id, text): the hashes of all terms."""
    for batch in batches:
        for part in text_slices(batch.column("text")):
            terms = find_words(part, NO_TERM, TERM_TABLE)
            offsets = np.concatenate([[0], np.cumsum(terms.counts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").slice(part.first, part.last - part.first), list_array(offsets, terms.hashes.view(_I), pa.int64())],
                names=["item_id", "terms"],
            )


def postings(vocabulary: np.ndarray):
    """For `mapInArrow` over (doc_id, text): length in terms, and places in `vocabulary` with counts, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                terms = find_words(part, NO_TERM, TERM_TABLE)
                hashes = terms.hashes.view(_I)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                cells, counts = np.unique(terms.rows[known] * len(vocabulary) + at[known], return_counts=True)
                offsets = np.searchsorted(cells, np.arange(part.last - part.first + 1) * len(vocabulary))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.first, part.last - part.first), pa.array(terms.counts.astype(_I)),
                        list_array(offsets, (cells % len(vocabulary)).astype(np.int32), pa.int32()), list_array(offsets, counts.astype(_I), pa.int64()),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return run


def frequencies(n_terms: int):
    """For `mapInArrow` over (terms): the number of documents by term, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=_I)
        for batch in batches:
            column = batch.column("terms")
            offsets = column.offsets.to_numpy()
            total += np.bincount(column.values.to_numpy()[offsets[0] : offsets[-1]], minlength=n_terms)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["term", "df"])

    return run


@dataclass
class Items:
    """Items in the order of the tree: their ids, and for each its terms' places in the vocabulary; weights by term."""

    ids: list
    offsets: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def of(self, first: int, last: int) -> np.ndarray:
        """The terms of a node of items."""
        found = self.terms[self.offsets[first] : self.offsets[last]]
        return found if last - first == 1 else np.unique(found)


def item_tree(ids: list, owners: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> Items:
    """Items that share their commonest term, which differs by language, next to each other.

    `owners` and `terms` are the items' places in `ids` and their terms' in `weights`, ascending by both.
    """
    offsets = np.searchsorted(owners, np.arange(len(ids) + 1))
    commonest = np.full(len(ids), -1)
    by_weight = np.lexsort((terms, weights[terms], owners))
    live = np.flatnonzero(np.diff(offsets))
    commonest[live] = terms[by_weight[offsets[live]]]
    order = np.argsort(commonest, kind="stable")
    sizes = np.diff(offsets)[order]
    source = np.arange(sizes.sum()) + np.repeat(offsets[order] - (np.cumsum(sizes) - sizes), sizes)
    return Items([ids[i] for i in order.tolist()], np.concatenate([[0], np.cumsum(sizes)]), terms[source], weights)


class Best:
    """The best k documents of every item so far, and the k-th best score (0 while there are fewer)."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.docs: list[np.ndarray] = [np.zeros(0, _I)] * n_items
        self.nameless: list[np.ndarray] = [np.zeros(0, bool)] * n_items
        self.scores: list[np.ndarray] = [np.zeros(0, _I)] * n_items
        self.weakest = np.zeros(n_items, dtype=_I)

    def add(self, item: int, docs: np.ndarray, nameless: np.ndarray, scores: np.ndarray) -> None:
        docs, nameless, scores = (np.concatenate(x) for x in ((self.docs[item], docs), (self.nameless[item], nameless), (self.scores[item], scores)))
        order = np.lexsort((docs, nameless, -scores))[: self.k]
        self.docs[item], self.nameless[item], self.scores[item] = docs[order], nameless[order], scores[order]
        if len(order) == self.k:
            self.weakest[item] = scores[order[-1]]


class DocumentTree:
    """Documents of a batch with values by (document, term), sorted so that alike ones are next to each other."""

    def __init__(self, docs: np.ndarray, nameless: np.ndarray, owner: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray):
        worth = weights[terms] * values
        leading = np.full(len(docs), -1, dtype=_I)
        by_worth = np.lexsort((worth, owner))
        last = np.flatnonzero(np.append(owner[by_worth][1:] != owner[by_worth][:-1], True)) if len(owner) else np.zeros(0, _I)
        leading[owner[by_worth][last]] = terms[by_worth][last]
        order = np.argsort(leading, kind="stable")
        place = np.empty(len(docs), dtype=_I)
        place[order] = np.arange(len(docs))
        self.docs, self.nameless = docs[order], nameless[order]
        owner = place[owner]
        leaf = owner // LEAF
        by_leaf = np.lexsort((owner, terms, leaf))
        self.owner, self.values = owner[by_leaf], values[by_leaf]
        self.width = len(weights)
        cell = leaf[by_leaf] * self.width + terms[by_leaf]
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, _I)
        self.cells, self.bounds = cell[starts], np.append(starts, len(cell))
        # Maxima by coordinate, leaves first: a row for each term that occurs in the batch, a column for each node.
        n_leaves = -(-len(docs) // LEAF)
        self.present = np.unique(terms)
        level = np.zeros((len(self.present), n_leaves))
        if len(starts):
            level[np.searchsorted(self.present, self.cells % self.width), self.cells // self.width] = np.maximum.reduceat(self.values, starts)
        self.levels = [level]
        while self.levels[0].shape[1] > 1:
            below = self.levels[0]
            self.levels.insert(0, np.maximum.reduceat(below, np.arange(0, below.shape[1], FANOUT), axis=1))

    def bound(self, level: int, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A bound for each of `nodes` on any score for items whose terms are `terms`."""
        at = np.searchsorted(self.present, terms)
        inside = at < len(self.present)
        inside[inside] = self.present[at[inside]] == terms[inside]
        return (weights[terms[inside]] @ self.levels[level][np.ix_(at[inside], nodes)]) * MARGIN

    def score(self, leaves: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of `leaves` with any of `terms`, by place, and their exact scores."""
        wanted = (leaves[:, None] * self.width + terms[None, :]).ravel()
        at = np.searchsorted(self.cells, wanted)
        inside = at < len(self.cells)
        inside[inside] = self.cells[at[inside]] == wanted[inside]
        at = at[inside]
        sizes = self.bounds[at + 1] - self.bounds[at]
        rows = np.arange(sizes.sum()) + np.repeat(self.bounds[at] - (np.cumsum(sizes) - sizes), sizes)
        weight = np.repeat(weights[np.broadcast_to(terms, (len(leaves), len(terms))).ravel()[inside]], sizes)
        found, place = np.unique(self.owner[rows], return_inverse=True)
        scores = np.zeros(len(found), dtype=_I)
        np.add.at(scores, place, weight * self.values[rows])
        return found, scores


class Search:
    """Both trees' traversal; `visited` and `scored` count node pairs and exact (item, document) scores."""

    def __init__(self, items: Items, best: Best):
        self.items, self.best = items, best
        self.visited = self.scored = 0

    def run(self, tree: DocumentTree) -> None:
        if len(tree.docs) and len(self.items.ids) and len(tree.present):
            self.descend(tree, 0, np.zeros(1, dtype=_I), 0, len(self.items.ids))

    def descend(self, tree: DocumentTree, level: int, nodes: np.ndarray, first: int, last: int) -> None:
        """All items from `first` to `last` against all documents below `nodes`."""
        terms, weights = self.items.of(first, last), self.items.weights
        while True:
            bounds = tree.bound(level, nodes, terms, weights)
            self.visited += len(nodes)
            nodes, bounds = self.kept(nodes, bounds, first, last)
            if not len(nodes):
                return
            if level == len(tree.levels) - 1:
                break
            # One level down on each side in turn: children of the nodes, then the items' own halves.
            level += 1
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = nodes[nodes < tree.levels[level].shape[1]]
            if last - first > 1:
                break
        if last - first > 1:
            step = -(-(last - first) // FANOUT)
            for begin in range(first, last, step):
                self.descend(tree, level, nodes, begin, min(begin + step, last))
            return
        order = np.argsort(-bounds, kind="stable")
        nodes, bounds = nodes[order], bounds[order]
        while len(nodes):
            some = nodes[:FANOUT]
            places, scores = tree.score(some, terms, weights)
            self.scored += len(places)
            good = (scores > 0) & (scores >= self.best.weakest[first])
            self.best.add(first, tree.docs[places[good]], tree.nameless[places[good]], scores[good])
            nodes, bounds = self.kept(nodes[FANOUT:], bounds[FANOUT:], first, last)

    def kept(self, nodes: np.ndarray, bounds: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that may hold a document as good as the weakest k-th best of the items; an equal score may win by its id."""
        live = (bounds > 0) & (bounds >= self.best.weakest[first:last].min())
        return nodes[live], bounds[live]


def search(items: Items, n_docs: int, n_terms: int, k: int):
    """For `mapInArrow` over postings: a task's best `k` documents by item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), k)
        walk = Search(items, best)
        for whole in batches:
            for begin in range(0, len(whole), BATCH):
                batch = whole.slice(begin, BATCH)
                column, n = batch.column("doc_id"), batch.column("n").to_numpy()
                docs = column.fill_null(0).to_numpy()
                offsets = batch.column("terms").offsets.to_numpy()
                terms = batch.column("terms").values.to_numpy()[offsets[0] : offsets[-1]].astype(_I)
                counts = batch.column("counts").values.to_numpy()[offsets[0] : offsets[-1]]
                owner = np.repeat(np.arange(len(batch)), np.diff(offsets))
                m = 10 + (90 * n * n_docs) // max(n_terms, 1)
                values = (1_000_000_000 * counts) // (1000 * counts + 8 * m[owner])
                walk.run(DocumentTree(docs, column.is_null().to_numpy(zero_copy_only=False), owner, terms, values, items.weights))
        for item, docs in enumerate(best.docs):
            if len(docs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([items.ids[item]] * len(docs), pa.int64()), pa.array(docs, mask=best.nameless[item]), pa.array(best.scores[item])],
                    names=["item_id", "doc_id", "score"],
                )

    return run


def item_blocks(items: DataFrame) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Blocks of items: ids, and pairs of an item's place and a term's hash, each block within `BLOCK_TERMS` pairs.

    An item of more terms than that is a block of its own.
    """
    terms = items.mapInArrow(item_terms, "item_id long, terms array<long>").select("item_id", F.explode("terms").alias("term")).distinct()
    terms = materialize(terms, "item-terms")
    sizes = terms.groupBy("item_id").agg(F.count("*").alias("n"))
    total = terms.count()
    blocks = max(1, -(-2 * total // BLOCK_TERMS)) if total > BLOCK_TERMS else 1
    block = lambda: F.pmod(F.xxhash64("item_id", F.col("item_id").isNull()), F.lit(blocks))
    while sizes.groupBy(block().alias("block")).agg(F.sum("n").alias("n"), F.count("*").alias("items")).where(F.col("n") > BLOCK_TERMS).where("items > 1").count():
        blocks *= 2
    for number in range(blocks if total else 0):
        rows = terms.where(block() == number).toArrow()
        if not len(rows):
            continue
        nameless = rows["item_id"].is_null().to_numpy()
        ids, places = np.unique(rows["item_id"].fill_null(0).to_numpy()[~nameless], return_inverse=True)
        owners = np.full(len(rows), len(ids))
        owners[~nameless] = places
        names = ids.tolist() + [None] * bool(nameless.any())
        order = np.lexsort((rows["term"].to_numpy(), owners))
        yield names, owners[order], rows["term"].to_numpy()[order]


def best_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Each item's `k` best documents of positive score as (item_id, rank, doc_id, score), equal scores by ascending doc_id.

    `docs` has doc_id and text, `items` item_id and text. Terms are runs of ASCII letters, digits and all other than ASCII
    characters, A-Z lower-cased, compared by a 64-bit hash. NULL texts and texts without terms are no documents in the
    counts and match nothing; an item without terms has no rows. Rows of one item_id are one item with the terms of all,
    those without id too. Every row of `docs` is a document of its own, also where ids repeat; documents without id come
    last among equal scores. Other columns are ignored; an empty table gives an empty result. Results of all blocks of
    items are written before they are ranked.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    empty = spark.createDataFrame([], "item_id long, doc_id long, score long")
    found = None
    for ids, owners, hashes in item_blocks(asked):
        vocabulary, places = np.unique(hashes, return_inverse=True)
        order = np.lexsort((places, owners))
        posted = materialize(given.mapInArrow(postings(vocabulary), "doc_id long, n long, terms array<int>, counts array<long>"), "postings")
        n_docs, n_terms = posted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), dtype=_I)
        known = posted.select("terms").mapInArrow(frequencies(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df[known["term"].to_numpy()] = known["df"].to_numpy()
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(_I)
        tree = item_tree(ids, owners[order], places[order], weights)
        ranked = materialize(posted.where("n > 0").mapInArrow(search(tree, n_docs, n_terms, k), "item_id long, doc_id long, score long"), "ranked")
        found = ranked if found is None else found.union(ranked)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    merged = (empty if found is None else found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("item_id", "rank", "doc_id", "score")
