"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quantloom.llm import dual_tree_search, licenses

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(licenses.UPPER, licenses.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def by_force(docs, items, k):
    """All (item_id, rank, doc_id, score)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in counts:
            if c:
                m = 100 - 90 + (90 * c.total() * n_docs) // total
                weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in wanted}
                score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted)
                if score > 0:
                    scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(result):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in result.collect()), key=str)


def corpus(seed, n):
    draw = np.random.Generator(np.random.PCG64(seed))
    return [" ".join(f"{'abc'[i % 3]}{x}" for x in draw.zipf(1.4, draw.integers(1, 90)) % 900) for i in range(n)]


@pytest.mark.parametrize("leaf,fanout,block", [(16, 8, 1 << 17), (2, 2, 1 << 17), (3, 4, 60)])
def test_best_documents_equal_full_scoring(spark, documents, odd_texts, monkeypatch, leaf, fanout, block):
    """With small nodes and small item blocks as well; texts repeat, so that scores tie."""
    for name, value in (("LEAF", leaf), ("FANOUT", fanout), ("BATCH", leaf * fanout * 8), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(dual_tree_search, name, value)
    texts = odd_texts + corpus(1, 400) + corpus(2, 30) * 4
    asked = [(i, t) for i, t in enumerate(corpus(3, 40))]
    asked += [(3, "Größe 漢字"), (90, None), (91, "!?"), (None, "word1 and2 漢字"), (92, "WORD1-and2_and2"), (93, "nowhere")]
    items = spark.createDataFrame([(i, t, 1) for i, t in asked], "item_id long, text string, rank int")
    docs = documents(texts).repartition(3)
    assert found(dual_tree_search.best_documents(docs, items, 5)) == by_force(list(enumerate(texts)), asked, 5)


def test_repeated_and_missing_ids_and_empty_tables(spark, documents):
    texts = ["red blue", "red blue", "red", None, "green red blue"]
    ids = [None, 4, 4, 9, 2]
    items = spark.createDataFrame([(1, "Red BLUE"), (1, "red blue")], "item_id long, text string")
    docs = documents(texts, ids)
    clash = docs.withColumnsRenamed({"hub": "n", "key": "terms", "lang": "score"})
    assert found(dual_tree_search.best_documents(clash, items)) == by_force(list(zip(ids, texts, strict=True)), [(1, "red blue")], 10)
    assert dual_tree_search.best_documents(docs.limit(0), items).count() == 0
    assert dual_tree_search.best_documents(docs, items.limit(0)).count() == 0


def test_batches_are_pruned():
    """Node pairs and documents left out; the answer is tested above."""
    draw = np.random.Generator(np.random.PCG64(5))
    n, width = 4096, 300
    weights = draw.integers(1, 9000, width)
    owner = np.repeat(np.arange(n), 20)
    topic = np.repeat(draw.integers(0, 10, n), 20)
    terms_ = topic * 30 + np.concatenate([draw.permutation(30)[:20] for _ in range(n)])
    cells = np.unique(owner * width + terms_)
    tree = dual_tree_search.DocumentTree(np.arange(n), np.zeros(n, bool), cells // width, cells % width, draw.integers(1, 1000, len(cells)), weights)
    owners = np.repeat(np.arange(50), 8)
    asked = np.concatenate([np.sort(i % 10 * 30 + draw.permutation(30)[:8]) for i in range(50)])
    items = dual_tree_search.item_tree(list(range(50)), owners, asked, weights)
    walk = dual_tree_search.Search(items, dual_tree_search.Best(50, 10))
    walk.run(tree)
    assert walk.scored < 0.1 * 50 * n
    assert walk.visited < 0.5 * 50 * n / dual_tree_search.LEAF
