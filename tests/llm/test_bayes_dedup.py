"""MinHash near-duplicates against all pairs, on groups of copies, chains and hubs that are far from each other."""

import numpy as np
import pytest

from quantloom.llm import bayes_dedup

from .test_operators import components_by_force, near_copies


def wanted(texts, size, percent):
    return [(i, n, root, i == root) for i, n, root in components_by_force(texts, size, percent)]


@pytest.mark.parametrize("chunk", [3, 512])
def test_components_equal_all_pairs(documents, odd_texts, monkeypatch, chunk):
    """With tiny chunks as well, so that every kind of piece of work occurs."""
    monkeypatch.setattr(bayes_dedup, "CHUNK_CLASSES", chunk)
    draw = np.random.Generator(np.random.PCG64(14))
    texts = odd_texts + near_copies(1, 50, 120, 8) + near_copies(2, 30, 18, 2) + near_copies(3, 12, 700, 60)
    # Chains: each text is near to the next one only; and texts that share half of their words.
    words = [f"c{i}" for i in range(400)]
    texts += [" ".join(words[k * 4 : k * 4 + 90]) for k in range(40)]
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"o{x}" for x in draw.integers(0, 10**6, 40)) for _ in range(30)]
    got = bayes_dedup.near_duplicates(documents(texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == wanted(texts, 4, 80)


def test_links_at_exactly_the_asked_likeness(documents):
    """8 of 10 and 80 of 100 shingles in common are links, one less is none."""
    words = [f"e{i}" for i in range(400)]
    texts = []
    for size, cut in ((10, 1), (100, 10)):
        common = size - 2 * cut
        for extra in (0, 1):
            tail = [f"t{size}{extra}{i}" for i in range(200)]
            left = words[: common + 3 - extra] + tail[: cut + extra]
            right = [f"h{size}{extra}{i}" for i in range(cut + extra)] + words[: common + 3 - extra]
            texts += [" ".join(w + str(size * 2 + extra) for w in side) for side in (left, right)]
    got = bayes_dedup.near_duplicates(documents(texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == wanted(texts, 4, 80)
    assert [r.component_id for r in sorted(got)] == [0, 0, 2, 3, 4, 4, 6, 7]


def test_rows_without_id_repeated_ids_and_clashing_columns(documents):
    text = " ".join(f"w{i}" for i in range(80))
    near, other = text + " more", " ".join(f"v{i}" for i in range(80))
    docs = documents([text, near, other, other, None, "", "left alone", "left alone"], [7, None, 7, 9, 5, None, None, None])
    clash = docs.withColumnsRenamed({"hub": "node", "key": "signature", "lang": "component_id"})
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in bayes_dedup.near_duplicates(clash).collect())
    assert got == [(0, 0, 0, True), (0, 1, 0, True), (0, 1, 0, True), (0, 78, 7, False), (5, 0, 5, True), (7, 77, 7, True), (7, 77, 7, True), (9, 77, 7, False)]
    assert bayes_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_two_texts_under_one_id_stay_apart(documents):
    """Each text of a repeated id has its own near copies."""
    base = [" ".join(f"{c}{i}" for i in range(70)) for c in "xy"]
    texts = [base[0], base[0] + " end", base[1], base[1] + " end"]
    rows = bayes_dedup.near_duplicates(documents(texts, [7, 20, 7, 3])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (7, 3), (7, 7), (20, 7)]


def test_posterior_bounds():
    """The cuts are the posterior's quantiles, found here by integration, and grow with the evidence."""
    cuts = bayes_dedup.least_matches(80)
    x = np.linspace(0, 1, 400_001)[1:-1]
    for k, cut in enumerate(cuts):
        n = (k + 1) * bayes_dedup.BATCH
        chance = []
        for m in (cut - 1, cut):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(log - log.max())
            chance.append(density[x >= 0.8].sum() / density.sum())
        assert chance[0] < bayes_dedup.MISS * 1.01 and chance[1] > bayes_dedup.MISS * 0.99
    assert cuts == sorted(cuts) and cuts[-1] / (bayes_dedup.BANDS * bayes_dedup.ROWS) > 0.6
