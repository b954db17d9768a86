"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quantloom.llm import bpe, fingerprints, jaccard, licenses, mixing, neighbours, ngram_lm, preferences, queries, ranking, token_rollup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(licenses.UPPER, licenses.LOWER)


def shingles(text, size):
    words = WORD.findall((text or "").translate(FOLD))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components_by_force(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                union = len(sets[i] | sets[j])
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * union:
                    root[i] = root[j] = min(root[i], root[j])
    return [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))]


def near_copies(seed, n, words, edits):
    draw = np.random.Generator(np.random.PCG64(seed))
    base = [f"w{x}" for x in draw.integers(0, 10**6, words)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for at in draw.integers(0, words, draw.integers(0, edits + 1)):
            copy[at] = f"e{draw.integers(0, 10**6)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_join(documents, odd_texts, size, percent):
    texts = odd_texts + near_copies(1, 60, 120, 6) + near_copies(2, 30, 14, 1) + near_copies(3, 12, 700, 40)
    got = jaccard.near_duplicates(documents(texts), size, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_force(texts, size, percent)


def test_crowded_segments_lose_no_link():
    """A pair that shares no segment key must share a key of the second index when it is near enough."""
    bands = jaccard.Bands(90, 10**4)
    draw = np.random.Generator(np.random.PCG64(5))
    for n in (10, 19, 57, 300):
        for _ in range(40):
            left = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
            most = 2 * len(left) * 10 // 190
            drop = draw.integers(0, most + 1)
            right = np.unique(np.concatenate([left[drop:], draw.integers(0, 2**63, most - drop, dtype=np.uint64)]))
            common = len(np.intersect1d(left, right))
            if 100 * common < 90 * (len(left) + len(right) - common):
                continue
            one, two = (jaccard.segment_keys(x, np.array([len(x)]), bands)[1] for x in (left, right))
            assert len(np.intersect1d(one, two)) or np.array_equal(left, right)
            (a, a_without), (b, b_without) = (jaccard.deletion_keys(x, len(x), bands) for x in (left, right))
            assert len(np.intersect1d(a, b)) or len(np.intersect1d(a, b_without)) or len(np.intersect1d(a_without, b))


def test_mixing_follows_the_distribution(spark, documents):
    docs = documents([f"text number {i}" for i in range(3000)])
    weights = spark.createDataFrame([("s0", 3.0), ("s1", 1.0), (None, 1.0)], "source string, weight double")
    mixed = mixing.mix(docs, weights)
    again = mixing.mix(docs.repartition(5), weights)
    assert sorted(mixed.collect(), key=str) == sorted(again.collect(), key=str)
    count = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert "s2" not in count
    assert abs(count["s0"] / sum(count.values()) - 0.6) < 0.05
    copies = {(r.doc_id, r.source): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    rate = count["s0"] / 800
    share = Counter(copies.get((i, "s0"), 0) for i in range(3000) if i % 3 == 0 and i % 5)
    for k in range(4):
        assert abs(share[k] / 800 - math.exp(-rate) * rate**k / math.factorial(k)) < 0.06


def test_fingerprints(documents, odd_texts):
    texts = odd_texts + near_copies(4, 6, 300, 5)
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(documents(texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        own, following = text or "", texts[(i + 1) % len(texts)] or ""
        quarter = len(own) // 4
        edited = own[: len(own) - quarter] + following[:quarter]
        assert rows[i].n_chars == len(own)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[i].fingerprint == rows[i].edited_fingerprint) or own != edited
    assert rows[5].fingerprint == rows[6].fingerprint and rows[5].near_next == 1.0
    n = len(odd_texts)
    for i in range(n, len(texts) - 1):
        a, b = shingles(texts[i], 5), shingles(texts[i + 1], 5)
        assert abs(rows[i].near_next - len(a & b) / len(a | b)) < 0.16


def test_language_model(documents, odd_texts):
    texts = odd_texts + [f"the cat of the house {i} sees the dog" for i in range(60)]
    rows = {r.doc_id: r for r in ngram_lm.score_texts(documents(texts)).collect()}
    tokens = {i: [*WORD.findall((t or "").translate(FOLD)), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total, kinds = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        assert (rows[i].held_out, rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), total)
        assert rows[i].base_score == pytest.approx(base, abs=1e-6)
        assert rows[i].score < 0
    alike = [r for i, r in rows.items() if i >= len(odd_texts) and r.held_out]
    assert alike and sum(r.score for r in alike) > sum(r.base_score for r in alike)
    assert all(r.score > 2 * r.base_score - 20 for r in rows.values())


def test_class_probabilities_sum_to_one():
    draw = np.random.Generator(np.random.PCG64(3))
    kept, held = draw.integers(0, 50, (6, 5)), draw.integers(0, 6, (6, 5))
    assert (10 ** ngram_lm.class_scores(kept, held)).sum(axis=1) == pytest.approx(np.ones(6))


def test_ranking_accepts_good_and_rejects_junk(documents, labels_of):
    draw = np.random.Generator(np.random.PCG64(9))
    good = [" ".join(f"word{draw.integers(0, 400)}" for _ in range(80)) + "." for _ in range(150)]
    junk = [("SPAM!!%d " % draw.integers(0, 3)) * 60 for _ in range(100)]
    texts = good + junk + [None, ""]
    docs, labels = documents(texts), labels_of([(i, int(i < 150), 0) for i in range(250)] + [(None, 1, 0), (3, None, 0)])
    rows = {r.doc_id: r for r in ranking.score_documents(docs, labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert all(rows[i].predicted == int(i < 150) for i in range(250))
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    kept = ranking.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}
    assert ranking.accepted(docs, labels.limit(0)).count() == len(texts)


def test_licenses_are_found_and_inherited(spark):
    line = "Released under the MIT License"
    files = [
        ("a/LICENSE", f"{line}\n" + "filler words\n" * 50), ("a/b/c/x.py", "print"), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
        ("a/b/y.py", f"# {line}.\ncode"), ("z/q.py", None), (None, line), ("top.py", ""), ("a/b/y.py", f"# {line}.\ncode"),
    ] + [(f"n/{i}.txt", f"some plain text of the number {i}\nthis is a line") for i in range(40)]
    found = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert len(found) == 46
    assert (found["a/LICENSE"].license, found["a/LICENSE"].origin) == ("MIT", "own")
    assert (found["a/b/c/x.py"].license, found["a/b/c/x.py"].directory) == ("Apache-2.0", "a/b")
    assert (found["a/b/y.py"].license, found["a/b/y.py"].origin) == ("MIT", "own")
    assert {found[p].origin for p in ("z/q.py", "top.py", "n/3.txt")} == {"none"}


def test_neighbours_are_exact(spark):
    draw = np.random.Generator(np.random.PCG64(11))
    vectors = draw.normal(size=(700, 40)).astype(np.float32)
    vectors[50:60] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [0.0] * 40), (1100, [float("nan")] * 40), (1200, [None] * 40), (None, [1.0] * 40), (1300, [1.0] * 3)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "id % 100 = 0", 10).collect()
    wide = vectors.astype(float)
    for q in range(0, 700, 100):
        distance = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(700), distance)).tolist() if i != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == want
        assert [m[2] for m in mine] == pytest.approx(distance[want].tolist(), abs=1e-9)
    assert not [r for r in got if r.query_id >= 1000]


def test_bpe_equals_the_library(documents, odd_texts):
    library = Tokenizer.from_file(queries.BPE_FILE)
    texts = odd_texts + ["".join(chr(c) for c in range(a, a + 60)) for a in range(32, 12000, 61)] + ["a" * 3000, "'s''ll I'VE\r\n  x", " 　y"]
    rows = {r.doc_id: r for r in bpe.round_trip(documents(texts), queries.BPE_FILE).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids
        assert rows[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_preferences(spark):
    rows = [
        (1, "chosen", 0, "user", "hi", 1), (1, "chosen", 1, "assistant", "good", 1), (1, "rejected", 0, "user", "hi", 1),
        (1, "rejected", 1, "assistant", "bad", 1), (1, "rejected", 1, "assistant", "bad", 1), (2, "chosen", 0, "user", None, 1),
        (2, "chosen", 70, None, "late", 1), (None, "chosen", 0, "user", "x", 1), (3, None, 0, "user", "x", 1),
        (4, "chosen", 0, "user", "same", 1), (4, "rejected", 0, "user", "same", 1),
    ]
    got = preferences.format_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, part int"))
    found = {(r.pair_id, r.part, r.chunk): r for r in got.collect()}
    assert found.keys() == {(1, "prompt", 0), (1, "chosen", 0), (1, "rejected", 0), (2, "chosen", 0), (2, "chosen", 1), (4, "prompt", 0)}
    chosen = found[1, "chosen", 0]
    begin, end = map(int, chosen.loss_spans.split("-"))
    assert chosen.text == "<|assistant|>\ngood<|end|>\n" and chosen.text[begin:end] == "good<|end|>"
    assert found[1, "prompt", 0].loss_spans == "" and found[1, "rejected", 0].n_turns == 1


def test_rollups_are_idempotent(spark, documents, labels_of, tmp_path):
    docs = documents(["a b", "c, d", None, "e f g", "e f g", ""])
    labels = labels_of([(0, 1, 1), (1, 0, 0), (1, 1, 0), (9, 0, 1)])
    got = token_rollup.maintain(docs, labels, str(tmp_path / "rollup")).collect()
    totals = {r.tokenizer: (r.documents, r.tokens) for r in got if r.source == "s1"}
    assert totals == {"v2": (1, 3), "v1": (1, 3)}
    assert {r.source for r in got} == {None, "s0", "s1", "s2"} - ({None} if not any(r.source is None for r in got) else set())
    counts = token_rollup.counted(docs, {"v1": token_rollup.white_space_tokens(docs["text"])})
    for _ in range(2):
        token_rollup.commit(str(tmp_path / "again"), "b1", token_rollup.changes(counts, 1, "v1"))
    assert sum(r.documents for r in token_rollup.totals(spark, str(tmp_path / "again")).collect()) == 6


def test_empty_tables(spark, documents, labels_of):
    none, no_labels = documents(["x"]).limit(0), labels_of([(1, 1, 0)]).limit(0)
    for result in (
        mixing.mix(none), fingerprints.fingerprint_edits(none), jaccard.near_duplicates(none), ngram_lm.score_texts(none),
        ranking.score_documents(none, no_labels), bpe.round_trip(none, queries.BPE_FILE), licenses.scan_licenses(queries.document_paths(none)),
    ):
        assert result.count() == 0
