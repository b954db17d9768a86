"""Cases in which an operator once did less than its whole job."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quantloom.llm import jaccard, mixing, ngram_lm, ranking

from .test_operators import FOLD, WORD, components_by_force
from .test_operators import near_copies as near_texts


def test_mixing_repeats_a_tiny_source_at_any_rate(spark, documents):
    """A row without source and text beside millions of characters; and a source whose rate is split into parts."""
    large = documents(["x" * 100_000] * 60, [i * 15 + 3 for i in range(60)]).withColumn("source", mixing.F.lit("large"))
    tiny = documents([None], [10**6]).withColumn("source", mixing.F.lit(None).cast("string"))
    found = Counter(r.source for r in mixing.mix(large.union(tiny)).select("source").collect())
    rate = 6000061 / (6000060**0.5 + 1)
    assert abs(found[None] - rate) < 6 * rate**0.5
    docs = documents(["y"] * 60 + ["z" * 45_000] * 4)
    weighed = docs.withColumn("source", mixing.F.when(docs["doc_id"] < 60, "small").otherwise("big"))
    weights = spark.createDataFrame([("small", 1.0)], "source string, weight double")
    counts = [r["count"] for r in mixing.mix(weighed, weights).groupBy("doc_id").count().collect()]
    rate = (120 + 4 * 45_001) / 120
    mean = sum(counts) / 60
    assert len(counts) == 60 and rate > 2 * mixing.PART_RATE and abs(mean - rate) < 6 * (rate / 60) ** 0.5
    assert 0.4 < sum((x - mean) ** 2 for x in counts) / 60 / rate < 1.8


@pytest.mark.parametrize("cached", [0, 30, 10**6])
def test_language_model_uses_pairs_of_rare_words(documents, odd_texts, monkeypatch, cached):
    """Scores equal those from dense tables of all pairs, however many words are sent to the tasks."""
    monkeypatch.setattr(ngram_lm, "CACHED", cached)
    draw = np.random.Generator(np.random.PCG64(21))
    texts = odd_texts + [" ".join(f"r{x} t{x}" for x in draw.zipf(1.3, 30) % 5000) for _ in range(400)]
    rows = {r.doc_id: r for r in ngram_lm.score_texts(documents(texts)).collect()}
    tokens = [["", *WORD.findall((t or "").translate(FOLD)), ""] for t in texts]
    crc = [zlib.crc32(str(i).encode()) for i in range(len(texts))]
    training = [c % 5 != 1 for c in crc]
    known = sorted({w for t, use in zip(tokens, training, strict=True) if use for w in t})
    place = {w: i for i, w in enumerate(known)}
    kept, held = np.zeros((2, len(known) + 1, len(known) + 1), dtype=np.int64)
    for i, t in enumerate(tokens):
        for s, w in zip(t[:-1], t[1:], strict=True):
            if training[i]:
                (held if crc[i] // 5 % ngram_lm.FOLDS == 0 else kept)[place[s], place[w]] += 1
    scores = ngram_lm.class_scores(kept, held)
    at = lambda w: place.get(w, len(known))
    for i, t in enumerate(tokens):
        want = sum(scores[at(s), at(w)] for s, w in zip(t[:-1], t[1:], strict=True))
        assert rows[i].score == pytest.approx(want, rel=2e-3)


@pytest.mark.parametrize("bracket", [3, 4096])
def test_quality_threshold_is_that_of_all_labelled_rows(documents, labels_of, monkeypatch, bracket):
    """With more rows of a label than the sample holds, the true share of label 0 lies below the threshold."""
    monkeypatch.setattr(ranking, "BRACKET", bracket)
    draw = np.random.Generator(np.random.PCG64(4))
    texts = [" ".join(("SPAM!!" if draw.random() < p else f"word{draw.integers(0, 50)}") for _ in range(30)) for p in [0.2] * 400 + [0.35] * 60]
    measured = ranking.measure(documents(texts))
    labels = labels_of([(i, int(i < 400), 0) for i in range(460)])
    model = ranking.learn(measured, labels, sample=25)
    training = [i for i in range(460) if zlib.crc32(str(i).encode()) % 4 != 2]
    features = {r.doc_id: r.features for r in measured.collect()}
    utilities = np.sort(model.utilities(np.array([features[i] for i in training])))
    bad = sum(i >= 400 for i in training)
    assert model.threshold == pytest.approx((utilities[bad - 1] + utilities[bad]) / 2, abs=1e-9)
    repeated = documents([str(i) for i in range(12)]).selectExpr("cast(doc_id as double) as u", "case when doc_id = 7 then 50L else 1L end as n")
    assert [ranking.between(repeated, at) for at in (1, 7, 8, 57, 60)] == [0.5, 6.5, 7, 7.5, 10.5]


def test_near_copies_without_id_are_found_and_dropped(spark, documents):
    """A near copy without id belongs to document 7, links documents that are near through it only, and isn't kept."""
    words = [f"w{i}" for i in range(60)]
    middle = " ".join(words)
    left, right = " ".join(["a0", *words[1:]]), " ".join([*words[:-1], "b0"])
    one_off = [f"n{i}" for i in range(200)]
    texts = [left, right, middle, middle, " ".join(one_off), " ".join([*one_off[:-1], "e"]), "alone and without any id", " ".join(one_off), "", None]
    docs = documents(texts, [7, 9, None, None, 20, None, None, None, None, 30])
    assert not [r for r in jaccard.near_duplicates(documents([left, right], [7, 9]), 3, 95).collect() if r.doc_id != r.component_id]
    found = jaccard.near_duplicates(docs, 3, 95).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter(
        {(7, 7): 1, (9, 7): 1, (None, 7): 2, (20, 20): 1, (None, 20): 2, (None, None): 2, (30, 30): 1}
    )
    kept = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, "alone and without any id"), (7, left), (20, texts[4]), (30, "")]


def test_unlike_texts_under_one_id(spark, documents):
    """Classes are found by their own text, not by their id: two near pairs that cross in one id stay two components."""
    w, v, q = (" ".join(f"{c}{i}" for i in range(120)) for c in "wvq")
    near = lambda text: text + " end"
    found = jaccard.near_duplicates(documents([w, near(w), near(v), v], [3, 7, 7, 20])).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (7, 3), (7, 7), (20, 7)]
    docs = documents([w, near(w), q], [3, 7, 7])
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [(3, w), (7, q)]
    clash = docs.withColumnsRenamed({"hub": "row", "lang": "key", "key": "group"})
    kept = corpus_pipeline.near_copies(spark, clash, "")
    assert kept.columns == clash.columns and kept.count() == 2


def test_a_frequent_id_with_many_texts(spark, documents):
    """A third of the rows under one id: each text is fetched once, whatever the number of texts of its id."""
    draw = np.random.Generator(np.random.PCG64(8))
    texts = [" ".join(f"{i}x{x}" for x in draw.integers(0, 10**6, 40)) for i in range(60)]
    near = [t + " end" for t in texts]
    found = jaccard.near_duplicates(documents(texts + near + texts, [5] * 60 + list(range(100, 160)) + [5] * 60)).collect()
    assert Counter(r.component_id for r in found) == {5: 180}


def test_stages_on_empty_tables(spark, documents, labels_of, tmp_path):
    none = documents(["x"]).limit(0)
    labels_of([(1, 1, 0)]).limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_groups_of_many_chunks(documents, monkeypatch, size, percent):
    """Chunks of three classes, so that chains, groups that hang together and groups that don't all take every way."""
    monkeypatch.setattr(jaccard, "CHUNK_CLASSES", 3)
    texts = near_texts(1, 40, 120, 6) + near_texts(2, 40, 30, 4)
    words = [f"c{i}" for i in range(400)]
    texts += [" ".join(words[k * 2 : k * 2 + 90]) for k in range(30)]
    got = jaccard.near_duplicates(documents(texts), size, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_force(texts, size, percent)
