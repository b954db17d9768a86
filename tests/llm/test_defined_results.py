"""Defined results for clashing names, repeated and NULL turns, replays and empty tables."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import mixing, neighbours, preferences, ranking, token_rollup

TURNS = "conv_id long, turn long, role string, text string"


def test_mixing_keeps_columns_of_any_name(documents):
    docs = documents([f"text {i}" for i in range(40)])
    names = ("steps", "mix_parts", "mix_copies", "mix_source", "mix_row", "copy_no", "SHUFFLE_KEY")
    clashing = docs.withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in names})
    plain = sorted((r.doc_id, r.copy_no, r.shuffle_key) for r in mixing.mix(docs).collect())
    found = mixing.mix(clashing).collect()
    assert sorted((r.doc_id, r.copy_no, r.shuffle_key) for r in found) == plain and len(found) > 0
    assert all(r[name] == f"{name}{r.doc_id}" for r in found for name in names[:5])
    staged = corpus_pipeline.mixed(docs.sparkSession, clashing, "")
    assert staged.columns == clashing.columns
    assert all(r[name] == f"{name}{r.doc_id}" for r in staged.collect() for name in names)


def brute_pairs(rows):
    """Rendered (part -> text) by conversation, with the last assistant turn exchanged between 2k and 2k + 1."""
    given = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            given.setdefault(conv, set()).add((-1 if turn is None else turn, role or "", text or ""))
    last = {c: max(((t, x) for t, r, x in s if r == "assistant"), default=None) for c, s in given.items()}
    show = lambda turns: "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in sorted(turns))
    out = {}
    for conv, chosen in given.items():
        rejected, other = set(chosen), last.get(conv ^ 1)
        if last[conv]:
            mine = (last[conv][0], "assistant", last[conv][1])
            rejected = (rejected - {mine}) | ({(mine[0], "assistant", other[1])} if other else set())
        parting = min((t for t, _, _ in chosen ^ rejected), default=10**9)
        for part, turns in (("prompt", {t for t in chosen if t[0] < parting}), ("chosen", chosen), ("rejected", rejected)):
            turns = turns if part == "prompt" else {t for t in turns if t[0] >= parting}
            if turns:
                out[conv, part] = show(turns)
    return out


def test_exchanged_endings(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 1, "assistant", "b"), (0, 1, "assistant", "b"), (0, 2, "user", "bye"),
        (1, 0, "user", "yo"), (1, 3, "assistant", "other"), (2, None, "assistant", "alone"), (2, None, None, None),
        (4, 0, "user", "no answer"), (5, 0, "assistant", None), (6, 0, "assistant", "same"), (7, 0, "assistant", "same"), (None, 0, "user", "x"),
    ]
    frame = spark.createDataFrame(rows, TURNS).withColumn("ending", F.lit(1)).withColumn("side", F.lit("chosen"))
    found = preferences.format_pairs(preferences.exchanged_endings(frame)).collect()
    assert {(r.pair_id, r.part): r.text for r in found} == brute_pairs(rows)
    prompts = {r.pair_id: r.text for r in found if r.part == "prompt"}
    assert prompts[0] == "<|user|>\nhi<|end|>\n" and 6 in prompts and 7 in prompts
    assert all((r.loss_spans == "") == (r.part == "prompt" or "<|assistant|>" not in r.text) for r in found)


def test_many_turns_of_one_number_are_pieces(spark):
    rows = [(0, None, "user", f"{i:04d}") for i in range(150)] + [(0, 7, "assistant", f"{i:04d}") for i in range(20)]
    found = preferences.format_pairs(preferences.exchanged_endings(spark.createDataFrame(rows, TURNS)), chunk=16).collect()
    assert max(r.n_turns for r in found) == 16
    parts = {}
    for r in sorted(found, key=lambda r: (r.part, r.chunk, r.piece)):
        parts[0, r.part] = parts.get((0, r.part), "") + r.text
    assert parts == brute_pairs(rows)


def test_rollup_batches_count_once_and_compact(spark, documents, tmp_path):
    docs, path = documents(["a b", "c", None]), str(tmp_path / "t")
    counts = token_rollup.counted(docs, {"v1": token_rollup.white_space_tokens(docs["text"])})
    insert, delete = token_rollup.changes(counts, 1, "v1"), token_rollup.changes(counts.where("doc_id = 1"), -1, "v1")
    assert token_rollup.commit(path, "b1", insert) and token_rollup.commit(path, "b2", delete)
    broken = insert.withColumn("tokens", F.raise_error(F.lit("lost")).cast("long"))
    try:
        token_rollup.commit(path, "b3", broken)
    except Exception as error:  # noqa: BLE001
        assert "lost" in str(error)
    else:
        raise AssertionError("the broken batch was committed")
    before = sorted(map(tuple, token_rollup.totals(spark, path).collect()), key=str)
    assert not token_rollup.commit(path, "b1", insert)
    token_rollup.compact(spark, path)
    assert not token_rollup.commit(path, "b2", delete)
    assert sorted(map(tuple, token_rollup.totals(spark, path).collect()), key=str) == before
    assert sum(r[3] for r in before) == 2 and token_rollup.commit(path, "b3", delete)


def test_first_rows_by_hash(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(x)]) for i, x in zip(draw.integers(0, 700, 3000), draw.normal(size=3000))] + [(5, [0.5])] * 900
    frame = spark.createDataFrame(rows, "doc_id long, features array<double>").repartition(7)
    for sample in (1, 250, 2000, 10_000):
        expected = frame.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample).collect()
        assert ranking.first_by_hash(frame, sample).collect() == expected
    assert ranking.first_by_hash(frame.limit(0), 10).count() == 0


def test_empty_tables(spark, documents, labels_of, tmp_path):
    turns = spark.createDataFrame([], TURNS)
    assert preferences.format_pairs(preferences.exchanged_endings(turns)).count() == 0
    none, no_labels = documents(["x"]).limit(0), labels_of([(1, 1, 0)]).limit(0)
    assert token_rollup.maintain(none, no_labels, str(tmp_path / "none")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(vectors, "id % 100 = 0", k=10).count() == 0
    assert corpus_pipeline.mixed(spark, none, "").count() == 0 and corpus_pipeline.near_copies(spark, none, "").count() == 0
