"""What near copies and neighbours send between tasks grows with their rows."""

import random

import numpy as np
import pyarrow as pa

from quantloom.llm import jaccard, neighbours


def near_copies_of(n, words=400, edits=8):
    draw = random.Random(5)
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for place in draw.sample(range(words), edits):
            own[place] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_copies_go_to_one_group_first(spark, documents, monkeypatch):
    checked, write = [], jaccard.materialize

    def spy(df, name="t"):
        done = write(df, name)
        if name == "near":
            checked.append(done.count())
        return done

    monkeypatch.setattr(jaccard, "materialize", spy)
    others = [" ".join(f"o{i}_{j}" for j in range(50)) for i in range(20)]
    rows = jaccard.near_duplicates(documents(near_copies_of(80) + others), 3, 80).collect()
    assert {r.component_id for r in rows if r.doc_id < 80} == {0}
    assert all(r.component_id == r.doc_id for r in rows if r.doc_id >= 80)
    assert sum(checked) <= 3 * 80  # a row for each segment of each copy before


def test_only_members_with_a_partner_of_another_root_are_checked():
    histogram = np.ones(jaccard.BUCKETS, np.uint8).tobytes()
    roots = {1: 1, 2: 1, 3: 1, 4: -4, 11: 11, 12: 11}  # 4 may join 1, 2 and 3; 11 and 12 hang together
    rows = [(9 if node > 10 else 8, 0, 0, node, histogram + int(128).to_bytes(8) + root.to_bytes(8, signed=True)) for node, root in sorted(roots.items())]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["hub", "a", "b", "node", "sketch"])
    kept = [tuple(r.values()) for found in jaccard.prune_groups(80)(iter([batch])) for r in found.to_pylist()]
    assert sorted(kept) == [(8, 0, 0, 1), (8, 0, 0, 2), (8, 0, 0, 3), (8, 0, 0, 4)]


def test_tiles_are_never_broadcast(spark, monkeypatch):
    draw = np.random.Generator(np.random.PCG64(3))
    vectors = draw.normal(size=(500, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 60)
    found = neighbours.nearest(frame, "id % 10 = 0", 5)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows, wide = found.collect(), vectors.astype(float)
    for q in range(0, 500, 10):
        distance = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(500), distance)).tolist() if i != q][:5]
        assert [r.vec_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)] == want
