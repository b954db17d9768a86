"""Keys and checks exchanged in rounds: the same components, and tables that nothing reads any more are removed."""

import random

from quantloom import session
from quantloom.llm import jaccard as J


def texts(n=60, seed=4):
    """Near copies of four long texts, and texts of their own."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[draw.choice(words) for _ in range(120)] for _ in range(4)]
    for i in range(n):
        own = list(bases[i % 4]) if i % 3 else [draw.choice(words) for _ in range(80)]
        own[draw.randrange(len(own))] = draw.choice(words)
        yield i // 2 if i % 5 else None, " ".join(own)


def test_rounds_find_the_same_components_and_leave_no_sets(spark, monkeypatch):
    docs = spark.createDataFrame([*texts(), (7, None), (8, "")], "doc_id long, text string")
    found = lambda: sorted(map(str, J.near_duplicates(docs, percent=80).collect()))
    once = found()
    written, materialize = [], J.materialize

    def noted(df, name="t"):
        table = materialize(df, name)
        written.append((name, session._written[table]))
        return table

    monkeypatch.setattr(J, "materialize", noted)
    monkeypatch.setattr(J, "MANY_SHINGLES", 0)
    monkeypatch.setattr(J, "MANY_MEMBERS", 0)
    assert found() == once
    names = [name for name, _ in written]
    assert names.count("members") == J.KEY_ROUNDS + 1 and names.count("sets") >= J.CHECK_ROUNDS
    assert not [path for name, path in written if name in ("sets", "wanted", "near") and session.path_exists(spark, path)]
