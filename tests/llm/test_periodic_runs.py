"""Run detection against a table of all diagonals, on made and random texts."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quantloom.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def runs_by_force(words):
    """Every lag's maximal stretches, then those whose period no shorter lag explains."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        at = q
        while at < n:
            if words[at] != words[at - q]:
                at += 1
                continue
            begin = at
            while at < n and words[at] == words[at - q]:
                at += 1
            start, length = begin - q, at - begin + q
            if length >= max(24, 3 * q):
                found.setdefault((start, length), q)
    return sorted((s, m, q) for (s, m), q in found.items())


def expected(doc_id, text, plant=True):
    words = words_of(doc_id, text, plant)
    runs = runs_by_force(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(words), len(runs), *best, None if not runs else 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept),
    )


def test_runs_of_equals_all_diagonals():
    """Sequences over few words, where runs overlap, nest and have periods with common divisors."""
    draw = np.random.Generator(np.random.PCG64(2))
    for _ in range(300):
        kinds = int(draw.integers(1, 5))
        parts = []
        for _ in range(int(draw.integers(1, 5))):
            period = draw.integers(0, kinds, int(draw.integers(1, 40)))
            parts.append(np.tile(period, int(draw.integers(1, 9))))
            parts.append(draw.integers(0, kinds, int(draw.integers(0, 6))))
        sequence = np.concatenate(parts)
        starts, lengths, periods = periodic_runs.runs_of(sequence.astype(np.uint64), np.zeros(len(sequence), np.int64))
        assert list(zip(starts.tolist(), lengths.tolist(), periods.tolist(), strict=True)) == runs_by_force(sequence.tolist())


def test_long_periods_with_repeats_inside():
    """A period in which every block of 16 words and each pair of neighbouring blocks occurs twice."""
    draw = np.random.Generator(np.random.PCG64(6))
    p, q, r = (draw.integers(0, 10**6, 40) for _ in range(3))
    unit = np.concatenate([p, q, p, p, r, r, p, q, q, r])
    sequence = np.concatenate([[7], np.tile(unit, 4), unit[:17], [8]])
    starts, lengths, periods = periodic_runs.runs_of(sequence.astype(np.uint64), np.zeros(len(sequence), np.int64))
    assert list(zip(starts.tolist(), lengths.tolist(), periods.tolist(), strict=True)) == runs_by_force(sequence.tolist())


@pytest.mark.parametrize("plant", [True, False])
def test_periodic_runs(documents, odd_texts, plant):
    draw = np.random.Generator(np.random.PCG64(12))
    texts = [*odd_texts[:10], *odd_texts[11:], "ab " * 900, "A a " * 20, "x y\tz\n" * 8, "x y z " * 7 + "x y", "ü ü\x0bü " * 12]
    for n in draw.integers(1, 400, 120):
        texts.append(" ".join(f"w{x}" for x in draw.integers(0, draw.integers(2, 300), n)))
    texts += ["a b c d " * 10 + f"e{i} " * 30 + "a b c d " * 10 for i in range(60)]
    got = periodic_runs.periodic_runs(documents(texts), plant=plant).collect()
    columns = ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = [expected(i, t, plant) for i, t in enumerate(texts)]
    assert sorted(tuple(r[c] for c in columns) for r in got) == want
    assert sum(w[2] > 0 for w in want) > 60


def test_rows_without_id_and_repeated_rows(spark, documents):
    text = "one two " * 20
    docs = documents([text, text, text, None], [None, 5, 5, None])
    clash = docs.withColumnRenamed("hub", "n_runs").withColumnRenamed("key", "start")
    got = sorted(((r.doc_id or -1, r.n_runs, r.period) for r in periodic_runs.periodic_runs(clash).collect()), key=str)
    assert got == [(-1, 0, None), (-1, 1, 2), (5, 1, 2), (5, 1, 2)]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_a_very_long_text_of_one_word(documents):
    [row] = periodic_runs.periodic_runs(documents(["go " * 1_500_000])).collect()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 1_500_000, 1)
    assert row.collapsed_sha256 == hashlib.sha256(b"go").hexdigest()
