"""Tables with a log: jobs lost half-way, writers at the same time, earlier versions, batches and compaction."""

import pytest
from pyspark.sql import functions as F

from quantloom.sinks import snapshots as S
from quantloom.sinks import tables as K

SCHEMA = "d string, k string, v double"


def rows(spark, path, **options):
    return sorted(((r.d, r.k, r.v) for r in S.read_table(spark, path, **options).collect()), key=str)


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "t")
    K.upsert_table(spark, where, spark.createDataFrame([("d1", "a", 1.0), ("d1", "b", 2.0), ("d2", "c", 3.0), (None, "n", 0.0)], SCHEMA), ["k"], "d")
    return where


BASE = [("d1", "a", 1.0), ("d1", "b", 2.0), ("d2", "c", 3.0), (None, "n", 0.0)]


def test_a_job_lost_before_its_commit_changes_nothing(spark, path, monkeypatch):
    """Lost after files are written, before the entry; and lost while files are being written."""
    moved = spark.createDataFrame([("d3", "c", 9.0)], SCHEMA)

    def lost(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(S, "publish", lost)
    for write in (
        lambda: K.upsert_table(spark, path, moved, ["k"], "d"), lambda: K.replace_table(moved, path),
        lambda: S.overwrite_folder(moved.limit(0), path, "d", "d=d2"),
    ):
        with pytest.raises(RuntimeError, match="lost"):
            write()
        assert rows(spark, path) == sorted(BASE, key=str)
    monkeypatch.undo()
    broken = moved.withColumn("v", F.raise_error(F.lit("disk full")).cast("double"))
    with pytest.raises(Exception, match="disk full"):
        K.upsert_table(spark, path, broken, ["k"], "d")
    assert rows(spark, path) == sorted(BASE, key=str)
    K.upsert_table(spark, path, moved, ["k"], "d")  # the partition d2 has no row left
    assert rows(spark, path) == sorted([*BASE[:2], BASE[3], ("d3", "c", 9.0)], key=str)
    assert rows(spark, path, version=0) == sorted(BASE, key=str)


def test_of_two_writers_the_later_starts_again(spark, path, monkeypatch):
    publish, other = S.publish, []

    def slow(session, entry):
        if not other:  # another writer commits while this one has read but not committed
            other.append(1)
            K.upsert_table(spark, path, spark.createDataFrame([("d1", "a", 7.0), ("d4", "x", 8.0)], SCHEMA), ["k"], "d")
        return publish(session, entry)

    monkeypatch.setattr(S, "publish", slow)
    K.upsert_table(spark, path, spark.createDataFrame([("d1", "b", 5.0)], SCHEMA), ["k"], "d")
    assert rows(spark, path) == sorted([("d1", "a", 7.0), ("d1", "b", 5.0), *BASE[2:], ("d4", "x", 8.0)], key=str)
    taken = S.newest(spark, path)
    with pytest.raises(S.LostRace):
        publish(spark, taken)


def test_names_with_odd_characters_and_new_columns(spark, path):
    K.upsert_table(spark, path, spark.createDataFrame([("a b%/:=ü", "a", 4.0, 1)], SCHEMA + ", more int"), ["k"], "d")
    K.upsert_table(spark, path, spark.createDataFrame([("d1", "a", 6.0)], SCHEMA), ["k"], "d")
    found = {r.k: (r.d, r.v, r.more) for r in S.read_table(spark, path).collect()}
    assert found == {"a": ("d1", 6.0, None), "b": ("d1", 2.0, None), "c": ("d2", 3.0, None), "n": (None, 0.0, None)}


def test_batches_count_once_and_are_compacted(spark, tmp_path):
    path = str(tmp_path / "sums")
    one, two = (spark.createDataFrame([("x", n), ("y", 1)], "k string, n int") for n in (1, 10))
    assert S.append_batch(one, path, "b1") and S.append_batch(two, path, "b2")
    assert not S.append_batch(two, path, "b1")
    total = lambda df: df.groupBy("k").agg(F.sum("n").cast("int").alias("n"))
    S.compact(spark, path, total)
    assert sorted(tuple(r) for r in S.read_table(spark, path).collect()) == [("x", 11), ("y", 2)]
    assert not S.append_batch(one, path, "b2") and S.append_batch(one, path, "b3")
    assert sorted(tuple(r) for r in total(S.read_table(spark, path)).collect()) == [("x", 12), ("y", 3)]
    assert S.remove_unused(spark, path, keep=2) == []  # too young
    assert len(S.remove_unused(spark, path, keep=2, older_than_hours=0)) == 2
    assert sorted(tuple(r) for r in total(S.read_table(spark, path)).collect()) == [("x", 12), ("y", 3)]
    with pytest.raises(FileNotFoundError):
        S.read_table(spark, path, version=0)


def test_empty_tables(spark, tmp_path):
    path, none = str(tmp_path / "e"), spark.createDataFrame([], SCHEMA)
    K.upsert_table(spark, path, none, ["k"], "d")
    K.upsert_table(spark, path, none, ["k"], "d")
    assert S.read_table(spark, path).columns == ["d", "k", "v"] and rows(spark, path) == []
    K.replace_table(none, str(tmp_path / "f"))
    assert S.read_table(spark, str(tmp_path / "f")).count() == 0
    with pytest.raises(FileNotFoundError):
        S.read_table(spark, str(tmp_path / "nowhere"))
