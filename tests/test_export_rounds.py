"""An export in rounds writes the same rows, also those without a date, and leaves no shuffle files behind."""

import datetime as dt

from quantloom import session
from quantloom.sinks import tables as K


def test_export_in_rounds_equals_one_write(spark, tmp_path, monkeypatch):
    rows = [(None if i % 9 == 0 else dt.date(2020, 1, 1) + dt.timedelta(days=i % 7), f"n{i}", "x" * 50) for i in range(90)] * 2
    news = spark.createDataFrame(rows, "effective_date date, news_id string, body string")
    released = []
    inside = K.released_shuffles
    monkeypatch.setattr(K, "released_shuffles", lambda s: released.append(1) or inside(s))
    K.export_partitioned(news, str(tmp_path / "one"), "effective_date")
    assert K.EXPORT_ROUNDS["raw_news"] > 1 and len(released) == 1
    for _ in range(2):  # again over the first export, which is replaced
        K.export_tables({"raw_news": news}, str(tmp_path))
    assert len(released) == 1 + 2 * K.EXPORT_ROUNDS["raw_news"]
    found = [sorted(map(str, spark.read.parquet(str(tmp_path / x)).select(*news.columns).collect())) for x in ("one", "raw_news")]
    assert found[0] == found[1] == sorted(map(str, news.collect()))
    assert spark.conf.get(session.RELEASE_KEY, None) != "true"
