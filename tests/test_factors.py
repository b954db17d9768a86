import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import factors as Fa
from quantloom.operators import labels as L
from quantloom.operators import metrics as M
from quantloom.schemas import FEATURES, PREDICTION, TARGET, TRADITIONAL_FACTORS

PANEL = "date date, ticker string, close double, volume bigint, gics_sector string"


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(7)
    days = pd.date_range("2020-01-01", periods=90, freq="D").date
    rows = []
    for name, sector in (("a", "X"), ("b", "X"), ("c", None), ("SPY", None)):
        close = 20 * np.cumprod(1 + rng.normal(0.001, 0.02, len(days)))
        rows += [(d, name, float(c), int(rng.integers(0, 50)), sector) for d, c in zip(days, close)]
    return rows


@pytest.fixture(scope="module")
def no_benchmark(spark):
    return spark.createDataFrame([], "date date, spy_close double")


def test_traditional_factors_equal_pandas(spark, panel, no_benchmark):
    mine = Fa.add_traditional_factors(spark.createDataFrame(panel, PANEL), no_benchmark).toPandas()
    data = pd.DataFrame(panel, columns=["date", "ticker", "close", "volume", "sector"]).sort_values(["ticker", "date"])
    market = data[data.ticker == "SPY"].set_index("date").close
    for name, g in data.groupby("ticker"):
        g = g.set_index("date")
        r, m = g.close.pct_change(), market.pct_change()
        delta = g.close.diff()
        gain, loss = delta.clip(lower=0).rolling(14).mean(), (-delta.clip(upper=0)).rolling(14).mean()
        expected = {
            "momentum_20d": g.close.pct_change(20), "volatility_20d": r.rolling(20).std() * np.sqrt(252),
            "volume_change_5d": g.volume.rolling(5).mean() / g.volume.shift(5).rolling(5).mean() - 1,
            "rsi_14": 100 - 100 / (1 + gain / loss), "beta": r.rolling(60).cov(m) / m.rolling(60).var(),
            "market_return_5d": market.pct_change(5),
        }
        got = mine[mine.ticker == name].set_index("date").sort_index()
        for factor, values in expected.items():
            assert np.allclose(got[factor].astype(float), values, equal_nan=True), (name, factor)
    assert mine[mine.ticker == "c"].sector_return_5d.isna().all()


def test_features_do_not_see_the_future(spark, panel, no_benchmark):
    cut = dt.date(2020, 3, 15)
    full = Fa.add_traditional_factors(spark.createDataFrame(panel, PANEL), no_benchmark).where(F.col("date") <= cut)
    part = Fa.add_traditional_factors(spark.createDataFrame([r for r in panel if r[0] <= cut], PANEL), no_benchmark)
    columns = ["date", "ticker", *[F.round(c, 10).alias(c) for c in TRADITIONAL_FACTORS]]
    assert full.select(columns).exceptAll(part.select(columns)).isEmpty() and full.count() == part.count()


def test_rsi_is_null_without_losses(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), "a", float(i), None if i == 0 else 1.0) for i in range(20)]
    got = spark.createDataFrame(rows, "date date, ticker string, close double, close_change double").select(Fa.rsi().alias("v"))
    assert got.where("v IS NOT NULL").isEmpty()


@pytest.mark.parametrize("max_rows", [10**6, 3])
def test_zscore_edges(spark, max_rows):
    rows = [(1, "a", 5.0), (1, "b", None), (2, "a", 0.3), (2, "b", 0.3), (2, "c", None)]
    spread = [1.0, 2.0, 3.0, 4.0, 100.0]
    rows += [(3, f"t{i}", v) for i, v in enumerate(spread)] + [(3, "u", None)]
    frame = spark.createDataFrame(rows, "date int, ticker string, v double")
    got = {(r["date"], r["ticker"]): r["z_v"] for r in Fa.winsorized_zscore(frame, ["v"], max_rows=max_rows).collect()}
    assert got[1, "a"] == got[1, "b"] == got[2, "a"] == got[2, "b"] == got[2, "c"] == 0.0
    values = pd.Series(spread)
    clipped = values.clip(values.quantile(0.01), values.quantile(0.99))
    expected = (clipped - clipped.mean()) / clipped.std(ddof=0)
    assert np.allclose([got[3, f"t{i}"] for i in range(5)], expected) and got[3, "u"] is None


def dated(spark, n):
    return spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i),) for i in range(n)], "date date")


@pytest.mark.parametrize("n,sizes", [
    (1, {"train": 1}), (29, {"train": 17, "validation": 6, "test": 6}),
    (30, {"train": 4, "validation": 4, "test": 4, "final_holdout": 3}),
    (100, {"train": 45, "validation": 15, "test": 15, "final_holdout": 10}),
])
def test_split_sizes(spark, n, sizes):
    found = {r["split"]: r["count"] for r in L.split_calendar(dated(spark, n)).groupBy("split").count().collect()}
    assert found == sizes


def test_splits_are_disjoint_with_embargo(spark):
    days = {}
    for r in L.split_calendar(dated(spark, 100)).collect():
        days.setdefault(r["split"], []).append(r["date"])
    order = ["train", "validation", "test", "final_holdout"]
    for left, right in zip(order, order[1:]):
        assert (min(days[right]) - max(days[left])).days == 6


def test_walk_forward_folds_predict_after_training(spark):
    folds = L.walk_forward_folds(dated(spark, 300), embargo=5).orderBy("fold").collect()
    assert [f["predict_dates"] for f in folds] == [21, 21, 6]
    assert all((f["predict_start"] - f["train_end"]).days == 6 for f in folds)


def test_metrics_gates(spark):
    rows = [(dt.date(2020, 1, d), f"t{i}", float(p), float(a)) for d, pairs in {
        1: [(1, 1), (2, 2)], 2: [(1, 1), (1, 2), (1, 3)], 3: [(1, 1), (2, 3), (2, 2), (5, 9)]}.items() for i, (p, a) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, f"date date, ticker string, {PREDICTION} double, {TARGET} double")
    got = {r["date"].day: r for r in M.evaluate(frame, by=["date"]).collect()}
    assert got[1]["ic"] is None and got[2]["rank_ic"] is None
    p, a = pd.Series([1, 2, 2, 5]), pd.Series([1, 3, 2, 9])
    assert got[3]["ic"] == pytest.approx(p.corr(a)) and got[3]["rank_ic"] == pytest.approx(p.rank().corr(a.rank()))


def test_prepare_features_fills_by_date_then_zero(spark):
    names = ", ".join(f"{c} double" for c in FEATURES)
    full = [1.0] * len(FEATURES)
    rows = [(1, "a", *full), (1, "b", None, *full[1:]), (1, "c", *[None] * 4, *full[4:]), (2, "d", None, *full[1:])]
    got = {r["ticker"]: r[FEATURES[0]] for r in L.prepare_features(spark.createDataFrame(rows, f"date int, ticker string, {names}")).collect()}
    assert got == {"a": 1.0, "b": 1.0, "d": 0.0}
