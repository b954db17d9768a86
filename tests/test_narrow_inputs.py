"""Wide rows are written once, as factors: scores, labels and filled features are computed by whoever reads them."""

import datetime as dt

from checks import catalog
from quantloom.operators import factors as Fa
from quantloom.plans import projection as D
from quantloom.schemas import TRADITIONAL_FACTORS

SF_DIR = "/root/testdata/sf0.001"
BARS = "date date, ticker string, open double, high double, low double, close double, volume long, suspicious_return boolean, gics_sector string"


def panel(spark):
    """70 bars of three tickers, one without a sector, and of the market."""
    rows = [
        (dt.date(2020, 1, 1) + dt.timedelta(days=i), t, 1.0, 2.0, 0.5, 10.0 + (i * (k + 3)) % 7, 100 + i % (k + 2), False, None if t == "C" else "S")
        for i in range(70) for k, t in enumerate(("A", "B", "C", "SPY"))
    ]
    return spark.createDataFrame(rows, BARS)


def test_predictions_need_no_written_wide_tables(spark):
    D._stored.clear()
    D._derived.clear()
    assert catalog.predictions(spark, SF_DIR).count() == catalog.features(spark, SF_DIR).where("momentum_5d is not null and ticker <> 'SPY'").count()
    names = {name for _, _, name in D._stored}
    assert "predictions" in names and not names & {"factor_table", "dataset", "features"}


def test_factor_table_writes_no_bars_beside_its_factors(spark, monkeypatch):
    written, whole = {}, Fa.materialize
    monkeypatch.setattr(Fa, "materialize", lambda df, name="t": written.setdefault(name, df.columns) and whole(df, name))
    D._derived.clear()
    catalog.factors(spark, SF_DIR)
    assert set(written["bars"]) == {"date", "ticker", "gics_sector", *TRADITIONAL_FACTORS} - {"sector_return_5d"}


def test_kept_factors_equal_those_of_the_whole_panel(spark):
    benchmark = spark.createDataFrame([], "date date, spy_close double")
    wanted = ["date", "ticker", "gics_sector", *TRADITIONAL_FACTORS]
    whole = Fa.add_traditional_factors(panel(spark), benchmark).select(*wanted)
    kept = Fa.add_traditional_factors(panel(spark), benchmark, keep=wanted)
    assert kept.columns == wanted
    assert sorted(kept.collect(), key=str) == sorted(whole.collect(), key=str)
    few = Fa.add_traditional_factors(panel(spark), benchmark, keep=["ticker", "beta"])
    assert few.columns == ["ticker", "beta"] and few.count() == 280
