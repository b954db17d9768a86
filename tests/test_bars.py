"""Bars are exchanged once by ticker, for their sums, their windows and the operators behind them."""

from checks import catalog
from quantloom.operators import factors as Fa
from quantloom.operators import universe as U
from quantloom.plans import projection as D

SF_DIR = "/root/testdata/sf0.001"


def exchanges(frame) -> int:
    """Exchanges by ticker: each names it as its first expression."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(ticker")


def test_bars_flags_and_windows_share_one_exchange(spark):
    flagged = catalog.flagged_bars(spark, SF_DIR)
    assert exchanges(flagged) == 1
    assert exchanges(U.usable_prices(flagged).withColumn("volume_change_5d", Fa.volume_change())) == 1


def test_stored_inputs_do_not_write_the_prices_before_their_flags(spark):
    D._stored.clear()
    catalog.panel(spark, SF_DIR)
    D.benchmark_daily(spark, SF_DIR)
    assert {name for _, _, name in D._stored} == {"universe", "panel", "benchmark_daily"}
