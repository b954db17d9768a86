"""Accounting of rebalanced portfolios, as joins, sums and running products instead of a loop over days.

A signal on trading date i is filled on date i+1 and earns from date i+2 on. Weights are not drifted by returns.
Frames of one row per (portfolio, date) are bounded by calendar days times candidates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_ticker
from ..schemas import PREDICTION, column_names
from ..session import materialize
from .portfolio import build_signals, execution_price, price_panel, rebalance_positions

MIN_TRADE = 1e-10
YEAR = 252


@dataclass(frozen=True)
class Costs:
    transaction_bps: float = 10.0
    slippage_bps: float = 5.0
    initial_capital: float = 1_000_000.0

    @property
    def rate(self) -> float:
        return (self.transaction_bps + self.slippage_bps) / 10_000.0


def trading_dates(panel: DataFrame) -> DataFrame:
    """Distinct panel dates with their 0-based position."""
    alone = panel.select("date").distinct().withColumn("_one", F.lit(0))
    return alone.select("date", (F.row_number().over(by_ticker("_one")) - 1).alias("position"))


def fill_schedule(positions: DataFrame, dates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each rebalance that gets filled: signal date, fill date, and the position before which it is replaced."""
    signals = positions.select(*by, "date").distinct().join(F.broadcast(dates), "date")
    total = dates.agg(F.count(F.lit(1))).scalar()
    order = Window.partitionBy(*by, "_one").orderBy("position")
    timed = signals.withColumn("_one", F.lit(0)).withColumns({
        "rebalance": F.row_number().over(order),
        "fill_position": F.col("position") + 1,
        "end_position": F.coalesce(F.lead("position").over(order) + 1, total),
    }).where(F.col("fill_position") < total)
    fill_dates = dates.select(F.col("date").alias("fill_date"), F.col("position").alias("fill_position"))
    return timed.join(F.broadcast(fill_dates), "fill_position").select(
        *by, F.col("date").alias("signal_date"), "rebalance", "fill_date", "fill_position", "end_position"
    )


def weights_in_force(
    positions: DataFrame, dates: DataFrame, by: Sequence[str] = (), weight: str = "target_weight"
) -> DataFrame:
    """The weight of each held ticker on each date, after that date's fill."""
    schedule = fill_schedule(positions, dates, by).withColumnRenamed("signal_date", "date")
    held = positions.join(F.broadcast(schedule), [*by, "date"]).select(
        *by, F.col("date").alias("signal_date"), "rebalance", "ticker", F.col(weight).alias("weight"),
        F.explode(F.sequence(F.col("fill_position"), F.col("end_position") - 1)).alias("position"),
    )
    return held.join(F.broadcast(dates), "position")


def weight_changes(
    positions: DataFrame, dates: DataFrame, by: Sequence[str] = (), weight: str = "target_weight"
) -> DataFrame:
    """Per fill and ticker held before or after it: weight before, weight after and the difference.

    Each target is written twice, as the new weight of its fill and the old weight of the next; sums then meet by
    (fill, ticker), so no self-join is needed.
    """
    schedule = fill_schedule(positions, dates, by)
    targets = positions.withColumnRenamed("date", "signal_date").join(
        F.broadcast(schedule), [*by, "signal_date"]
    ).select(*by, "rebalance", "ticker", F.col(weight).alias("w"))
    sides = F.array(
        F.struct(F.col("rebalance").alias("r"), F.lit(0.0).alias("from_weight"), F.col("w").alias("to_weight")),
        F.struct((F.col("rebalance") + 1).alias("r"), F.col("w").alias("from_weight"), F.lit(0.0).alias("to_weight")),
    )
    moves = targets.select(*by, "ticker", F.inline(sides)).withColumnRenamed("r", "rebalance")
    netted = moves.groupBy(*by, "rebalance", "ticker").agg(
        F.sum("from_weight").alias("from_weight"), F.sum("to_weight").alias("to_weight")
    ).withColumn("trade_weight", F.col("to_weight") - F.col("from_weight"))
    fills = schedule.select(*by, "rebalance", "signal_date", "fill_date")
    return netted.join(F.broadcast(fills), [*by, "rebalance"])


def turnover(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of absolute weight changes per fill date."""
    return changes.groupBy(*by, F.col("fill_date").alias("date")).agg(F.sum(F.abs("trade_weight")).alias("turnover"))


def daily_accounts(
    positions: DataFrame, panel: DataFrame, changes: DataFrame, by: Sequence[str] = (), costs: Costs = Costs(),
    market: str = "SPY",
) -> DataFrame:
    """One row per portfolio and trading date with everything the equity curve and the trades need."""
    dates = trading_dates(panel)
    held = weights_in_force(positions, dates, by)
    exposure = held.groupBy(*by, "date").agg(
        F.sum(F.abs("weight")).alias("gross_exposure"), F.sum("weight").alias("net_exposure")
    )
    returns = panel.select("date", "ticker", F.coalesce("close_return", F.lit(0.0)).alias("r"))
    # Yesterday's weights earn today's returns.
    earning = held.drop("date").withColumn("position", F.col("position") + 1).join(F.broadcast(dates), "position")
    gross = earning.join(returns, ["date", "ticker"]).groupBy(*by, "date").agg(F.sum(F.col("weight") * F.col("r")).alias("g"))
    reference = returns.where(F.col("ticker") == market).groupBy("date").agg(F.first("r").alias("benchmark_return"))

    # The portfolios are few (a parameter grid); their keys are repeated on every date without a join.
    every = dates.join(reference, "date", "left")
    if by:
        portfolios = positions.agg(F.sort_array(F.collect_set(F.struct(*by)))).scalar()
        every = every.select("*", F.inline(portfolios))
    keys = [*by, "date"]
    frame = every.join(gross, keys, "left").join(turnover(changes, by), keys, "left").join(exposure, keys, "left")
    frame = frame.fillna(0.0, ["benchmark_return", "g", "turnover", "gross_exposure", "net_exposure"])
    start = F.col("position") == 0
    frame = frame.withColumns({
        "g": F.when(start, 0.0).otherwise(F.col("g")),
        "benchmark_return": F.when(start, 0.0).otherwise(F.col("benchmark_return")),
        "_one": F.lit(0),
    })
    order = Window.partitionBy(*by, "_one").orderBy("date")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    capital = F.lit(float(costs.initial_capital))
    frame = frame.withColumns({
        "portfolio_value": capital * F.product((1 + F.col("g")) * (1 - F.col("turnover") * costs.rate)).over(so_far),
        "benchmark_value": capital * F.product(1 + F.col("benchmark_return")).over(so_far),
    })
    previous = F.coalesce(F.lag("portfolio_value").over(order), capital)
    peak = F.greatest(capital, F.max("portfolio_value").over(so_far))
    return frame.withColumns({
        "strategy_return": F.coalesce(F.try_divide(F.col("portfolio_value"), previous) - 1, F.lit(0.0)),
        "value_after_return": previous * (1 + F.col("g")),
        "drawdown": F.coalesce(F.try_divide(F.col("portfolio_value"), peak) - 1, F.lit(0.0)),
    }).withColumn("cost", F.col("value_after_return") * F.col("turnover") * costs.rate).drop("_one")


def equity_curve(accounts: DataFrame, version: str, by: Sequence[str] = ()) -> DataFrame:
    return accounts.withColumn("model_version", F.lit(version)).select(*by, *column_names("backtest_results"))


def turnover_and_cost(accounts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Turnover and its cost on the dates that had a fill."""
    return accounts.where("turnover > 0").select(*by, "date", "turnover", "value_after_return", "cost")


def _traded(changes: DataFrame, accounts: DataFrame, by: Sequence[str], costs: Costs) -> DataFrame:
    values = accounts.select(*by, F.col("date").alias("fill_date"), "value_after_return")
    sized = changes.where(F.abs("trade_weight") > MIN_TRADE).join(F.broadcast(values), [*by, "fill_date"])
    return sized.withColumns({
        "side": F.when(F.col("trade_weight") > 0, "BUY").otherwise("SELL"),
        "trade_value": F.col("value_after_return") * F.col("trade_weight"),
        "transaction_cost": F.col("value_after_return") * F.abs("trade_weight") * costs.rate,
    })


def trades(changes: DataFrame, accounts: DataFrame, version: str, by: Sequence[str] = (), costs: Costs = Costs()) -> DataFrame:
    return _traded(changes, accounts, by, costs).withColumns(
        {"date": F.col("fill_date"), "model_version": F.lit(version)}
    ).select(*by, *column_names("backtest_trades"))


def _order_id(version: str) -> Column:
    return F.concat_ws("_", F.lit(version), F.col("signal_date").cast("string"), F.col("fill_date").cast("string"), "ticker")


def orders(changes: DataFrame, accounts: DataFrame, version: str, by: Sequence[str] = (), costs: Costs = Costs()) -> DataFrame:
    return _traded(changes, accounts, by, costs).withColumns({
        "order_id": _order_id(version), "order_date": F.col("fill_date"), "target_weight": F.col("to_weight"),
        "current_weight": F.col("from_weight"), "order_weight": F.col("trade_weight"),
        "estimated_order_value": F.col("trade_value"), "model_version": F.lit(version), "status": F.lit("filled"),
    }).select(*by, *column_names("execution_orders"))


def fills(
    changes: DataFrame, accounts: DataFrame, panel: DataFrame, version: str, by: Sequence[str] = (),
    costs: Costs = Costs(), price_model: str = "open",
) -> DataFrame:
    """Executed orders at the model's price; sells carry negative shares and value."""
    priced = execution_price(panel, price_model).select(F.col("date").alias("fill_date"), "ticker", "fill_price")
    traded = _traded(changes, accounts, by, costs).join(priced, ["fill_date", "ticker"], "left").fillna(0.0, ["fill_price"])
    shares = F.when(F.col("fill_price") > 0, F.try_divide("trade_value", "fill_price")).otherwise(0.0)
    return traded.withColumns({
        "order_id": _order_id(version), "fill_id": F.concat(_order_id(version), F.lit("_fill")),
        "fill_shares": shares, "fill_value": F.col("trade_value"),
        "execution_price_model": F.lit(price_model), "model_version": F.lit(version),
    }).select(*by, *column_names("execution_fills"))


def running_shares(filled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative signed shares per ticker after each fill. An exit leaves what its price did not buy back."""
    order = Window.partitionBy(*by, "ticker").orderBy("fill_date").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(*by, "fill_date", "ticker", F.sum("fill_shares").over(order).alias("shares"))


def daily_positions(
    positions: DataFrame, panel: DataFrame, changes: DataFrame, accounts: DataFrame, filled: DataFrame, version: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Shares, price and value of each ticker in force on each date.

    Shares are accumulated once per (fill, ticker); a day then looks up the fill in force by equality.
    """
    keys = [*by, "fill_date", "ticker"]
    order = Window.partitionBy(*by, "ticker").orderBy("fill_date").rowsBetween(Window.unboundedPreceding, 0)
    per_fill = changes.join(filled.select(*keys, "fill_shares"), keys, "left").select(
        *by, "rebalance", "ticker", F.sum(F.coalesce("fill_shares", F.lit(0.0))).over(order).alias("shares")
    )
    held = weights_in_force(positions, trading_dates(panel), by).join(per_fill, [*by, "rebalance", "ticker"], "left")
    closes = panel.select("date", "ticker", F.col("close").alias("market_price"))
    values = accounts.select(*by, "date", "portfolio_value")
    priced = held.join(closes, ["date", "ticker"], "left").join(F.broadcast(values), [*by, "date"])
    return priced.fillna(0.0, ["shares", "market_price"]).withColumns({
        "as_of_date": F.col("date"), "market_value": F.col("portfolio_value") * F.col("weight"),
        "target_weight": F.col("weight"), "current_weight": F.col("weight"), "unrealized_pnl": F.lit(0.0),
        "model_version": F.lit(version),
    }).select(*by, *column_names("current_positions"))


def performance_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Return, risk and trading summary of an equity curve. Total returns run from its first row to its last."""
    def growth(column: str) -> Column:
        return F.try_divide(F.max_by(column, "date"), F.min_by(column, "date")) - 1

    days = F.count(F.lit(1))
    spread = F.coalesce(F.stddev_samp("strategy_return"), F.lit(0.0))
    total, market = growth("portfolio_value"), growth("benchmark_value")
    yearly = F.lit(float(YEAR)) / days
    return curve.groupBy(*by).agg(
        total.alias("total_return"), market.alias("benchmark_return"), (total - market).alias("excess_return"),
        (F.pow(1 + total, yearly) - 1).alias("cagr"), (F.pow(1 + market, yearly) - 1).alias("benchmark_cagr"),
        (spread * F.sqrt(F.lit(float(YEAR)))).alias("annual_volatility"),
        (F.try_divide(F.avg("strategy_return"), spread) * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg("turnover").alias("avg_turnover"),
        F.avg((F.col("strategy_return") > 0).cast("double")).alias("win_rate"),
        F.max_by("portfolio_value", "date").alias("final_portfolio_value"),
        F.max_by("benchmark_value", "date").alias("final_benchmark_value"),
    )


@dataclass(frozen=True)
class Backtest:
    signals: DataFrame
    positions: DataFrame
    panel: DataFrame
    changes: DataFrame
    accounts: DataFrame
    results: DataFrame
    trades: DataFrame
    orders: DataFrame
    fills: DataFrame
    current_positions: DataFrame
    metrics: DataFrame


def simulate(
    predictions: DataFrame, prices: DataFrame, version: str, top_pct: float = 0.10, max_weight: float = 0.05,
    min_weight: float = 0.005, rebalance_days: int = 5, target_exposure: float = 1.0, costs: Costs = Costs(),
    price_model: str = "open", market: str = "SPY", pred: str = PREDICTION,
) -> Backtest:
    """Signals, positions, accounts and orders of one parameter set."""
    signals = materialize(build_signals(predictions, version, top_pct, max_weight, min_weight, target_exposure, pred), "signals")
    positions = materialize(rebalance_positions(signals, rebalance_days), "positions")
    start, end = predictions.agg(F.min("date"), F.max("date")).first()
    panel = materialize(price_panel(prices, positions, start, end, market), "panel")
    changes = materialize(weight_changes(positions, trading_dates(panel)), "changes")
    accounts = materialize(daily_accounts(positions, panel, changes, costs=costs, market=market), "accounts")
    filled = fills(changes, accounts, panel, version, costs=costs, price_model=price_model)
    results = equity_curve(accounts, version)
    return Backtest(
        signals, positions, panel, changes, accounts, results,
        trades(changes, accounts, version, costs=costs), orders(changes, accounts, version, costs=costs), filled,
        daily_positions(positions, panel, changes, accounts, filled, version), performance_metrics(results),
    )


def _latest(df: DataFrame, day: str) -> DataFrame:
    return df.where(F.col(day) == df.select(F.max(day)).scalar())


def latest_holdings(positions: DataFrame, top: int = 50) -> DataFrame:
    """The `top` weights of the newest rebalance with the count, invested and cash share of all of them."""
    latest = _latest(positions, "date")
    invested = latest.select(F.sum("target_weight")).scalar()
    return latest.orderBy(F.desc("target_weight"), "ticker").limit(top).select(
        "date", "ticker", "target_weight", latest.select(F.count(F.lit(1))).scalar().alias("holding_count"),
        invested.alias("invested_weight"), F.greatest(F.lit(0.0), 1.0 - invested).alias("cash_weight"),
    )


def optimized_weights(positions: DataFrame) -> DataFrame:
    """All weights of the newest rebalance, also in percent."""
    latest = _latest(positions, "date")
    invested = latest.select(F.sum("target_weight")).scalar()
    return latest.select(
        "date", "ticker", "target_weight", (F.col("target_weight") * 100.0).alias("target_weight_pct"),
        invested.alias("invested_weight"), F.greatest(F.lit(0.0), 1.0 - invested).alias("cash_weight"),
    ).orderBy(F.desc("target_weight"), "ticker")


def latest_positions(current: DataFrame) -> DataFrame:
    """Positions of the newest date by value, with their count and total value."""
    latest = _latest(current, "as_of_date")
    return latest.select(
        "as_of_date", "ticker", "shares", "market_price", "market_value", "current_weight",
        latest.select(F.count(F.lit(1))).scalar().alias("position_count"),
        latest.select(F.sum("market_value")).scalar().alias("gross_market_value"),
    ).orderBy(F.desc("market_value"), "ticker")
