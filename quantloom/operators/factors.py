"""Traditional and news factors and their cross-sectional standardisation.

Windows count rows of a ticker, not calendar days. Rolling work needs one exchange by ticker; cross-sectional work is
done by aggregates per date joined back, so a date is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import by_ticker, change, full_window, rolling
from ..schemas import ALL_FACTORS, NEWS_FACTORS, TRADITIONAL_FACTORS, column_names
from ..session import materialize
from .groups import EXACT_QUANTILE_ROWS, group_quantiles, join_groups
from .universe import VerdictLimits, choose_panel

TRADING_DAYS = 252
TAILS = (0.01, 0.99)


def momentum(rows: int, close: str = "close", window: WindowSpec | None = None) -> Column:
    return change(F.col(close), window or by_ticker(), rows)


def volatility(daily_return: str = "daily_return", rows: int = 20, window: WindowSpec | None = None) -> Column:
    """Annualised sample deviation of the last `rows` daily returns."""
    value = F.col(daily_return)
    return full_window(F.stddev_samp(value), value, rolling(window or by_ticker(), rows), rows) * F.sqrt(F.lit(TRADING_DAYS))


def volume_change(rows: int = 5, volume: str = "volume", window: WindowSpec | None = None) -> Column:
    """Mean volume of the last `rows` bars against the `rows` bars before."""
    value, window = F.col(volume), window or by_ticker()
    recent = full_window(F.avg(value), value, rolling(window, rows), rows)
    earlier = full_window(F.avg(value), value, rolling(window, rows, skip=rows), rows)
    return F.try_divide(recent, earlier) - 1


def rsi(rows: int = 14, change_col: str = "close_change", window: WindowSpec | None = None) -> Column:
    """Relative strength from simple means of gains and losses; NULL when there was no loss."""
    move, frame = F.col(change_col), rolling(window or by_ticker(), rows)
    gain = full_window(F.avg(F.when(move.isNotNull(), F.greatest(move, F.lit(0.0)))), move, frame, rows)
    loss = full_window(F.avg(F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))), move, frame, rows)
    return 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss))


def beta(
    stock: str = "daily_return", market: str = "market_daily_return", rows: int = 60, window: WindowSpec | None = None
) -> Column:
    """Rolling sample covariance with the market over the market's sample variance."""
    own, ref, frame = F.col(stock), F.col(market), rolling(window or by_ticker(), rows)
    paired = F.when(own.isNotNull() & ref.isNotNull(), F.lit(1))
    covariance = full_window(F.covar_samp(own, ref), paired, frame, rows)
    variance = full_window(F.var_samp(ref), ref, frame, rows)
    return F.try_divide(covariance, variance)


def market_returns(panel: DataFrame, benchmark: DataFrame, market: str = "SPY") -> DataFrame:
    """1- and 5-row returns of the market, from its own bars or, without any, from the benchmark table.

    One row per date, so bounded by the calendar; callers broadcast it.
    """
    own = panel.where(F.col("ticker") == market).select("date", F.col("close").alias("close"), F.lit(0).alias("rank"))
    stand_in = benchmark.where(F.col("spy_close").isNotNull()).select(
        "date", F.col("spy_close").alias("close"), F.lit(1).alias("rank")
    )
    series = own.unionByName(stand_in)
    source = series.agg(F.min("rank")).scalar()
    one_a_day = series.where(F.col("rank") == source).groupBy("date").agg(F.first("close").alias("close"))
    in_order = by_ticker("_one")
    return one_a_day.withColumn("_one", F.lit(0)).select(
        "date", change(F.col("close"), in_order, 5).alias("market_return_5d"),
        change(F.col("close"), in_order, 1).alias("market_daily_return"),
    )


def sector_return_5d(panel: DataFrame) -> DataFrame:
    """Mean 5-row momentum per date and sector; rows without a sector get none."""
    means = panel.where(F.col("gics_sector").isNotNull()).groupBy("date", "gics_sector").agg(
        F.avg("momentum_5d").alias("sector_return_5d")
    )
    return panel.join(means, ["date", "gics_sector"], "left")


def add_traditional_factors(
    panel: DataFrame, benchmark: DataFrame, market: str = "SPY", keep: Sequence[str] | None = None
) -> DataFrame:
    """The panel with the traditional factors; with `keep` only these of its columns, so that no others are written."""
    bars = panel.join(F.broadcast(market_returns(panel, benchmark, market)), "date", "left")
    bars = bars.withColumns({
        "daily_return": momentum(1),
        "close_change": F.col("close") - F.lag("close").over(by_ticker()),
    })
    rolled = bars.withColumns({
        "momentum_5d": momentum(5),
        "momentum_20d": momentum(20),
        "momentum_60d": momentum(60),
        "volatility_20d": volatility(),
        "volume_change_5d": volume_change(),
        "rsi_14": rsi(),
        "beta": beta(),
    })
    if keep is None:
        return sector_return_5d(materialize(rolled, "bars"))
    needed = dict.fromkeys([*(c for c in keep if c != "sector_return_5d"), "date", "gics_sector", "momentum_5d"])
    return sector_return_5d(materialize(rolled.select(*needed), "bars")).select(*keep)


def merge_news_factors(factors: DataFrame, news: DataFrame) -> DataFrame:
    """Left join the news factors; days without news count as zero."""
    columns = news.select("date", "ticker", *[F.col(c).cast("double").alias(c) for c in NEWS_FACTORS])
    return factors.join(columns, ["date", "ticker"], "left").fillna(0.0, NEWS_FACTORS)


def winsorized_zscore(
    df: DataFrame,
    columns: list[str],
    by: str = "date",
    prefix: str = "z_",
    max_rows: int = EXACT_QUANTILE_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Clip each column to its 1 % and 99 % quantiles within `by`, then standardise by the population deviation.

    A group with fewer than two values, or a constant one, scores 0 on every row; otherwise NULL stays NULL. Read
    passes: quantiles, then moments of the clipped values, then scores. Per-group results are tiny and joined back.
    NaN counts as missing and comes out as NULL.
    """
    df = df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})
    tails = materialize(
        group_quantiles(df, [by], columns, TAILS, max_rows=max_rows, largest=largest), "tails"
    )

    def clipped(c: str) -> str:
        return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, q_{c}[0]), q_{c}[1]) END"

    moments = join_groups(df, tails, [by]).groupBy(by).agg(*[
        F.expr(f"{function}({clipped(c)}) AS {name}_{c}")
        for c in columns
        for function, name in (("avg", "mean"), ("stddev_pop", "std"))
    ])
    moments = materialize(join_groups(tails, moments, [by]), "moments")
    scores = [
        f"CASE WHEN n_{c} < 2 OR q_{c}[0] = q_{c}[1] THEN 0D "
        f"ELSE try_divide({clipped(c)} - mean_{c}, std_{c}) END AS {prefix}{c}"
        for c in columns
    ]
    return join_groups(df, moments, [by]).selectExpr(*df.columns, *scores)


def add_standardized_factors(factors: DataFrame, **options) -> DataFrame:
    return winsorized_zscore(factors, ALL_FACTORS, **options)


def factor_coverage(factors: DataFrame, below: float = 0.80) -> DataFrame:
    """Non-null share of each factor whose share is under `below`."""
    rows = F.count(F.lit(1))
    shares = factors.agg(*[
        F.coalesce(F.try_divide(F.count(c).cast("double"), rows), F.lit(0.0)).alias(c) for c in ALL_FACTORS
    ])
    return shares.unpivot([], ALL_FACTORS, "factor", "coverage").where(F.col("coverage") < below)


def factor_correlation_pairs(factors: DataFrame, above: float = 0.95) -> DataFrame:
    """Pairs of factors whose Pearson correlation over complete rows exceeds `above` in size.

    Each task reduces its rows to one small matrix of moments per batch; Spark adds the moments of a pair. Values are
    shifted by their overall mean first, so that the sums of products keep their digits.
    """
    values = factors.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in ALL_FACTORS])
    shifts = [value or 0.0 for value in values.agg(*[F.avg(c) for c in ALL_FACTORS]).first()]
    moments = values.mapInPandas(partial(_pair_moments, shifts=shifts), _PAIR_MOMENTS).groupBy("left_factor", "right_factor").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")],
        *[F.min(c).alias(c) for c in ("x_min", "y_min")], *[F.max(c).alias(c) for c in ("x_max", "y_max")],
    )
    n = F.col("n")
    covariance = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n)
    spread_x = F.col("xx") - F.try_divide(F.col("x") * F.col("x"), n)
    spread_y = F.col("yy") - F.try_divide(F.col("y") * F.col("y"), n)
    usable = (n >= 3) & (F.col("x_min") < F.col("x_max")) & (F.col("y_min") < F.col("y_max"))
    correlation = F.when(usable, F.try_divide(covariance, F.sqrt(spread_x) * F.sqrt(spread_y)))
    return moments.select("left_factor", "right_factor", correlation.alias("correlation")).where(F.abs("correlation") > above)


_PAIR_MOMENTS = (
    "left_factor string, right_factor string, n bigint, x double, y double, xx double, yy double, xy double, "
    "x_min double, x_max double, y_min double, y_max double"
)


def _pair_moments(batches: Iterator[pd.DataFrame], shifts: list[float]) -> Iterator[pd.DataFrame]:
    left, right = np.triu_indices(len(ALL_FACTORS), k=1)
    names = np.array(ALL_FACTORS, dtype=object)
    for batch in batches:
        values = batch.to_numpy(dtype=float) - np.array(shifts)
        known = ~np.isnan(values)
        filled, counted = np.where(known, values, 0.0), known.astype(float)
        both, sums = counted.T @ counted, filled.T @ counted
        squares, products = (filled**2).T @ counted, filled.T @ filled
        # Row i, column j: extremes of factor i over the rows where factor j is known too.
        low, high = (
            np.array([edge(np.where(known & known[:, [j]], values, stand_in), axis=0) for j in range(len(names))]).T
            for edge, stand_in in ((np.min, np.inf), (np.max, -np.inf))
        )
        yield pd.DataFrame({
            "left_factor": names[left], "right_factor": names[right], "n": both[left, right].astype(int),
            "x": sums[left, right], "y": sums[right, left],
            "xx": squares[left, right], "yy": squares[right, left], "xy": products[left, right],
            "x_min": low[left, right], "x_max": high[left, right],
            "y_min": low[right, left], "y_max": high[right, left],
        })


@dataclass(frozen=True)
class FactorTable:
    table: DataFrame
    mode: str


def build_factor_table(
    universe: DataFrame,
    prices: DataFrame,
    benchmark: DataFrame,
    news: DataFrame,
    require_pit: bool = False,
    limits: VerdictLimits = VerdictLimits(),
    market: str = "SPY",
) -> FactorTable:
    """Panel, traditional factors, news factors and z-scores, with the panel mode that was chosen."""
    panel, mode = choose_panel(universe, prices, require_pit, limits)
    traditional = add_traditional_factors(panel, benchmark, market, ["date", "ticker", "gics_sector", *TRADITIONAL_FACTORS])
    merged = merge_news_factors(traditional, news)
    merged = materialize(merged.select("date", "ticker", "gics_sector", *ALL_FACTORS), "factors")
    table = add_standardized_factors(merged).select(*column_names("factor_table"))
    return FactorTable(table, mode)


def factor_table_summary(factors: DataFrame) -> DataFrame:
    return factors.agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date")
    )
