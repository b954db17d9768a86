"""Forward-return labels, feature preparation and chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_ticker
from ..schemas import FEATURES, HORIZONS, TARGET
from ..session import materialize
from .groups import join_groups

MIN_FEATURE_SHARE = 0.80
SMALL_SAMPLE_DATES = 30
SPLITS = ("train", "validation", "test", "final_holdout")


def _ahead(close: str, rows: int, keys: str) -> Column:
    return F.try_divide(F.lead(close, rows).over(by_ticker(keys)), F.col(close)) - 1


def market_labels(prices: DataFrame, horizons: tuple[int, ...] = HORIZONS, market: str = "SPY") -> DataFrame:
    """Forward returns of the market, one row per date, hence bounded by the calendar."""
    closes = prices.where((F.col("ticker") == market) & F.col("close").isNotNull()).select("date", "ticker", "close")
    closes = closes.dropDuplicates(["date"])
    return closes.select("date", *[_ahead("close", h, "ticker").alias(f"spy_return_{h}d") for h in horizons])


def forward_labels(
    factors: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = HORIZONS, market: str = "SPY"
) -> DataFrame:
    """Join forward, market and excess returns to the factor table. Flagged prices count here."""
    bars = prices.where(F.col("close").isNotNull()).select("date", "ticker", "close")
    own = bars.select("date", "ticker", *[_ahead("close", h, "ticker").alias(f"stock_return_{h}d") for h in horizons])
    labels = own.join(F.broadcast(market_labels(prices, horizons, market)), "date", "left").withColumns({
        f"future_excess_return_{h}d": F.col(f"stock_return_{h}d") - F.col(f"spy_return_{h}d") for h in horizons
    })
    return factors.join(labels, ["date", "ticker"], "left")


def prepare_features(dataset: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Keep rows with enough features; fill the rest by the mean of the kept rows of that date, then by zero.

    The means, one row per date, are written; the rows aren't, so whoever reads the result computes what it selects.
    """
    present = " + ".join(f"int({c} IS NOT NULL)" for c in features)
    kept = dataset.where(F.expr(f"({present}) / {len(features)} >= {MIN_FEATURE_SHARE}"))
    means = kept.groupBy("date").agg(*[F.expr(f"avg({c}) AS mean_{c}") for c in features])
    filled = {c: F.expr(f"coalesce({c}, mean_{c}, 0D)") for c in features}
    return join_groups(kept, materialize(means, "means").hint("broadcast"), ["date"]).withColumns(filled).select(*dataset.columns)


def numbered_dates(dates: DataFrame) -> DataFrame:
    """Distinct dates with their 0-based position and total; one row per date, bounded by the calendar."""
    alone = dates.select("date").distinct().withColumn("_one", F.lit(0))
    return alone.select(
        "date", (F.row_number().over(by_ticker("_one")) - 1).alias("position"),
        F.count(F.lit(1)).over(Window.partitionBy("_one")).alias("total"),
    )


def _at_least_one(value: Column) -> Column:
    return F.greatest(F.lit(1), value.cast("int"))


def split_calendar(
    dates: DataFrame,
    validation_pct: float = 0.15,
    test_pct: float = 0.15,
    final_holdout_pct: float = 0.10,
    embargo_days: int = 5,
) -> DataFrame:
    """The split of each labelled date; dates inside an embargo have none.

    From the newest date back: final holdout, test, validation, train, an embargo between neighbours. Fewer than 30
    dates are cut 60/20/20 without embargo or holdout.
    """
    n, at, first = F.col("total"), F.col("position"), F.lit(1)
    regular, newer = [], n
    for name, share in (("final_holdout", final_holdout_pct), ("test", test_pct), ("validation", validation_pct)):
        oldest = newer - _at_least_one(n * share)
        oldest = oldest if name == "final_holdout" else F.greatest(first, oldest)
        regular.append((name, oldest, newer))
        newer = F.greatest(first, oldest - embargo_days)
    regular.append(("train", F.lit(0), newer))
    cut = _at_least_one(n * 0.60)
    later = F.greatest(cut + 1, (n * 0.80).cast("int"))
    short = {"final_holdout": (n, n), "test": (later, n), "validation": (cut, later), "train": (F.lit(0), cut)}
    few = n < SMALL_SAMPLE_DATES
    bounds = numbered_dates(dates)
    inside = [
        (F.when(few, (at >= short[name][0]) & (at < short[name][1])).otherwise((at >= oldest) & (at < newest)), name)
        for name, oldest, newest in regular
    ]
    # Clamped cuts of very short histories may overlap, so a date can belong to two splits.
    named = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for hit, name in inside]))
    return bounds.select("date", F.explode(named).alias("split"))


def chronological_splits(dataset: DataFrame, target: str = TARGET, **options) -> DataFrame:
    """Labelled rows with a `split` column; rows on embargo dates drop out. Options as `split_calendar`."""
    labelled = dataset.where(F.col(target).isNotNull())
    return labelled.join(F.broadcast(split_calendar(labelled, **options)), "date")


def split_summary(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.count_distinct("date").alias("unique_dates"),
    )


def walk_forward_folds(
    dates: DataFrame, min_train_days: int = 252, step_days: int = 21, final_holdout_pct: float = 0.20, embargo: int = 0
) -> DataFrame:
    """One row per fold: the dates it trains on, the dates it predicts, and which of those are final holdout.

    Training starts at the first date always; `embargo` dates before the predicted ones can be left out.
    """
    step = max(1, step_days)
    days = numbered_dates(dates)
    n = F.col("total")
    least = F.least(F.lit(max(30, min_train_days)), F.greatest(F.lit(1), n - 2))
    holdout = F.greatest(least + 1, (n * (1.0 - final_holdout_pct)).cast("int"))
    at = days.withColumns({"least": least, "holdout": holdout})
    predicted = at.where(F.col("position") >= F.col("least")).withColumn(
        "fold", F.floor((F.col("position") - F.col("least")) / step).cast("int") + 1
    )
    in_holdout = F.when(F.col("position") >= F.col("holdout"), F.col("date"))
    folds = predicted.groupBy("fold").agg(
        F.min("date").alias("predict_start"), F.max("date").alias("predict_end"),
        F.count(F.lit(1)).alias("predict_dates"), F.min(in_holdout).alias("holdout_start"),
        (F.min("position") - embargo).alias("train_dates"),
    )
    first = days.select(F.min("date")).scalar()
    train_end = days.select(F.col("date").alias("train_end"), (F.col("position") + 1).alias("train_dates"))
    return folds.join(F.broadcast(train_end), "train_dates").select(
        "fold", first.alias("train_start"), "train_end", "train_dates", "predict_start", "predict_end", "predict_dates",
        "holdout_start",
    )
