"""From predictions to target weights.

Every function takes `by`, the columns that separate independent portfolios (a candidate id, say), so that a whole
parameter grid is one job. Facts per (`by`, date) number at most calendar days times candidates and are broadcast; no
cross-section is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_ticker, rolling
from ..schemas import PREDICTION
from ..session import materialize
from .groups import SLICE_ROWS, ordinal

LOWEST_CAP = 0.001
LOWEST_TOP_PCT = 0.01
TINY = 1e-12
MARKET_TICKERS = ("SPY", "QQQ")
ADV_ROWS = 20


def as_column(value: float | str | Column) -> Column:
    """A number, or the name of the column that holds it per candidate."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def with_group_facts(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join facts with one row per (candidate, date).

    They are written once: Spark then knows their size and broadcasts them below its threshold, so that the rows stay
    where they are; above it both sides are merged.
    """
    return df.join(materialize(facts, "facts"), list(keys))


def select_predictions(
    predictions: DataFrame, version: str, start=None, end=None, excluded: Sequence[str] = MARKET_TICKERS,
    pred: str = PREDICTION,
) -> DataFrame:
    """Known predictions of one model version inside an out-of-sample window; a missing bound is open."""
    chosen = predictions.where((F.col("model_version") == version) & F.col(pred).isNotNull())
    if excluded:
        chosen = chosen.where(~F.col("ticker").isin([ticker.upper() for ticker in excluded]))
    if start is not None:
        chosen = chosen.where(F.col("date") >= F.lit(start))
    if end is not None:
        chosen = chosen.where(F.col("date") <= F.lit(end))
    return chosen.select("date", "ticker", pred)


def average_dollar_volume(prices: DataFrame, rows: int = ADV_ROWS) -> DataFrame:
    """Mean close times volume over up to `rows` bars of a ticker."""
    traded = prices.where(F.col("close").isNotNull() & F.col("volume").isNotNull())
    mean = F.avg(F.col("close") * F.col("volume")).over(rolling(by_ticker(), rows))
    return traded.select("date", "ticker", mean.alias("avg_dollar_volume_20d"))


def liquidity_filter(predictions: DataFrame, prices: DataFrame, minimum: float) -> DataFrame:
    """Predictions of names traded enough; their columns stay as they are. A minimum of zero or less keeps all."""
    if minimum <= 0:
        return predictions
    joined = predictions.join(average_dollar_volume(prices), ["date", "ticker"], "left")
    return joined.where(F.coalesce("avg_dollar_volume_20d", F.lit(0.0)) >= minimum).select(*predictions.columns)


def rank_and_select(
    predictions: DataFrame, top_pct: float = 0.10, by: Sequence[str] = (), pred: str = PREDICTION,
    max_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add `prediction_rank` within the date, best first, and whether the row is `selected`."""
    keys = [*by, "date"]
    top_pct = min(max(top_pct, LOWEST_TOP_PCT), 1.0)
    sizes = predictions.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * top_pct).cast("int")).alias("_k")
    )
    ranked = ordinal(predictions, keys, pred, ["ticker"], "prediction_rank", max_rows=max_rows)
    return with_group_facts(ranked, sizes, keys).withColumn("selected", F.col("prediction_rank") <= F.col("_k")).drop("_k")


def score_weights(selected: DataFrame, by: Sequence[str] = (), pred: str = PREDICTION, out: str = "raw_weight") -> DataFrame:
    """Share of each selected score above the lowest one, with a small floor so that none is zero."""
    keys = [*by, "date"]
    low, high = F.min(pred), F.max(pred)
    floor = F.greatest(high - low, F.lit(1.0)) * 1e-6
    facts = selected.groupBy(*keys).agg(
        low.alias("_low"), floor.alias("_floor"),
        (F.sum(pred) + F.count(pred) * (floor - low)).alias("_total"),
    )
    share = (F.col(pred) - F.col("_low") + F.col("_floor")) / F.col("_total")
    return with_group_facts(selected, facts, keys).withColumn(out, share).drop("_low", "_floor", "_total")


def _fill_facts(df: DataFrame, keys: Sequence[str], raw: str, cap: Column, exposure: Column, lowest_cap: float) -> DataFrame:
    """Per group: how many names end at the cap, the last of them, and what is left for the others.

    Names at the cap are the leading ones by raw weight, and there are at most exposure / cap of them. So only that
    many rows per group have to be ordered, and Spark prunes the rest before the shuffle; totals are partial sums.
    """
    most = int(1.0 / lowest_cap) + 2
    lifted = df.select(*keys, "ticker", F.greatest(F.col(raw), F.lit(0.0)).alias("_raw"), cap.alias("_cap"),
                       F.least(F.greatest(exposure, F.lit(0.0)), F.lit(1.0)).alias("_exposure"))
    totals = lifted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_raw").alias("_sum"),
        F.max("_cap").alias("_cap"),
        F.least(F.max("_exposure"), F.count(F.lit(1)) * F.max("_cap")).alias("_target"),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("_raw"), "ticker")
    leading = lifted.withColumn("_j", F.row_number().over(order)).where(F.col("_j") <= most)
    leading = with_group_facts(leading.drop("_cap", "_exposure").withColumn("_j", F.col("_j") - 1), totals, keys)
    whole, onwards = Window.partitionBy(*keys), order.rowsBetween(0, Window.unboundedFollowing)
    # What is left from row j on, summed and not subtracted: the smallest weights would lose their digits.
    beyond = F.when(F.col("_n") > most, F.greatest(F.col("_sum") - F.sum("_raw").over(whole), F.lit(0.0))).otherwise(0.0)
    leading = leading.withColumn("_beyond", beyond)
    leading = leading.withColumn("_left_raw", F.sum("_raw").over(onwards) + F.col("_beyond"))
    budget = F.col("_target") - F.col("_j") * F.col("_cap")
    share = F.try_divide(budget * F.col("_raw"), F.col("_left_raw"))
    hit = (F.col("_left_raw") > TINY) & (budget > TINY) & F.coalesce(share >= F.col("_cap"), F.lit(False))
    leading = leading.withColumn("_k", F.coalesce(F.min(F.when(~hit, F.col("_j"))).over(whole), F.count(F.lit(1)).over(whole)))
    capped = F.col("_j") < F.col("_k")
    facts = leading.groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("_k").alias("_k"), F.first("_cap").alias("_cap"),
        (F.first("_target") - F.first("_k") * F.first("_cap")).alias("_rest"),
        (F.first("_beyond") + F.sum(F.when(capped, 0.0).otherwise(F.col("_raw")))).alias("_rest_raw"),
        F.max_by(F.struct("_raw", "ticker"), F.when(capped, F.col("_j"))).alias("_last_capped"),
        F.min_by(F.struct("_raw", "ticker"), "_j").alias("_leader"),
    )
    return facts.select(*keys, F.struct("_n", "_k", "_cap", "_rest", "_rest_raw", "_last_capped", "_leader").alias("_fill"))


def _filled(raw: Column, ticker: Column) -> Column:
    def fact(name: str) -> Column:
        return F.col("_fill").getField(name)

    last = fact("_last_capped")
    above = (raw > last.getField("_raw")) | ((raw == last.getField("_raw")) & (ticker <= last.getField("ticker")))
    equal = F.least(fact("_cap"), F.try_divide(fact("_rest"), fact("_n") - fact("_k")))
    # The facts and the rows may be computed apart, and a sum of doubles depends on the order of its rows: a capped name
    # whose raw weight came out one bit smaller here is not `above`. Its share of the rest is beyond the cap, though.
    shared = F.least(fact("_cap"), F.try_divide(fact("_rest") * raw, fact("_rest_raw")))
    return (
        F.when((fact("_k") > 0) & F.coalesce(above, F.lit(False)), fact("_cap"))
        .when(fact("_rest") <= TINY, 0.0)
        .when(fact("_rest_raw") <= TINY, equal)
        .otherwise(shared)
    )


def cap_weights(
    df: DataFrame, by: Sequence[str] = (), raw: str = "raw_weight", cap: float | str = 0.05,
    exposure: float | str = 1.0, lowest_cap: float | None = None, out: str = "weight",
) -> DataFrame:
    """Scale raw weights to the target exposure with no name above `cap`, passing the excess on to the others.

    `cap` and `exposure` are numbers or column names; with a column, `lowest_cap` is the smallest value in it.
    """
    keys = [*by, "date"]
    lowest = lowest_cap or (cap if isinstance(cap, float) else LOWEST_CAP)
    facts = _fill_facts(df, keys, raw, as_column(cap), as_column(exposure), lowest)
    lifted = F.greatest(F.col(raw), F.lit(0.0))
    return with_group_facts(df, facts, keys).withColumn(out, _filled(lifted, F.col("ticker"))).drop("_fill")


def min_weight_refill(
    df: DataFrame, by: Sequence[str] = (), raw: str = "raw_weight", cap: float | str = 0.05,
    min_weight: float | str = 0.005, exposure: float | str = 1.0, lowest_cap: float | None = None,
    out: str = "target_weight",
) -> DataFrame:
    """Cap, drop the names that end under `min_weight` (never all of them), and cap again with theirs at zero."""
    keys = [*by, "date"]
    cap_column = F.least(F.greatest(as_column(cap), F.lit(LOWEST_CAP)), F.lit(1.0))
    least = F.least(F.greatest(as_column(min_weight), F.lit(0.0)), cap_column)
    lowest = max(LOWEST_CAP, lowest_cap or (cap if isinstance(cap, float) else LOWEST_CAP))
    facts = _fill_facts(df, keys, raw, cap_column, as_column(exposure), lowest)
    lead_raw, lead_ticker = F.col("_fill._leader._raw"), F.col("_fill._leader.ticker")
    first = with_group_facts(df, facts, keys).withColumns({
        "_least": least, "_first": _filled(F.greatest(F.col(raw), F.lit(0.0)), F.col("ticker")),
        "_best": _filled(lead_raw, lead_ticker), "_is_leader": F.col("ticker") == lead_ticker,
    }).drop("_fill")
    kept = F.when(F.col("_best") < F.col("_least"), F.col("_is_leader")).otherwise(F.col("_first") >= F.col("_least"))
    second = first.withColumn("_kept_raw", F.when(kept, F.col(raw)).otherwise(0.0))
    facts = _fill_facts(second, keys, "_kept_raw", cap_column, as_column(exposure), lowest)
    refilled = _filled(F.greatest(F.col("_kept_raw"), F.lit(0.0)), F.col("ticker"))
    return (
        with_group_facts(second, facts, keys)
        .withColumn(out, F.when(F.col("_least") <= 0, F.col("_first")).otherwise(refilled))
        .drop("_fill", "_least", "_first", "_best", "_is_leader", "_kept_raw")
    )


def build_signals(
    predictions: DataFrame, version: str, top_pct: float = 0.10, max_weight: float = 0.05, min_weight: float = 0.005,
    target_exposure: float = 1.0, pred: str = PREDICTION, max_rows: int = SLICE_ROWS,
) -> DataFrame:
    """All predictions with their rank; selected ones carry a weight and, if it is above zero, a long signal."""
    ranked = materialize(rank_and_select(predictions, top_pct, pred=pred, max_rows=max_rows), "ranked")
    weighted = min_weight_refill(
        score_weights(ranked.where("selected"), pred=pred), cap=float(max_weight), min_weight=min_weight,
        exposure=target_exposure,
    ).select(*predictions.columns, "prediction_rank", "target_weight")
    others = ranked.where("not selected").select(
        *predictions.columns, "prediction_rank", F.lit(0.0).alias("target_weight")
    )
    signal = F.when(F.col("target_weight") > 0, "long").otherwise("flat")
    return weighted.unionByName(others).withColumns({"signal": signal, "model_version": F.lit(version)})


def rebalance_positions(
    signals: DataFrame, every: int | str = 5, by: Sequence[str] = (), weight: str = "target_weight"
) -> DataFrame:
    """Long rows of every `every`-th date that has one, from the first on."""
    longs = signals.where("signal = 'long'")
    step = F.greatest(F.lit(1), F.col(every) if isinstance(every, str) else F.lit(int(every)))
    dates = longs.groupBy(*by, "date").agg(F.max(step).alias("_step")).withColumn("_one", F.lit(0))
    numbered = dates.withColumn("_n", F.row_number().over(by_ticker("_one", *by)) - 1)
    chosen = numbered.where(F.pmod("_n", "_step") == 0).select(*by, "date")
    version = ["model_version"] if "model_version" in signals.columns else []
    return with_group_facts(longs, chosen, [*by, "date"]).select(*by, "date", "ticker", weight, *version)


def price_panel(prices: DataFrame, tickers: DataFrame | Sequence[str] | None, start, end, market: str = "SPY") -> DataFrame:
    """Bars of the wanted tickers and the market in [start, end], with the return inside that window.

    `execution_vwap` falls back to the mean of high, low and close.
    """
    bars = prices.where(F.col("close").isNotNull() & F.col("date").between(F.lit(start), F.lit(end)))
    if isinstance(tickers, DataFrame):
        wanted = tickers.select("ticker").unionByName(
            tickers.sparkSession.createDataFrame([(market,)], "ticker string")
        ).distinct()
        bars = bars.join(wanted, "ticker", "left_semi")
    elif tickers is not None:
        bars = bars.where(F.col("ticker").isin([*tickers, market]))
    previous = F.lag("close").over(by_ticker())
    typical = (F.coalesce("high", "close") + F.coalesce("low", "close") + F.col("close")) / 3.0
    return bars.select(
        "date", "ticker", "open", "high", "low", "close", "volume", "vwap",
        (F.try_divide(F.col("close"), previous) - 1).alias("close_return"),
        F.coalesce(F.col("vwap"), typical).alias("execution_vwap"),
    )


def execution_price(panel: DataFrame, model: str = "open", out: str = "fill_price") -> DataFrame:
    """Add the price a model trades at: the close where the model's own price is missing or not positive."""
    wanted = {"open": "open", "vwap": "execution_vwap"}.get(model.lower(), "close")
    positive = F.when(F.col(wanted) > 0, F.col(wanted))
    return panel.withColumn(out, F.coalesce(positive, F.col("close"), F.lit(0.0)))
