"""Index membership: coverage, verdict and the price panel built on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_ticker

OPEN_END = "9999-12-31"
PANEL_COLUMNS = ["date", "ticker", "open", "high", "low", "close", "volume", "suspicious_return", "gics_sector"]
POINT_IN_TIME = "point_in_time_constituents"
LATEST_FALLBACK = "latest_constituents_fallback"
# Day numbers stay below 2 ** 22 (year 11 400), so a span splits into at most 2 * 22 aligned blocks.
DAY_BITS = 22


@dataclass(frozen=True)
class VerdictLimits:
    """What a membership table must show before it is trusted as point-in-time."""

    dated_ratio: float = 0.80
    active_low: int = 350
    active_high: int = 650
    more_tickers_than: int = 520
    removed_members: int = 10


def usable_prices(prices: DataFrame) -> DataFrame:
    return prices.where(F.col("close").isNotNull() & ~F.coalesce("suspicious_return", F.lit(False)))


def _start() -> Column:
    return F.coalesce("entry_date", "date")


def _end() -> Column:
    return F.coalesce("exit_date", F.lit(OPEN_END).cast("date"))


def universe_coverage(universe: DataFrame, prices: DataFrame) -> DataFrame:
    """One row of membership counts, and active members on the first and last usable price date."""
    usable = usable_prices(prices)
    first_day, last_day = (usable.agg(edge("date")).scalar() for edge in (F.min, F.max))
    entered, left = F.col("entry_date").isNotNull(), F.col("exit_date").isNotNull()

    def active(day: str) -> Column:
        return F.count_distinct(F.when(F.col(day).between(_start(), _end()), F.col("ticker")))

    spans = universe.withColumns({"price_start_date": first_day, "price_end_date": last_day})
    counts = spans.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("ticker").alias("distinct_tickers"),
        F.count_distinct("date").alias("snapshot_dates"),
        F.count_if(entered).alias("rows_with_entry_date"),
        F.count_if(left).alias("rows_with_exit_date"),
        F.count_if(entered & left & (F.col("entry_date") > F.col("exit_date"))).alias("invalid_membership_rows"),
        active("price_start_date").alias("active_at_price_start"),
        active("price_end_date").alias("active_at_price_end"),
        F.min("entry_date").alias("min_entry_date"),
        F.max("exit_date").alias("max_exit_date"),
    )
    return counts.withColumns({"price_start_date": first_day, "price_end_date": last_day})


def pit_verdict(coverage: DataFrame, limits: VerdictLimits = VerdictLimits()) -> DataFrame:
    """Add `dated_ratio`, `has_serious_pit_history` and the `rejection_reasons` to a coverage row."""
    total, removed = F.col("total_rows"), F.col("rows_with_exit_date")
    ratio = F.coalesce(
        F.try_divide((F.col("rows_with_entry_date") + removed).cast("double"), total.cast("double")), F.lit(0.0)
    )

    def implausible(active: Column) -> Column:
        return (active != 0) & ~active.between(limits.active_low, limits.active_high)

    short_history = (F.col("distinct_tickers") <= limits.more_tickers_than) & (removed < limits.removed_members)
    # The reason texts and their order.
    faults = [
        (total == 0, "no constituent rows"),
        (F.col("dated_ratio") < limits.dated_ratio, "less than 80% of rows have entry_date or exit_date"),
        (removed == 0, "no removed members with exit_date"),
        (F.col("invalid_membership_rows") > 0, "some rows have entry_date after exit_date"),
        (short_history, "does not contain enough removed historical tickers"),
        (implausible(F.col("active_at_price_start")), "active member count at price start is implausible"),
        (implausible(F.col("active_at_price_end")), "active member count at price end is implausible"),
    ]
    reasons = F.array_compact(F.array(*[F.when(fault, F.lit(text)) for fault, text in faults]))
    return (
        coverage.withColumn("dated_ratio", ratio)
        .withColumn("rejection_reasons", reasons)
        .withColumn("has_serious_pit_history", F.size("rejection_reasons") == 0)
    )


def panel_latest(universe: DataFrame, prices: DataFrame) -> DataFrame:
    """Usable prices with the sector of the newest membership row; tickers without one keep a NULL sector."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    latest = (
        universe.select("ticker", "date", "gics_sector").withColumn("_rn", F.row_number().over(newest))
        .where("_rn = 1").drop("_rn", "date")
    )
    return usable_prices(prices).join(latest, "ticker", "left").select(*PANEL_COLUMNS)


def membership_steps(universe: DataFrame) -> DataFrame:
    """Per ticker, the sector in force from each `date` on, or not a member (`is_member` false).

    Spans of one ticker may overlap; the newest snapshot, then the latest entry, wins. Every span is cut into aligned
    power-of-two blocks of days (the odd ends at each level) and the best span is kept per block; a day is looked up
    in the `DAY_BITS` blocks that contain it. No pair of spans is formed, however many snapshots a ticker has.
    """
    epoch = F.lit("0001-01-01").cast("date")
    low, high = F.datediff(_start(), epoch), F.datediff(_end(), epoch) + 1
    preference = F.struct(
        F.col("date"), F.col("entry_date").isNotNull().alias("dated"), F.col("entry_date"), F.col("gics_sector")
    )
    spans = (
        universe.select("ticker", low.alias("low"), high.alias("high"), preference.alias("row"))
        .where("low < high").groupBy("ticker", "low", "high").agg(F.max("row").alias("row"))
    )

    blocks = []
    for level in range(DAY_BITS):
        first, last = F.shiftright(F.col("low") + (2**level - 1), level), F.shiftright(F.col("high"), level)
        for block, edge in ((first, first), (last - 1, last)):
            taken = (first < last) & (F.pmod(edge, F.lit(2)) == 1)
            blocks.append(F.when(taken, F.struct(F.lit(level).alias("level"), block.alias("block"))))
    covered = F.array_compact(F.array(*blocks))
    best = (
        spans.select("ticker", "row", F.inline(covered))
        .groupBy("ticker", "level", "block").agg(F.max("row").alias("row"))
    )
    edges = spans.select("ticker", F.explode(F.array("low", "high")).alias("day")).distinct()
    lookups = edges.select("ticker", "day", F.explode(F.sequence(F.lit(0), F.lit(DAY_BITS - 1))).alias("level"))
    lookups = lookups.withColumn("block", F.expr("shiftright(day, level)"))
    hits = lookups.join(best, ["ticker", "level", "block"], "left")
    return hits.groupBy("ticker", "day").agg(F.max("row").alias("row")).select(
        "ticker", F.date_add(epoch, F.col("day")).alias("date"),
        F.col("row").isNotNull().alias("is_member"), F.col("row.gics_sector").alias("gics_sector"),
    )


def panel_point_in_time(universe: DataFrame, prices: DataFrame) -> DataFrame:
    """Usable prices on the days their ticker was a member, with the sector in force that day.

    Membership steps are merged into the bars of their ticker and carried forward, one shuffle by ticker.
    """
    bars = usable_prices(prices).select(
        "*", F.lit(True).alias("_bar"), F.lit(None).cast("struct<is_member:boolean,gics_sector:string>").alias("_step")
    )
    steps = membership_steps(universe).select(
        "date", "ticker", F.lit(False).alias("_bar"), F.struct("is_member", "gics_sector").alias("_step")
    )
    in_order = Window.partitionBy("ticker").orderBy("date", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    merged = bars.unionByName(steps, allowMissingColumns=True).withColumn(
        "_step", F.last("_step", ignorenulls=True).over(in_order)
    )
    return merged.where("_bar and _step.is_member").withColumn("gics_sector", F.col("_step.gics_sector")).select(
        *PANEL_COLUMNS
    )


def choose_panel(
    universe: DataFrame, prices: DataFrame, require_pit: bool = False, limits: VerdictLimits = VerdictLimits()
) -> tuple[DataFrame, str]:
    """The point-in-time panel if the membership table is good enough, else the latest-members panel."""
    verdict = pit_verdict(universe_coverage(universe, prices), limits).first()
    if verdict["has_serious_pit_history"]:
        return panel_point_in_time(universe, prices), POINT_IN_TIME
    if require_pit:
        reasons = "; ".join(verdict["rejection_reasons"])
        raise RuntimeError(f"A point-in-time universe is required, but: {reasons}")
    return panel_latest(universe, prices), LATEST_FALLBACK
