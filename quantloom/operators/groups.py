"""Exact order statistics inside groups of any size.

A cross-section (all tickers of one date) grows with the data, so one date can be far larger than a task should
sort. Each function first asks how large the largest group is (one partially aggregated count). Small groups take
the plain window or the plain aggregate. Otherwise Spark's range exchange deals the rows in order to partitions of
at most about `max_rows` rows, which are written with the number of their partition; work is done per slice, and the
slice totals, one row per slice, are added back. Both ways give the same numbers. Rows are ordered by their key after
their value, so that a frequent value is spread over as many slices as its rows need.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

SLICE_ROWS = 2_000_000
EXACT_QUANTILE_ROWS = 100_000
BRACKET_SAMPLE = 20_000


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else df.agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _same(by: Sequence[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by])


def join_groups(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join one-row-per-group `totals`, NULL group keys matching each other."""
    extra = [F.col(f"totals.{c}") for c in totals.columns if c not in by]
    return df.alias("rows").join(totals.alias("totals"), _same(by, "rows", "totals"), "left").select("rows.*", *extra)


def _dealt(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], max_rows: int) -> DataFrame:
    """`df` in slices that follow each other in (`by`, `order`), written with the slice number in `_slice`.

    The table is written first, so the exchange samples and deals the same rows; twice as many slices as needed leave
    room for the error of its sample.
    """
    stored = materialize(df, "rows")
    slices = max(1, math.ceil(2 * stored.count() / max_rows))
    return materialize(stored.repartitionByRange(slices, *by, *order).withColumn("_slice", F.spark_partition_id()), "slices")


def _before(by: Sequence[str], rows: str) -> Column:
    """Rows of the group in earlier slices, from one row per slice."""
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(rows).over(earlier), F.lit(0))


def ordinal(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    row_key: Sequence[str],
    out: str,
    descending: bool = True,
    max_rows: int = SLICE_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """1-based position of each row of its group by `value`, ties by `row_key`; NULL and NaN come last."""
    largest = largest_group(df, by) if largest is None else largest
    kind = df.schema[value].dataType
    known = F.nanvl(F.col(value), F.lit(None).cast(kind)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(value)
    direction = known.desc_nulls_last() if descending else known.asc_nulls_last()
    if largest <= max_rows:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(direction, *row_key)))

    sliced = _dealt(df, by, [direction, *row_key], max_rows)
    sizes = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = materialize(sizes.select(*by, "_slice", _before(by, "_rows").alias("_offset")), "offsets")
    local = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(direction, *row_key))
    placed = join_groups(sliced.withColumn("_local", local), offsets, [*by, "_slice"])
    return placed.select(*df.columns, (F.col("_offset") + F.col("_local")).cast("int").alias(out))


def average_rank(
    df: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    row_key: Sequence[str],
    suffix: str = "_rank",
    max_rows: int = SLICE_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Ascending rank of each non-null value, ties sharing their mean rank; NULL stays NULL."""
    largest = largest_group(df, by) if largest is None else largest
    if largest <= max_rows:
        for value in values:
            known = F.col(value).isNotNull()
            ordered = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
            peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)
            mean_rank = F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)
            df = df.withColumn(value + suffix, F.when(known, mean_rank))
        return df

    for value in values:
        df = _sliced_average_rank(df, by, value, row_key, value + suffix, max_rows)
    return df


def _sliced_average_rank(
    df: DataFrame, by: Sequence[str], value: str, row_key: Sequence[str], out: str, max_rows: int
) -> DataFrame:
    """Only the least and the greatest value of a slice can lie in other slices, too: their copies are added up over
    the slices' edges. All other values are ranked inside their slice."""
    known = F.col(value).isNotNull()
    sliced = _dealt(df, by, [F.col(value).asc_nulls_last(), *row_key], max_rows)
    ends = sliced.where(known).groupBy(*by, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), F.min(value).alias("_low"), F.max(value).alias("_high"),
    )
    ends = materialize(ends.withColumn("_offset", _before(by, "_rows")), "ends")
    inside = join_groups(sliced.where(known), ends, [*by, "_slice"])
    edges = inside.where((F.col(value) == F.col("_low")) | (F.col(value) == F.col("_high"))).groupBy(*by, "_slice", value).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.max(F.when(F.col(value) == F.col("_low"), F.col("_offset")).otherwise(F.col("_offset") + F.col("_rows"))).alias("_end"),
        F.max(F.col(value) == F.col("_low")).alias("_lowest"),
    )
    # Rows before a value: the offset where it is the least of its slice, else what its copies leave of the slice.
    start = F.when(F.col("_lowest"), F.col("_end")).otherwise(F.col("_end") - F.col("_copies"))
    whole = edges.groupBy(*by, value).agg(((F.sum("_copies") + 1) / F.lit(2.0) + F.min(start)).alias("_shared"))
    shared = materialize(whole, "shared")
    for end in ("_low", "_high"):
        named = shared.select(*by, F.col(value).alias(end), F.col("_shared").alias(f"{end}_rank"))
        ends = join_groups(ends, named, [*by, end])
    ends = materialize(ends.drop("_rows"), "ends")
    ordered = Window.partitionBy(*by, "_slice").orderBy(F.col(value).asc_nulls_last())
    peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    local = F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)
    placed = join_groups(sliced.withColumn("_local", local), ends, [*by, "_slice"])
    rank = F.when(F.col(value) == F.col("_low"), F.col("_low_rank")).when(F.col(value) == F.col("_high"), F.col("_high_rank"))
    return placed.select(*df.columns, F.when(known, rank.otherwise(F.col("_offset") + F.col("_local"))).alias(out))


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    probabilities: Sequence[float],
    row_key: Sequence[str] = ("ticker",),
    max_rows: int = EXACT_QUANTILE_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles: `n_<column>` and the array `q_<column>` for each group.

    Groups of up to `max_rows` rows use the built-in aggregate, which holds a group's distinct values. In larger ones
    a sample of fixed size brackets each quantile; rows outside a bracket are only counted.
    """
    largest = largest_group(df, by) if largest is None else largest
    counts = [F.count(c).alias(f"n_{c}") for c in columns]
    levels = F.array(*[F.lit(float(p)) for p in probabilities])
    exact = [F.percentile(c, levels).alias(f"q_{c}") for c in columns]
    if largest <= max_rows:
        return df.groupBy(*by).agg(*counts, *exact)

    df = materialize(df.select(*dict.fromkeys([*by, *row_key, *columns])), "quantiles")
    sizes = materialize(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *counts), "sizes")
    sized = join_groups(df, sizes.select(*by, "_rows"), by)
    parts = [sized.where(F.col("_rows") <= max_rows).groupBy(*by).agg(*counts, *exact)]
    pending, sample, fewest = sizes.where(F.col("_rows") > max_rows), BRACKET_SAMPLE, {}
    while not pending.isEmpty():
        found = _bracketed_quantiles(df, pending, by, columns, probabilities, row_key, sample, fewest)
        missed = reduce(lambda a, b: a | b, [
            (F.col(f"n_{c}") > 0) & (F.col(f"q_{c}").isNull() | F.exists(f"q_{c}", lambda q: q.isNull())) for c in columns
        ])
        parts.append(found.where(~missed).drop("_rows"))
        # A bracket misses about once in a million, or where few values are known. Such a group is tried again with a
        # larger sample, at last the whole group, and with a margin of two of its values, which then must hit.
        pending, sample = materialize(found.where(missed).select(*sizes.columns), "pending"), sample * 8
        known = pending.agg(*[F.min(F.nullif(f"n_{c}", F.lit(0))).alias(c) for c in columns]).first()
        fewest = {c: known[c] for c in columns if known[c]}
    return reduce(DataFrame.unionByName, parts)


def _bracketed_quantiles(df, sizes, by, columns, probabilities, row_key, sample, fewest) -> DataFrame:
    """Bracket each order statistic by sample quantiles five standard errors apart, then sort only what is inside.

    Rows below a bracket are counted, and equal values are merged before the shuffle. `fewest` holds, for groups that
    missed before, the smallest number of known values of each column.
    """
    chance = F.col("_rate")
    rates = sizes.select(*by, F.least(F.lit(1.0), F.lit(float(sample)) / F.col("_rows")).alias("_rate"))
    sampled = join_groups(df, rates, by).where(F.pmod(F.xxhash64(*row_key), F.lit(1_000_003)) < chance * 1_000_003)
    ends = {}
    for c in columns:
        margins = [5.0 * (p * (1.0 - p) / sample) ** 0.5 + 2.0 / min(sample, fewest.get(c, sample)) for p in probabilities]
        ends[c] = [end for p, m in zip(probabilities, margins) for end in (max(0.0, p - m), min(1.0, p + m))]
    edges = {c: F.percentile(c, F.array(*[F.lit(end) for end in ends[c]])).alias(f"b_{c}") for c in columns}
    brackets = materialize(sampled.groupBy(*by).agg(*edges.values()), "brackets")
    rows = join_groups(df, brackets, by)

    slots = [(i, j, c) for i, c in enumerate(columns) for j in range(len(probabilities))]
    # An end at 0 or 1 is open: the sample's extreme is not the group's.
    low = {(i, j): f"b_{c}[{2 * j}]" if ends[c][2 * j] > 0 else "double('-Infinity')" for i, j, c in slots}
    high = {(i, j): f"b_{c}[{2 * j + 1}]" if ends[c][2 * j + 1] < 1 else "double('Infinity')" for i, j, c in slots}
    below = rows.groupBy(*by).agg(*[F.expr(f"count_if({c} < {low[i, j]}) AS below_{i}_{j}") for i, j, c in slots])
    inside = rows.select(*by, F.expr("inline(array_compact(array(" + ", ".join(
        f"CASE WHEN {c} >= {low[i, j]} AND {c} <= {high[i, j]} THEN named_struct('_i', {i}, '_j', {j}, '_v', {c}) END"
        for i, j, c in slots
    ) + ")))")).groupBy(*by, "_i", "_j", "_v").agg(F.count(F.lit(1)).alias("_copies"))

    slot_facts = "inline(array(" + ", ".join(
        f"named_struct('_i', {i}, '_j', {j}, '_below', below_{i}_{j}, '_position', (n_{c} - 1) * {float(probabilities[j])}D)"
        for i, j, c in slots
    ) + "))"
    facts = join_groups(below, sizes, by).select(*by, F.expr(slot_facts))
    ordered = Window.partitionBy(*by, "_i", "_j").orderBy("_v")
    last = F.col("_below") + F.sum("_copies").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    placed = join_groups(inside, facts, [*by, "_i", "_j"]).withColumn("_last", last)
    first = F.col("_last") - F.col("_copies")

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < F.col("_last")), F.col("_v")))

    lower = at(F.floor("_position"))
    share = F.max(F.col("_position") - F.floor("_position"))
    upper = F.when(share == 0, lower).otherwise(at(F.floor("_position") + 1))
    stats = placed.groupBy(*by, "_i", "_j").agg((lower + share * (upper - lower)).alias("_q"))
    wide = stats.groupBy(*by).agg(*[
        F.array(*[
            F.max(F.when((F.col("_i") == i) & (F.col("_j") == j), F.col("_q"))) for j in range(len(probabilities))
        ]).alias(f"q_{c}")
        for i, c in enumerate(columns)
    ])
    return materialize(join_groups(sizes, wide, by), "quantiles")
