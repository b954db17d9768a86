"""Column expressions shared by the operators. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
SESSION_OPEN_MINUTE = 9 * 60 + 30
SESSION_CLOSE_MINUTE = 16 * 60


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (`greatest` and `least` would drop it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def nonempty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def clean_ticker(value: Column) -> Column:
    return F.trim(F.upper(value))


def vendor_ticker(value: Column) -> Column:
    """Share classes are written with a dash: BRK.B -> BRK-B."""
    return F.replace(clean_ticker(value), F.lit("."), F.lit("-"))


def day_from_text(value: Column) -> Column:
    return F.to_date(F.substring(nonempty(value), 1, 10))


def pipe_sha256(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a pipe, NULL counting as the empty string."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(part, F.lit("")) for part in parts]), 256)


def next_trading_day(day: Column) -> Column:
    """Next Monday-to-Friday date strictly after `day`; holidays are not modelled."""
    weekday = F.weekday(day)
    return F.date_add(day, F.when(weekday == 4, 3).when(weekday == 5, 2).otherwise(1))


def session_and_effective_date(published_utc: Column) -> tuple[Column, Column]:
    """Market session of a UTC wall-clock time, and the trading date from which it may be used."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(MARKET_ZONE), published_utc)
    day = F.to_date(local)
    minute = F.hour(local) * 60 + F.minute(local)
    weekend = F.weekday(day) >= 5
    regular = ~weekend & (minute >= SESSION_OPEN_MINUTE) & (minute < SESSION_CLOSE_MINUTE)
    session = (
        F.when(published_utc.isNull(), F.lit(None))
        .when(weekend, F.lit("off_hours"))
        .when(regular, F.lit("regular"))
        .otherwise(F.lit("pre_or_post_market"))
    )
    return session, F.when(regular, day).otherwise(next_trading_day(day))


def by_ticker(*keys: str) -> WindowSpec:
    """Bars of one ticker in date order.

    (date, ticker) is the key of the price table, so such a group holds at most one row per calendar day.
    """
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("date")


def rolling(window: WindowSpec, rows: int, skip: int = 0) -> WindowSpec:
    """The last `rows` rows, ending `skip` rows before the current one."""
    return window.rowsBetween(-(rows + skip - 1), -skip)


def full_window(expression: Column, counted: Column, frame: WindowSpec, rows: int) -> Column:
    """A framed aggregate that is NULL until `rows` non-null inputs are in the frame."""
    return F.when(F.count(counted).over(frame) == rows, expression.over(frame))


def change(value: Column, window: WindowSpec, rows: int) -> Column:
    return F.try_divide(value, F.lag(value, rows).over(window)) - 1


def gated_corr(x: str, y: str) -> Column:
    """Pearson correlation over complete pairs; NULL for fewer than 3 pairs or a constant side.

    The built-in `corr` raises on a constant column in ANSI mode.
    """
    paired = F.col(x).isNotNull() & F.col(y).isNotNull()
    left, right = F.when(paired, F.col(x)), F.when(paired, F.col(y))
    spread = F.sqrt(F.regr_sxx(right, left)) * F.sqrt(F.regr_syy(right, left))
    usable = (F.count(left) >= 3) & (F.min(left) < F.max(left)) & (F.min(right) < F.max(right))
    return F.when(usable, F.try_divide(F.regr_sxy(right, left), spread))
