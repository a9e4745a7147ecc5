"""Column-level building blocks.

All of them return built-in Spark expressions (no UDFs), so they stay inside
whole-stage codegen and fold to literals where their inputs are constant.
"""
from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import AsOf

# ---------------------------------------------------------------------------
# Time: explicit ``as_of`` instead of the wall clock
# ---------------------------------------------------------------------------


def parse_as_of(as_of: AsOf) -> datetime | None:
    if as_of is None:
        return None
    if isinstance(as_of, datetime):
        return as_of
    if isinstance(as_of, date):
        return datetime(as_of.year, as_of.month, as_of.day)
    return datetime.fromisoformat(str(as_of))


def wall_clock(moment: datetime | None, spark) -> datetime | None:
    """``moment`` on the session zone's clock, without an offset."""
    if moment is None or moment.tzinfo is None:
        return moment
    return moment.astimezone(ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))).replace(tzinfo=None)


def _literal(moment: datetime, dtype: T.DataType) -> Column:
    """A constant of the column's own type, so comparisons stay on the raw
    column and reach the scan as pushed filters.

    A moment with an offset is one instant for all three types: zoned columns
    compare with the instant, ``TIMESTAMP_NTZ`` and date columns with what the
    session zone's clock and calendar show at that instant.  A moment without
    one is taken as the session clock's reading.
    """
    text = F.lit(moment.isoformat(sep=" "))
    if isinstance(dtype, T.TimestampType):
        return text.cast("timestamp")
    if isinstance(dtype, T.DateType):
        return text.cast("timestamp").cast("date") if moment.tzinfo else F.lit(moment.date().isoformat()).cast("date")
    return text.cast("timestamp").cast("timestamp_ntz") if moment.tzinfo else text.cast("timestamp_ntz")


def now(as_of: AsOf, dtype: T.DataType = T.TimestampNTZType()) -> Column:
    """``as_of`` as a constant of ``dtype``; the session clock when ``None``."""
    moment = parse_as_of(as_of)
    if moment is not None:
        return _literal(moment, dtype)
    if isinstance(dtype, T.DateType):
        return F.current_date()
    if isinstance(dtype, T.TimestampType):
        return F.current_timestamp()
    return F.localtimestamp()


def since(as_of: AsOf, dtype: T.DataType, days: int = 0, hours: int = 0) -> Column:
    """Inclusive lower bound ``as_of - days - hours`` of the column's type.

    On a date column ``days`` back from ``as_of``'s date: a window of ``n``
    days touches ``n + 1`` calendar dates, as in the reports' SQL.
    """
    moment = parse_as_of(as_of)
    if moment is not None:
        return _literal(moment - timedelta(days=days, hours=hours), dtype)
    if isinstance(dtype, T.DateType):
        if hours:
            return since(None, T.TimestampNTZType(), days, hours).cast("date")
        return F.date_sub(F.current_date(), days)
    return now(None, dtype) - F.make_dt_interval(F.lit(days), F.lit(hours))


def days_between(as_of: AsOf, col: Column | str, dtype: T.DataType = T.TimestampNTZType()) -> Column:
    """Calendar days from ``col`` to ``as_of`` (``DATEDIFF(as_of, col)``) as bigint."""
    return F.datediff(now(as_of, dtype), F.col(col) if isinstance(col, str) else col).cast("long")


# ---------------------------------------------------------------------------
# Exact rounding of ratios
# ---------------------------------------------------------------------------


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def ratio_half_up(num: Column, den: Column | int, scale: int) -> Column:
    """``round(num / den, scale)`` with HALF_UP on the exact ratio, as a double.

    ``num`` and ``den`` are integral and ``den > 0``.  The quotient is formed
    in integer arithmetic (decimal(38,0), no overflow for bigint inputs) and
    only the final ``q / 10^scale`` is a floating division, so the result is
    the same correctly rounded double in every engine.
    """
    k = 10**scale
    n = num.cast("decimal(38,0)")
    d = (den if isinstance(den, Column) else F.lit(den)).cast("decimal(38,0)")
    q = _div(F.abs(n) * F.lit(2 * k) + d, d * F.lit(2))
    return F.when(n < 0, -q).otherwise(q).cast("double") / F.lit(float(k))


def micros_between(start: Column | str, end: Column | str) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", start, end)


# ---------------------------------------------------------------------------
# Text
# ---------------------------------------------------------------------------

ELLIPSIS = "…"


def longer_than(col: Column, n: int) -> Column:
    """``length(col) > n``, decided from the first ``n + 1`` characters.

    Exactly the same predicate; it just stops counting once the answer is
    known instead of walking a long text to its end."""
    return F.length(F.left(col, F.lit(n + 1))) > n


def preview(col: Column | str, n: int = 80) -> Column:
    """Text cut to ``n`` characters plus an ellipsis; NULL becomes ''."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return (
        F.when(c.isNull(), F.lit(""))
        .when(longer_than(c, n), F.concat(F.left(c, F.lit(n)), F.lit(ELLIPSIS)))
        .otherwise(c)
    )


# Words that mark a row as an alert (matched case-insensitively).
ALERT_WORDS = ("FAIL", "ERROR", "DENIED")


def alert(col: Column | str) -> Column:
    """True when the string contains FAIL, ERROR or DENIED in any case."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.upper(c).rlike("|".join(ALERT_WORDS)), F.lit(False))


# ---------------------------------------------------------------------------
# Compact numbers (KPI display)
# ---------------------------------------------------------------------------


def compact_number(col: Column | str) -> Column:
    """``2,000,000 -> 2.0M``, ``5,000 -> 5.0K``, ``42 -> 42``, ``3.14159 -> 3.14``.

    Suffix when ``|x| >= 1e6`` / ``1e3`` with one decimal; below that no
    decimals for whole numbers and two (with thousands separators) otherwise.  Rounding is HALF_EVEN on
    the value's decimal form (six places), which equals Python's float
    formatting on all binary-exact values.  NULL stays NULL; text that is not
    a number (``"N/A"``) passes through unchanged.
    """
    c = F.col(col) if isinstance(col, str) else col
    d = c.try_cast("decimal(38,6)")
    a = F.abs(d)

    def scaled(places: int, unit: int) -> Column:
        # Round the exact decimal first, then shift: the shift is exact.
        return (F.bround(d, places) / F.lit(unit)).cast("double")

    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(d.isNull(), c.cast("string"))
        .when(a >= 1_000_000, F.format_string("%.1fM", scaled(-5, 1_000_000)))
        .when(a >= 1_000, F.format_string("%.1fK", scaled(-2, 1_000)))
        .when(d == F.floor(d), F.format_string("%d", d.cast("long")))
        .otherwise(F.format_number(F.bround(d, 2), 2))  # 999.999 -> "1,000.00", with separators
    )


# ---------------------------------------------------------------------------
# Trend glyphs
# ---------------------------------------------------------------------------

# Eight block characters from lowest to highest.
BLOCKS = "▁▂▃▄▅▆▇█"
EMPTY_TREND = BLOCKS[0] * 10


def glyph(value: Column, lo: Column, hi: Column) -> Column:
    """Block character for ``value`` min-max scaled into eight levels.

    A constant series maps to the lowest block (range taken as 1)."""
    rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    level = F.least(F.lit(7), F.floor((value - lo) / rng * F.lit(7.0)).cast("int"))
    return F.substr(F.lit(BLOCKS), level + F.lit(1), F.lit(1))


__all__ = [
    "ALERT_WORDS",
    "BLOCKS",
    "ELLIPSIS",
    "EMPTY_TREND",
    "alert",
    "compact_number",
    "days_between",
    "glyph",
    "longer_than",
    "micros_between",
    "now",
    "parse_as_of",
    "preview",
    "ratio_half_up",
    "since",
]
