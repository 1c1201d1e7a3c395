"""Date and number expressions, all built-in and inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def month_start(ts) -> Column:
    """First day of the month: the cheap key to group by; format it after the aggregate."""
    return F.trunc(ts, "month")


def year_month(month) -> Column:
    return F.date_format(month, "yyyy-MM")


def year_text(ts) -> Column:
    return F.year(ts).cast("string")


def month_text(ts) -> Column:
    return F.lpad(F.month(ts).cast("string"), 2, "0")


def year_number(ts) -> Column:
    return F.year(ts).cast("long")


def month_number(ts) -> Column:
    return F.month(ts).cast("long")


def month_index(ts) -> Column:
    """Months counted from year 0, so neighbours in the calendar differ by one."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")


def index_month(index) -> Column:
    """The first day of the month with this index."""
    i = F.col(index) if isinstance(index, str) else index
    return F.make_date(F.floor(i / 12).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int"), F.lit(1))


def quarter_index(ts) -> Column:
    return (F.year(ts) * 4 + F.quarter(ts) - 1).cast("long")


def decade(year) -> Column:
    return (F.floor(year / 10) * 10).cast("long")


def micros_between(later, earlier) -> Column:
    """Exact difference in microseconds; NULL if either side is NULL."""
    return F.timestamp_diff("MICROSECOND", earlier, later)


def days_between(later, earlier) -> Column:
    """Difference in days with its fraction."""
    return micros_between(later, earlier) / F.lit(float(MICROS_PER_DAY))


def whole_days_between(later, earlier) -> Column:
    """Difference in days, cut toward zero."""
    return days_between(later, earlier).cast("long")


def total_days(micros) -> Column:
    """Days in a sum of microseconds. Sum as decimal first: a long overflows, a double drifts."""
    return micros.cast("double") / F.lit(float(MICROS_PER_DAY))


def exact_micros(later, earlier) -> Column:
    return micros_between(later, earlier).cast("decimal(20,0)")


def ratio(part, whole) -> Column:
    """part / whole as double; NULL instead of an error when whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent_change(current, previous) -> Column:
    return ratio(current - previous, previous) * 100
