"""Business days and calendar arithmetic.

Instants are TIMESTAMP_NTZ columns holding UTC wall-clock time, so no
expression here depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

BUSINESS_TZ = "America/New_York"

Span = tuple[date, date]


def instant_to_utc(col: Column | str) -> Column:
    """A zoned TIMESTAMP as UTC wall-clock TIMESTAMP_NTZ, whatever the session zone."""
    col = F.col(col) if isinstance(col, str) else col
    return F.timestamp_add("MICROSECOND", F.unix_micros(col), F.lit("1970-01-01").cast("timestamp_ntz"))


def local_time(ts: Column | str, tz: str = BUSINESS_TZ) -> Column:
    """UTC instant as local wall-clock time in ``tz``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def business_date(ts: Column | str, tz: str = BUSINESS_TZ) -> Column:
    """Local calendar date of a UTC instant."""
    return local_time(ts, tz).cast("date")


def business_month(ts: Column | str, tz: str = BUSINESS_TZ) -> Column:
    """First day of the local calendar month of a UTC instant."""
    return F.trunc(business_date(ts, tz), "month")


def _local_midnight(day: date, tz: str) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), F.lit(day.isoformat()).cast("timestamp_ntz"))


def business_day_range(ts: Column | str, d0: date, d1: date, tz: str = BUSINESS_TZ) -> Column:
    """Inclusive local-date filter written on the raw instant.

    Both bounds are constants, so Catalyst folds them and hands the comparison
    to the Parquet reader; ``business_date(ts).between(d0, d1)`` would not prune.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (ts >= _local_midnight(d0, tz)) & (ts < _local_midnight(d1 + timedelta(days=1), tz))


def in_spans(ts: Column | str, spans: list[Span], tz: str = BUSINESS_TZ) -> Column:
    """True when the instant falls in any of the inclusive local-date spans."""
    cond = F.lit(False)
    for i, (d0, d1) in enumerate(spans):
        part = business_day_range(ts, d0, d1, tz)
        cond = part if i == 0 else cond | part
    return cond


def month_index(d: Column | str) -> Column:
    """Months since year 0, so that differences are whole calendar months."""
    return F.year(d) * 12 + F.month(d)


def whole_months(later: Column, earlier: Column) -> Column:
    """Completed months between two dates; day-of-month sensitive, no month-end rule.

    ``months_between`` counts 31 Jan to 30 Apr as three whole months, this gives two.
    """
    gap = month_index(later) - month_index(earlier)
    return gap - F.when(F.dayofmonth(later) < F.dayofmonth(earlier), 1).otherwise(0)


# --- driver-side date arithmetic on arguments ------------------------------


def check_range(d0: date, d1: date, max_days: int | None = None) -> None:
    if d1 < d0:
        raise ValueError(f"end date {d1} is before start date {d0}")
    if max_days is not None and (d1 - d0).days > max_days:
        raise ValueError(f"range {d0}..{d1} is longer than {max_days} days")


def add_months(day: date, months: int) -> date:
    """Calendar month shift; the day is clamped to the target month's length."""
    year, month0 = divmod(day.year * 12 + day.month - 1 + months, 12)
    return date(year, month0 + 1, min(day.day, calendar.monthrange(year, month0 + 1)[1]))


def previous_period(d0: date, d1: date) -> Span:
    """The span of equal length that ends the day before ``d0``."""
    return d0 - timedelta(days=(d1 - d0).days + 1), d0 - timedelta(days=1)


def previous_year(d0: date, d1: date) -> Span:
    """The same calendar dates one year earlier."""
    return add_months(d0, -12), add_months(d1, -12)


def month_span(d0: date, d1: date) -> tuple[int, date]:
    """Number of calendar months touched by a range, and the last of them."""
    check_range(d0, d1)
    return (d1.year - d0.year) * 12 + d1.month - d0.month + 1, d1.replace(day=1)


def month_window(end_month: date, months: int) -> Span:
    """First and last day of the ``months`` months that end with ``end_month``."""
    start = add_months(end_month.replace(day=1), 1 - months)
    return start, add_months(end_month.replace(day=1), 1) - timedelta(days=1)
