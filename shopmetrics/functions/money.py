"""Exact decimal arithmetic: ratios, growth and shares.

Spark cuts the scale of a decimal quotient to fit 38 digits, so operands are
cast to a modest precision first and rounding always comes last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "decimal(12,2)"  # unit prices and single payments
TOTAL = "decimal(22,2)"  # sums of money; wide enough for a hot key or a whole table
PCT = "decimal(20,2)"  # percentages and rounded ratios


def quotient(num: Column, den: Column) -> Column:
    """``num / den`` at 11 or more decimals, NULL where the denominator is 0."""
    return num.cast(TOTAL) / F.nullif(den.cast(TOTAL), F.lit(0))


def _change(cur: Column, prev: Column, has_base: Column) -> Column:
    cur, prev = cur.cast(TOTAL), prev.cast(TOTAL)
    return F.when(has_base, F.bround((cur - prev) * 100 / F.nullif(prev, F.lit(0)), 2)).cast(PCT)


def pct_change_zero(cur: Column, prev: Column) -> Column:
    """Growth in percent, rounded half-even; NULL when the base is 0."""
    return _change(cur, prev, prev != 0)


def pct_change_nonpositive(cur: Column, prev: Column) -> Column:
    """Growth in percent, rounded half-even; NULL when the base is 0 or negative."""
    return _change(cur, prev, prev > 0)


def ratio_change(cur_num: Column, cur_den: Column, prev_num: Column, prev_den: Column) -> Column:
    """Growth of one unrounded ratio over another; a ratio with a 0 denominator counts as 0."""
    cur = F.coalesce(quotient(cur_num, cur_den), F.lit(0)).cast("decimal(24,10)")
    prev = F.coalesce(quotient(prev_num, prev_den), F.lit(0)).cast("decimal(24,10)")
    return F.when(prev != 0, F.bround((cur - prev) * 100 / F.nullif(prev, F.lit(0)), 2)).cast(PCT)


def average(num: Column, den: Column) -> Column:
    """Half-even average to cents; 0 when nothing was counted."""
    return F.coalesce(F.bround(quotient(num, den), 2), F.lit(0)).cast(PCT)


def percent_of(num: Column, den: Column, digits: int = 2) -> Column:
    """``100 * num / den`` rounded half away from zero, NULL on a 0 denominator."""
    return F.round(num.cast(TOTAL) * 100 / F.nullif(den.cast(TOTAL), F.lit(0)), digits).cast(PCT)


def share_even(num: Column, den: Column) -> Column:
    """``100 * num / den`` rounded half-even; 0 when the denominator is not positive."""
    share = F.bround(num.cast(TOTAL) * 100 / F.nullif(den.cast(TOTAL), F.lit(0)), 2)
    return F.when(den > 0, share).otherwise(F.lit(0)).cast(PCT)


def rounded_ratio(num: Column, den: Column, digits: int = 2) -> Column:
    """``num / den`` rounded half away from zero, NULL on a 0 denominator."""
    return F.round(quotient(num, den), digits).cast(PCT)
