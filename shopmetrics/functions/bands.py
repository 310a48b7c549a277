"""Severity bands on report columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(value: Column, cuts: list[tuple[Column, str]], default: str) -> Column:
    """Label of the first condition that holds."""
    out = F
    for cond, label in cuts:
        out = out.when(cond, label)
    return F.when(value.isNotNull(), out.otherwise(default))


def hibernating_band(pct: Column) -> Column:
    return band(pct, [(pct >= 35, "critical"), (pct >= 20, "warning")], "healthy")


def silence_band(days: Column) -> Column:
    return band(days, [(days > 730, "critical"), (days > 365, "warning")], "normal")


def recency_label(days: Column) -> Column:
    """Short text for days since the last order: Today, 5d ago, 3mo ago, 1.2yr ago."""
    years = F.round(days.cast("decimal(12,0)") / F.lit(365).cast("decimal(3,0)"), 1)
    return (
        F.when(days == 0, "Today")
        .when(days == 1, "Yesterday")
        .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago")))
        .when(days.isNotNull(), F.concat(years.cast("decimal(12,1)").cast("string"), F.lit("yr ago")))
    )


def severity_bands(df: DataFrame, col: str, cuts: list[tuple[float, str]], default: str, out: str) -> DataFrame:
    """Add ``out``: the label of the highest cut (given high to low) that the value reaches."""
    value = F.col(col)
    return df.withColumn(out, band(value, [(value >= cut, label) for cut, label in cuts], default))
