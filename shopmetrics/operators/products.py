"""Product ranking."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.dates import BUSINESS_TZ, check_range, previous_period
from shopmetrics.functions.money import TOTAL, pct_change_nonpositive
from shopmetrics.operators.distributed import rank_top
from shopmetrics.operators.ledger import booked_in


def top_products(
    ledger: DataFrame, d0: date, d1: date, tz: str = BUSINESS_TZ, max_days: int | None = None
) -> DataFrame:
    """Titles with positive revenue, ranked, with the preceding period's numbers.

    Both periods come from one scan. A line without a title has no previous
    numbers.
    """
    check_range(d0, d1, max_days)
    p0, _ = previous_period(d0, d1)
    current = F.col("date_key") >= F.lit(d0)
    previous = ~current & F.col("title").isNotNull()
    titles = (
        booked_in(ledger, [(p0, d1)], tz)
        .groupBy(F.col("title").alias("product_name"))
        .agg(
            F.sum(F.when(current, F.col("amount"))).cast(TOTAL).alias("revenue"),
            F.coalesce(F.sum(F.when(current, F.col("quantity"))), F.lit(0)).alias("units_sold"),
            F.coalesce(F.sum(F.when(previous, F.col("amount"))), F.lit(0)).cast(TOTAL).alias("previous_revenue"),
            F.coalesce(F.sum(F.when(previous, F.col("quantity"))), F.lit(0)).alias("previous_units_sold"),
        )
        .filter(F.col("revenue") > 0)
    )
    return rank_top(titles, "revenue", ["product_name"]).withColumns(
        {
            "revenue_change_percent": pct_change_nonpositive(F.col("revenue"), F.col("previous_revenue")),
            "units_change_percent": pct_change_nonpositive(F.col("units_sold"), F.col("previous_units_sold")),
        }
    )


def product_count(products: DataFrame) -> DataFrame:
    """Number of ranked products."""
    return products.agg(F.count("*").alias("total_products_count"))
