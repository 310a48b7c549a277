"""Traffic reports and conversion across traffic and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.channels import fold_channel_group, normalize_channel
from shopmetrics.functions.dates import BUSINESS_TZ, business_month
from shopmetrics.functions.money import PCT, TOTAL, percent_of, rounded_ratio
from shopmetrics.operators.ledger import attributed_orders


def _monthly(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.trunc("session_date", "month").alias("month"), key).agg(
        F.sum("sessions").alias("sessions"), F.sum("total_users").alias("users")
    )


def monthly_visitors(visitors_daily: DataFrame) -> DataFrame:
    """Sessions and users per month for new and returning visitors."""
    return _monthly(visitors_daily, "new_vs_returning")


def monthly_channels(channel_daily: DataFrame) -> DataFrame:
    """Sessions and users per month and channel group."""
    return _monthly(channel_daily, "channel_group")


def us_states_monthly(region_daily: DataFrame) -> DataFrame:
    """Sessions and users per month and state of the United States."""
    us = region_daily.filter(F.col("country") == "United States")
    return _monthly(us.withColumnRenamed("region", "state"), "state")


def monthly_channel_conversion(
    channel_daily: DataFrame, orders: DataFrame, attribution: DataFrame, tz: str = BUSINESS_TZ
) -> DataFrame:
    """Orders, revenue and conversion per month and channel that had sessions.

    Average order value divides the already rounded revenue.
    """
    visits = channel_daily.groupBy(
        F.trunc("session_date", "month").alias("month"), fold_channel_group(F.col("channel_group")).alias("channel")
    ).agg(F.sum("sessions").alias("sessions"))
    bought = (
        attributed_orders(orders, attribution)
        .groupBy(
            business_month("created_at", tz).alias("month"),
            normalize_channel(F.col("traffic_channel"), F.col("traffic_source")).alias("channel"),
        )
        .agg(F.count("*").alias("n"), F.round(F.sum("net_payment"), 0).cast(TOTAL).alias("net_revenue"))
    )
    n = F.coalesce("n", F.lit(0))
    return visits.join(bought, ["month", "channel"], "left").select(
        "month",
        "channel",
        "sessions",
        n.alias("orders"),
        "net_revenue",
        rounded_ratio(F.col("net_revenue"), F.col("n"), 0).cast(PCT).alias("aov"),
        percent_of(n, F.col("sessions")).alias("conversion_pct"),
    )
