"""Customer KPIs, RFM segmentation and the top-customer report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.dates import BUSINESS_TZ, business_date, business_day_range, check_range
from shopmetrics.functions.money import TOTAL, average, percent_of, rounded_ratio, share_even
from shopmetrics.functions.text import mask_email
from shopmetrics.operators.distributed import Key, ntile_global, share_of_total

# Segment names in report order.
SEGMENTS = [
    "Champions", "Loyal", "Cant Lose Them", "At Risk", "Potential Loyalists", "Promising",
    "New Customers", "About to Sleep", "Hibernating", "Lost",
]
OTHERS = "Others"
TOP_VALUE_SEGMENTS = ["Champions", "Loyal", "Cant Lose Them"]


def active_customer_ids(orders: DataFrame, d0: date, d1: date, tz: str = BUSINESS_TZ) -> DataFrame:
    """Distinct customers with an order in the range, deduplicated before any shuffle of orders."""
    check_range(d0, d1)
    return orders.filter(business_day_range("created_at", d0, d1, tz)).select("customer_id").distinct()


def customer_summary(
    customers: DataFrame, orders: DataFrame, d0: date, d1: date, tz: str = BUSINESS_TZ
) -> DataFrame:
    """Active, new and returning customers, average lifetime value and repeat rate."""
    since = business_date("customer_since", tz)
    is_new, is_returning = since.between(F.lit(d0), F.lit(d1)), since < F.lit(d0)
    active = customers.join(active_customer_ids(orders, d0, d1, tz), "customer_id", "left_semi")
    counts = active.agg(
        F.count("*").alias("total_customers"),
        F.count(F.when(is_new, 1)).alias("new_customers"),
        F.count(F.when(is_returning, 1)).alias("returning_customers"),
        F.count(F.when(F.col("number_of_orders") > 1, 1)).alias("repeaters"),
        F.sum("amount_spent").alias("spent"),
        F.count("amount_spent").alias("spenders"),
    )
    return counts.select(
        F.lit(d0).alias("start_date"),
        F.lit(d1).alias("end_date"),
        "total_customers",
        "new_customers",
        "returning_customers",
        average(F.col("spent"), F.col("spenders")).alias("average_ltv"),
        share_even(F.col("repeaters"), F.col("total_customers")).alias("repeat_purchase_rate"),
    )


def _recency_score(days: Column) -> Column:
    return F.when(days <= 90, 5).when(days <= 180, 4).when(days <= 365, 3).when(days <= 730, 2).otherwise(1)


def _frequency_score(orders: Column) -> Column:
    return F.when(orders >= 11, 5).when(orders >= 4, 4).when(orders == 3, 3).when(orders == 2, 2).otherwise(1)


def _segment(r: Column, f: Column, m: Column) -> Column:
    return (
        F.when((r == 5) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 4) & (f >= 4) & (m >= 3), "Loyal")
        .when((r <= 2) & (f == 5), "Cant Lose Them")
        .when((r <= 2) & (f >= 4) & (m >= 3), "At Risk")
        .when((r == 5) & (f == 1), "New Customers")
        .when((r >= 4) & f.between(2, 3) & (m >= 3), "Potential Loyalists")
        .when((r >= 4) & (f == 1) & (m >= 3), "Promising")
        .when(r == 3, "About to Sleep")
        .when(r == 2, "Hibernating")
        .when(r == 1, "Lost")
        .otherwise(OTHERS)
    )


def rfm_scores(customers: DataFrame, as_of: date, date_tz: str = BUSINESS_TZ) -> DataFrame:
    """Recency, frequency and monetary scores and the segment of every buyer.

    Spend fifths are taken over all buyers, ties split by customer id; a NULL
    spend ranks last and so gets the top fifth.
    """
    metrics = customers.filter((F.col("number_of_orders") > 0) & F.col("last_order_at").isNotNull()).select(
        "customer_id",
        F.col("number_of_orders").alias("frequency"),
        F.col("amount_spent").alias("monetary"),
        F.date_diff(F.lit(as_of), business_date("last_order_at", date_tz)).alias("recency_days"),
    )
    order = [Key("monetary", nulls_last=True), Key("customer_id")]
    return (
        ntile_global(metrics, order, 5, "m_score")
        .withColumns(
            {"r_score": _recency_score(F.col("recency_days")), "f_score": _frequency_score(F.col("frequency"))}
        )
        .withColumn("segment", _segment(F.col("r_score"), F.col("f_score"), F.col("m_score")))
    )


def order_segments(df: DataFrame) -> DataFrame:
    """Sort a segment report by the fixed segment priority, unknown segments last."""
    position = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("segment"))
    return df.orderBy(F.when(position > 0, position).otherwise(len(SEGMENTS) + 1))


def rfm_segments(
    scores: DataFrame, orders: DataFrame, d0: date, d1: date, tz: str = BUSINESS_TZ
) -> DataFrame:
    """Segment report over the customers who ordered in the range; scores are not recomputed for it."""
    members = scores.join(active_customer_ids(orders, d0, d1, tz), "customer_id", "left_semi")
    sums = members.groupBy("segment").agg(
        F.count("*").alias("customer_count"),
        F.sum("monetary").cast(TOTAL).alias("total_lifetime_value"),
        F.count("monetary").alias("spenders"),
        F.sum("frequency").alias("n_orders"),
        F.sum("recency_days").alias("n_days"),
    )
    n = F.col("customer_count")
    report = sums.select(
        "segment",
        "customer_count",
        rounded_ratio(F.col("total_lifetime_value"), F.col("spenders")).alias("avg_lifetime_value"),
        "total_lifetime_value",
        rounded_ratio(F.col("n_orders"), n, 1).alias("avg_orders"),
        rounded_ratio(F.col("n_days"), n, 0).cast("int").alias("avg_days_since_order"),
    )
    return order_segments(share_of_total(report, "customer_count", "percentage"))


def rfm_top_value_share(segments: DataFrame) -> DataFrame:
    """Share of lifetime value held by the three most valuable segments."""
    value = F.col("total_lifetime_value")
    return segments.agg(
        F.coalesce(F.sum(F.when(F.col("segment").isin(TOP_VALUE_SEGMENTS), value)), F.lit(0)).cast(TOTAL).alias("top_ltv"),
        F.sum(value).cast(TOTAL).alias("total_ltv"),
    ).withColumn("top_value_share_pct", percent_of(F.col("top_ltv"), F.col("total_ltv")))


def top_customers(
    customers: DataFrame, scores: DataFrame, limit: int, today: date, date_tz: str = BUSINESS_TZ
) -> DataFrame:
    """The ``limit`` customers with the highest lifetime value, e-mail masked.

    Ties go to the lower customer id.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    top = (
        customers.filter((F.col("number_of_orders") > 0) & (F.col("amount_spent") > 0))
        .select(
            "customer_id",
            "display_name",
            mask_email(F.col("email")).alias("email_masked"),
            F.col("amount_spent").alias("lifetime_value"),
            F.col("number_of_orders").alias("orders_count"),
            business_date("first_purchase_at", date_tz).alias("first_purchase_at"),
            business_date("last_order_at", date_tz).alias("last_order_at"),
            F.date_diff(F.lit(today), business_date("last_order_at", date_tz)).alias("days_since_last_order"),
            "country",
            "province",
        )
        .orderBy(F.desc("lifetime_value"), "customer_id")
        .limit(limit)
    )
    segments = scores.select("customer_id", "segment")
    return top.join(segments, "customer_id", "left").select(
        *top.columns, F.coalesce("segment", F.lit(OTHERS)).alias("rfm_segment")
    )


def buyer_count(customers: DataFrame) -> DataFrame:
    """Number of customers with at least one order."""
    return customers.filter(F.col("number_of_orders") > 0).agg(F.count("*").alias("total_customers"))


def top_customers_concentration(top: DataFrame) -> DataFrame:
    """Lifetime value held by the listed top customers."""
    return top.agg(
        F.count("*").alias("customers"),
        F.coalesce(F.sum("lifetime_value"), F.lit(0)).cast(TOTAL).alias("top_lifetime_value"),
    )
