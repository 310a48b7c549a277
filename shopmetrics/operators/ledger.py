"""The signed sales ledger, the one definition of net sales, and the views next to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.functions.dates import BUSINESS_TZ, Span, business_date, in_spans
from shopmetrics.functions.money import TOTAL, percent_of
from shopmetrics.functions.text import is_product_sku

AMOUNT = "decimal(18,2)"

LEDGER_COLUMNS = [
    "row_type", "date_key", "order_id", "order_name", "line_item_id", "sku", "title",
    "season_code", "line_status", "quantity", "amount", "restock_type",
]


def sales_ledger(
    lines: DataFrame, orders: DataFrame, refund_lines: DataFrame, tz: str = BUSINESS_TZ
) -> DataFrame:
    """Ledger rows plus ``booked_at``, the instant each row books on.

    A sale books when its order was created, a return when its refund was
    processed. Filters on ``booked_at`` reach the scans of both branches.
    """
    line = lines.filter(is_product_sku(F.col("sku"))).select(
        "order_id", "line_item_id", "sku", "title", "season_code", "line_status", "quantity", "discounted_unit_price"
    )
    order = orders.select("order_id", "order_name", "created_at")
    carried = ["order_id", "order_name", "line_item_id", "sku", "title", "season_code", "line_status"]
    sales = line.join(order, "order_id").select(
        F.lit("SALE").alias("row_type"),
        F.col("created_at").alias("booked_at"),
        *carried,
        "quantity",
        (F.col("discounted_unit_price") * F.col("quantity")).cast(AMOUNT).alias("amount"),
        F.lit(None).cast("string").alias("restock_type"),
    )
    refund = refund_lines.select(
        "order_id", "line_item_id", "processed_at", F.col("quantity").alias("back"), "subtotal", "restock_type"
    )
    # Lines before orders: both joins can then share the order_id partitioning of
    # the refunds, and the excluded lines drop out first.
    returns = (
        refund.join(line, ["order_id", "line_item_id"])
        .join(order.select("order_id", "order_name"), "order_id")
        .select(
            F.lit("RETURN").alias("row_type"),
            F.col("processed_at").alias("booked_at"),
            *carried,
            (-F.col("back")).alias("quantity"),
            (-F.col("subtotal")).cast(AMOUNT).alias("amount"),
            "restock_type",
        )
    )
    return sales.unionByName(returns).withColumn("date_key", business_date("booked_at", tz))


def net_sales_lines(
    lines: DataFrame, orders: DataFrame, refund_lines: DataFrame, tz: str = BUSINESS_TZ
) -> DataFrame:
    """One positive row per sold line and one negative row per refunded line.

    The rows of ``sales_ledger`` for a reader of the whole ledger: each line is read
    once and moved once, with its refunds, by order. Filters on the day don't reach
    the scans here.
    """
    key, described = ["order_id", "line_item_id"], ["sku", "title", "season_code", "line_status"]
    sold = lines.filter(is_product_sku(F.col("sku"))).select(
        *key,
        F.lit(False).alias("returned"),
        *described,
        "quantity",
        (F.col("discounted_unit_price") * F.col("quantity")).cast(AMOUNT).alias("amount"),
    )
    back = refund_lines.filter(F.col("line_item_id").isNotNull()).select(
        *key,
        F.lit(True).alias("returned"),
        (-F.col("quantity")).alias("quantity"),
        (-F.col("subtotal")).cast(AMOUNT).alias("amount"),
        "processed_at",
        "restock_type",
    )
    # The windows and the join with the orders share the partitioning by order. Lines come
    # first in their key; a refund is repeated for each line of a repeated key, as a join would.
    so_far = Window.unboundedPreceding, Window.currentRow
    lines_first = Window.partitionBy(*key).orderBy("returned").rowsBetween(*so_far)
    rows = (
        sold.unionByName(back, allowMissingColumns=True)
        .repartition("order_id")
        .withColumns(
            {
                "nth": F.row_number().over(lines_first).cast("bigint"),
                "n_lines": F.count(F.when(~F.col("returned"), 1)).over(lines_first),
            }
        )
        .filter(~F.col("returned") | (F.col("n_lines") > 0))
        .withColumn(
            "nth",
            F.explode(F.when(F.col("returned"), F.sequence(F.lit(1), F.col("n_lines"))).otherwise(F.array("nth"))),
        )
    )
    of_line = Window.partitionBy(*key, "nth").orderBy("returned").rowsBetween(*so_far)
    rows = rows.withColumns({c: F.first(c).over(of_line) for c in described})
    return (
        rows.join(orders.select("order_id", "order_name", "created_at"), "order_id")
        .withColumn("row_type", F.when(F.col("returned"), "RETURN").otherwise("SALE"))
        .withColumn(
            "date_key", business_date(F.when(F.col("returned"), F.col("processed_at")).otherwise(F.col("created_at")), tz)
        )
        .select(*LEDGER_COLUMNS)
    )


def ledger_of(tables, tz: str = BUSINESS_TZ) -> DataFrame:
    """Ledger of a set of canonical tables."""
    return sales_ledger(tables["order_line_items"], tables["orders"], tables["refund_line_items"], tz)


def booked_in(ledger: DataFrame, spans: list[Span], tz: str = BUSINESS_TZ) -> DataFrame:
    """Ledger rows of the given inclusive local-date spans; of a stored ledger only their months are read."""
    if "month_key" in ledger.columns:
        months = [F.col("month_key").between(F.lit(d0.replace(day=1)), F.lit(d1.replace(day=1))) for d0, d1 in spans]
        ledger = ledger.filter(reduce(Column.__or__, months, F.lit(False)))
    if "booked_at" in ledger.columns:
        return ledger.filter(in_spans("booked_at", spans, tz))
    cond = F.lit(False)
    for d0, d1 in spans:
        cond = cond | F.col("date_key").between(F.lit(d0), F.lit(d1))
    return ledger.filter(cond)


def booked_from(ledger: DataFrame, first: Column, tz: str = BUSINESS_TZ) -> DataFrame:
    """Ledger rows of the local date ``first`` (a constant or a scalar subquery) and later."""
    if "month_key" in ledger.columns:
        ledger = ledger.filter(F.col("month_key") >= F.trunc(first, "month"))
    if "booked_at" in ledger.columns:
        midnight = F.convert_timezone(F.lit(tz), F.lit("UTC"), first.cast("timestamp_ntz"))
        return ledger.filter(F.col("booked_at") >= midnight)
    return ledger.filter(F.col("date_key") >= first)


def refund_reconciliation(refunds: DataFrame, refund_lines: DataFrame, tz: str = BUSINESS_TZ) -> DataFrame:
    """Cash returned next to the value booked on lines, per refund.

    The two measure different things; only a refund that names no line is
    unallocated.
    """
    booked = refund_lines.groupBy("refund_id").agg(
        F.sum("subtotal").cast(TOTAL).alias("allocated"), F.count("*").alias("line_count")
    )
    count = F.coalesce("line_count", F.lit(0))
    return refunds.join(booked, "refund_id", "left").select(
        "refund_id",
        "order_id",
        business_date("processed_at", tz).alias("processed_date"),
        "total_refunded",
        F.coalesce("allocated", F.lit(0)).cast(TOTAL).alias("allocated_subtotal"),
        count.alias("refund_line_count"),
        F.when(count == 0, F.col("total_refunded")).otherwise(0).cast(TOTAL).alias("unallocated_refund"),
        "note",
    )


def attributed_orders(orders: DataFrame, attribution: DataFrame) -> DataFrame:
    """Orders with their attribution; ``attributed`` is NULL where there is none."""
    marked = attribution.select(
        "order_id", "traffic_channel", "traffic_source", "device_type", F.lit(True).alias("attributed")
    )
    return orders.select("order_id", "created_at", "total_amount", "total_refunded", "net_payment").join(
        marked, "order_id", "left"
    )


def daily_sales_by_channel(orders: DataFrame, attribution: DataFrame, tz: str = BUSINESS_TZ) -> DataFrame:
    """Orders and revenue per local day, channel, source and device."""
    return (
        attributed_orders(orders, attribution)
        .groupBy(
            business_date("created_at", tz).alias("order_date"),
            F.coalesce("traffic_channel", F.lit("UNKNOWN")).alias("traffic_channel"),
            F.coalesce("traffic_source", F.lit("UNKNOWN")).alias("traffic_source"),
            F.coalesce("device_type", F.lit("unknown")).alias("device_type"),
        )
        .agg(
            F.count("*").alias("orders"),
            F.sum("total_amount").cast(TOTAL).alias("gross_revenue"),
            F.sum("total_refunded").cast(TOTAL).alias("refunded"),
            F.sum("net_payment").cast(TOTAL).alias("net_revenue"),
        )
    )


def daily_conversion(sessions: DataFrame, orders: DataFrame, tz: str = BUSINESS_TZ) -> DataFrame:
    """Sessions, orders and conversion per session day."""
    visits = sessions.groupBy(F.col("session_date").alias("order_date")).agg(F.sum("sessions").alias("sessions"))
    bought = orders.groupBy(business_date("created_at", tz).alias("order_date")).agg(
        F.count("*").alias("n"), F.sum("net_payment").cast(TOTAL).alias("net_revenue")
    )
    n = F.coalesce("n", F.lit(0))
    return visits.join(bought, "order_date", "left").select(
        "order_date",
        "sessions",
        n.alias("orders"),
        "net_revenue",
        percent_of(n, F.col("sessions")).alias("conversion_pct"),
    )
