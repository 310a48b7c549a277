"""Revenue metrics, all aggregated from the ledger."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.functions.dates import (
    BUSINESS_TZ,
    business_day_range,
    check_range,
    previous_period,
    previous_year,
)
from shopmetrics.functions.money import (
    TOTAL,
    average,
    pct_change_nonpositive,
    pct_change_zero,
    ratio_change,
    share_even,
)
from shopmetrics.operators.distributed import top_with_rest
from shopmetrics.operators.ledger import attributed_orders, booked_from, booked_in

# Month labels.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _is_sale() -> Column:
    return F.col("row_type") == "SALE"


def _kpis() -> list[Column]:
    """Gross sales, returns, net, units and distinct sale orders of a group of ledger rows."""
    sale = _is_sale()
    return [
        F.coalesce(F.sum(F.when(sale, F.col("amount"))), F.lit(0)).cast(TOTAL).alias("sales"),
        F.coalesce(F.sum(F.when(~sale, F.col("amount"))), F.lit(0)).cast(TOTAL).alias("returns"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL).alias("net"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("qty"),
        F.countDistinct(F.when(sale, F.col("order_id"))).alias("orders"),
    ]


def revenue_summary(ledger: DataFrame, d0: date, d1: date, tz: str = BUSINESS_TZ) -> DataFrame:
    """KPI totals of a period and their growth over the preceding period of equal length.

    One scan covers both periods; always one row.
    """
    check_range(d0, d1)
    p0, _ = previous_period(d0, d1)
    periods = (
        booked_in(ledger, [(p0, d1)], tz)
        .groupBy((F.col("date_key") >= F.lit(d0)).alias("is_current"))
        .agg(*_kpis())
    )

    def side(name: str, current: bool, kind: str) -> Column:
        value = F.max(F.when(F.col("is_current") == current, F.col(name)))
        return F.coalesce(value, F.lit(0)).cast(kind)

    names = {"sales": TOTAL, "returns": TOTAL, "net": TOTAL, "qty": "bigint", "orders": "bigint"}
    row = periods.agg(
        *[side(n, True, t).alias(n) for n, t in names.items()],
        *[side(n, False, t).alias(f"prev_{n}") for n, t in names.items()],
    )
    c = {n: F.col(n) for n in row.columns}
    back, prev_back = F.abs(c["returns"]), F.abs(c["prev_returns"])
    return row.select(
        F.lit(d0).alias("start_date"),
        F.lit(d1).alias("end_date"),
        c["sales"].alias("total_sales"),
        back.alias("total_returns"),
        c["net"].alias("net_sales"),
        c["orders"].alias("total_orders"),
        c["qty"].alias("total_qty"),
        average(c["net"], c["orders"]).alias("average_order_value"),
        pct_change_zero(c["net"], c["prev_net"]).alias("net_sales_change_percent"),
        pct_change_zero(c["sales"], c["prev_sales"]).alias("total_sales_change_percent"),
        pct_change_zero(back, prev_back).alias("total_returns_change_percent"),
        pct_change_zero(c["orders"], c["prev_orders"]).alias("orders_change_percent"),
        pct_change_zero(c["qty"], c["prev_qty"]).alias("total_qty_change_percent"),
        ratio_change(c["net"], c["orders"], c["prev_net"], c["prev_orders"]).alias("aov_change_percent"),
    )


def revenue_sparklines(ledger: DataFrame, d0: date, d1: date, tz: str = BUSINESS_TZ) -> DataFrame:
    """One row of KPIs per day that has ledger rows."""
    check_range(d0, d1)
    return (
        booked_in(ledger, [(d0, d1)], tz)
        .groupBy("date_key")
        .agg(*_kpis())
        .select(
            F.col("date_key").alias("date"),
            F.col("net").alias("net_sales"),
            F.col("sales").alias("total_sales"),
            F.abs("returns").alias("total_returns"),
            F.col("orders").alias("total_orders"),
            F.col("qty").alias("total_qty"),
            average(F.col("net"), F.col("orders")).alias("average_order_value"),
        )
    )


def revenue_trend(
    ledger: DataFrame, d0: date, d1: date, grain: str = "day", align: str = "calendar", tz: str = BUSINESS_TZ
) -> DataFrame:
    """Net sales and orders per bucket, next to the same dates one year earlier.

    Buckets match on month and day of their first date. When the earlier range
    covers the same month and day twice, the later year counts. ``align="ordinal"``
    matches weekly buckets by ISO week number instead.
    """
    check_range(d0, d1)
    if grain not in ("day", "week", "month"):
        raise ValueError(f"unknown granularity {grain!r}")
    p0, p1 = previous_year(d0, d1)
    day = F.col("date_key")
    # A date can belong to both ranges when they overlap.
    sides = F.array_compact(
        F.array(
            F.when(day.between(F.lit(d0), F.lit(d1)), F.lit("current")),
            F.when(day.between(F.lit(p0), F.lit(p1)), F.lit("previous")),
        )
    )
    buckets = (
        booked_in(ledger, [(p0, p1), (d0, d1)], tz)
        .select(
            F.explode(sides).alias("side"),
            (day if grain == "day" else F.trunc(day, grain)).alias("bucket"),
            "amount",
            F.when(_is_sale(), F.col("order_id")).alias("sale_order"),
        )
        .groupBy("side", "bucket")
        .agg(F.sum("amount").cast(TOTAL).alias("net"), F.countDistinct("sale_order").alias("orders"))
    )
    if align == "ordinal" and grain == "week":
        match = [F.weekofyear("bucket").alias("m"), F.lit(0).alias("d")]
    else:
        match = [F.month("bucket").alias("m"), F.dayofmonth("bucket").alias("d")]
    point = F.struct("bucket", "net", "orders")
    current, previous = F.col("side") == "current", F.col("side") == "previous"
    # At most one bucket per year and side meets in a (month, day) group.
    matched = buckets.groupBy(*match).agg(
        F.collect_list(F.when(current, point)).alias("points"), F.max(F.when(previous, point)).alias("prev")
    )
    prev_net = F.coalesce(F.col("prev.net"), F.lit(0)).cast(TOTAL)
    prev_orders = F.coalesce(F.col("prev.orders"), F.lit(0))
    return matched.select(F.explode("points").alias("p"), "prev").select(
        F.col("p.bucket").alias("date"),
        F.col("p.net").alias("current_net_sales"),
        F.col("p.orders").alias("current_orders"),
        prev_net.alias("previous_net_sales"),
        prev_orders.alias("previous_orders"),
        pct_change_zero(F.col("p.net"), prev_net).alias("net_sales_change_percent"),
        pct_change_zero(F.col("p.orders"), prev_orders).alias("orders_change_percent"),
    )


def revenue_trend_totals(trend: DataFrame) -> DataFrame:
    """Totals over the points of a trend; the previous side sums matched points only."""

    def total(name: str, kind: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast(kind)

    sums = trend.agg(
        F.count("*").alias("total_points"),
        total("current_net_sales", TOTAL).alias("current_total_net_sales"),
        total("previous_net_sales", TOTAL).alias("previous_total_net_sales"),
        total("current_orders", "bigint").alias("current_total_orders"),
        total("previous_orders", "bigint").alias("previous_total_orders"),
    )
    return sums.withColumns(
        {
            "net_sales_change_percent": pct_change_zero(
                F.col("current_total_net_sales"), F.col("previous_total_net_sales")
            ),
            "orders_change_percent": pct_change_zero(F.col("current_total_orders"), F.col("previous_total_orders")),
        }
    )


def revenue_by_channel(
    orders: DataFrame,
    attribution: DataFrame,
    d0: date,
    d1: date,
    limit: int | None = None,
    tz: str = BUSINESS_TZ,
) -> DataFrame:
    """Revenue share of the four largest channels and of all others together.

    Aggregates straight to the channel; ``limit`` trims the rows shown while
    totals and shares cover every channel.
    """
    check_range(d0, d1)
    if limit is not None and not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    in_range = orders.filter(business_day_range("created_at", d0, d1, tz))
    channels = (
        attributed_orders(in_range, attribution)
        .groupBy(F.coalesce("traffic_channel", F.lit("UNKNOWN")).alias("channel"))
        .agg(F.count("*").alias("orders"), F.sum("net_payment").cast(TOTAL).alias("revenue"))
    )
    folded = top_with_rest(channels, "channel", "revenue", ["orders", "revenue"], 4, "Other")
    all_rows = Window.partitionBy()  # at most five rows
    revenue = F.coalesce("revenue", F.lit(0)).cast(TOTAL)
    out = folded.select(
        "channel",
        "orders",
        revenue.alias("revenue"),
        F.sum(revenue).over(all_rows).cast(TOTAL).alias("total_revenue"),
        F.sum("orders").over(all_rows).alias("total_orders"),
    ).withColumn("percentage", share_even(F.col("revenue"), F.col("total_revenue")))
    return out if limit is None else out.orderBy(F.desc("revenue"), "channel").limit(limit)


def _two_years(ledger: DataFrame, tz: str) -> DataFrame:
    """Day totals (date_key, amount) of the latest year with data and of the year before, with that latest day.

    One pass over the ledger gives the days, which the calendar bounds; the latest one is taken from them. A stored
    ledger finds its latest month in the partition values and opens the months of the two years only.
    """
    if "month_key" in ledger.columns:
        last_month = ledger.agg(F.max("month_key")).scalar()
        ledger = booked_from(ledger, F.make_date(F.year(last_month) - 1, F.lit(1), F.lit(1)), tz)
    days = ledger.groupBy("date_key").agg(F.sum("amount").cast(TOTAL).alias("amount"))
    days = days.withColumn("last_day", F.max("date_key").over(Window.partitionBy()))
    return days.where(F.year("date_key") >= F.year("last_day") - 1)


def yearly_comparison_months(ledger: DataFrame, tz: str = BUSINESS_TZ) -> DataFrame:
    """Full-month revenue of the latest year with data and of the year before, 12 rows."""
    age = F.year("last_day") - F.year("date_key")
    months = (
        _two_years(ledger, tz)
        .groupBy(F.month("date_key").alias("month_number"))
        .agg(
            F.sum(F.when(age == 0, F.col("amount"))).alias("cur"),
            F.sum(F.when(age == 1, F.col("amount"))).alias("prev"),
        )
    )
    labels = F.array(*[F.lit(m) for m in MONTHS])
    spine = ledger.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month_number"))
    return spine.join(months, "month_number", "left").select(
        F.element_at(labels, F.col("month_number")).alias("month"),
        "month_number",
        F.coalesce("cur", F.lit(0)).cast(TOTAL).alias("current_year_revenue"),
        F.coalesce("prev", F.lit(0)).cast(TOTAL).alias("previous_year_revenue"),
    )


def yearly_comparison_ytd(ledger: DataFrame, today: date | None = None, tz: str = BUSINESS_TZ) -> DataFrame:
    """Year-to-date totals up to the latest day with data against the same span a year earlier.

    ``today`` anchors the report when the ledger is empty.
    """
    day, last = F.col("date_key"), F.col("last_day")
    year_ago = F.add_months(last, -12)
    in_cur = (day >= F.trunc(last, "year")) & (day <= last)
    in_prev = (day >= F.trunc(year_ago, "year")) & (day <= year_ago)
    sums = _two_years(ledger, tz).agg(
        F.max("last_day").alias("last_day"),
        F.coalesce(F.sum(F.when(in_cur, F.col("amount"))), F.lit(0)).cast(TOTAL).alias("cur"),
        F.coalesce(F.sum(F.when(in_prev, F.col("amount"))), F.lit(0)).cast(TOTAL).alias("prev"),
    )
    end = F.coalesce("last_day", F.lit(today).cast("date"))
    return sums.select(
        F.year(end).alias("current_year"),
        (F.year(end) - 1).alias("previous_year"),
        end.alias("ytd_end_date"),
        F.col("cur").alias("current_year_total"),
        F.col("prev").alias("previous_year_total"),
        pct_change_nonpositive(F.col("cur"), F.col("prev")).alias("yoy_change_percent"),
    )

