"""Customer acquisition: monthly trend, cohort retention and channel quality."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.channels import normalize_channel
from shopmetrics.functions.dates import (
    BUSINESS_TZ,
    add_months,
    business_date,
    business_day_range,
    business_month,
    month_index,
    month_window,
    whole_months,
)
from shopmetrics.functions.money import PCT, pct_change_nonpositive, percent_of, share_even
from shopmetrics.operators.activity import months_between
from shopmetrics.operators.distributed import share_of_total

COHORT_FIRST_DAY, COHORT_END_DAY = 180, 90  # days before the reference date
REPEAT_DAYS = 90
HIBERNATING_DAYS = 180


def acquisition_trend(
    customers: DataFrame, orders: DataFrame, end_month: date, months: int, tz: str = BUSINESS_TZ
) -> DataFrame:
    """New and returning customers for each of the last ``months`` months, gaps filled.

    A customer is new in the month of the first purchase and returning in any
    later month with an order.
    """
    first, last = month_window(end_month, months)
    active_months = (
        orders.filter(business_day_range("created_at", first, last, tz))
        .select("customer_id", business_month("created_at", tz).alias("month_start"))
        .distinct()
    )
    return _trend(customers, active_months, end_month, months, tz)


def acquisition_trend_from_activity(
    customers: DataFrame, activity: DataFrame, end_month: date, months: int, tz: str = BUSINESS_TZ
) -> DataFrame:
    """The same trend from one row per customer (see ``activity``) instead of all orders."""
    first, last = month_window(end_month, months)
    index = F.explode(months_between(*_indexes(first, last))).alias("m")
    year, month = F.call_function("div", F.col("m") - 1, F.lit(12)).cast("int"), (F.col("m") - 1) % 12 + 1
    active_months = activity.select("customer_id", index).select("customer_id", F.make_date(year, month, F.lit(1)).alias("month_start"))
    return _trend(customers, active_months, end_month, months, tz)


def _indexes(first: date, last: date) -> tuple[Column, Column]:
    return F.lit(first.year * 12 + first.month), F.lit(last.year * 12 + last.month)


def _trend(customers: DataFrame, active_months: DataFrame, end_month: date, months: int, tz: str) -> DataFrame:
    """The trend from the distinct (customer_id, month_start) of its window."""
    first, last = month_window(end_month, months)
    new = (
        customers.filter(business_day_range("first_purchase_at", first, last, tz))
        .groupBy(business_month("first_purchase_at", tz).alias("month_start"))
        .agg(F.count("*").alias("new"))
    )
    started = customers.select("customer_id", business_month("first_purchase_at", tz).alias("first_month"))
    returning = (
        active_months.join(started, "customer_id")
        .filter(F.col("first_month") < F.col("month_start"))
        .groupBy("month_start")
        .agg(F.count("*").alias("returning"))
    )
    spine = customers.sparkSession.range(months).select(
        F.add_months(F.lit(first), F.col("id").cast("int")).alias("month_start")
    )
    n_new, n_back = F.coalesce("new", F.lit(0)), F.coalesce("returning", F.lit(0))
    return (
        spine.join(new, "month_start", "left")
        .join(returning, "month_start", "left")
        .select(
            F.date_format("month_start", "yyyy-MM").alias("month"),
            n_new.alias("new_customers"),
            n_back.alias("returning_customers"),
            (n_new + n_back).alias("total_active"),
            share_even(n_back, n_new + n_back).alias("repeat_rate_percent"),
        )
    )


def acquisition_trend_totals(trend: DataFrame) -> DataFrame:
    """Totals of the trend and the last month against the month before."""
    point = F.struct("month", "total_active", "repeat_rate_percent")
    sums = trend.agg(
        F.coalesce(F.sum("new_customers"), F.lit(0)).alias("total_new"),
        F.coalesce(F.sum("returning_customers"), F.lit(0)).alias("total_returning"),
        F.sort_array(F.collect_list(point), asc=False).alias("p"),  # one entry per month of the report
    )
    last, before = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    current = F.coalesce(last["total_active"], F.lit(0))
    previous = F.coalesce(before["total_active"], F.lit(0))
    return sums.select(
        "total_new",
        "total_returning",
        current.alias("current_month_total"),
        pct_change_nonpositive(current, previous).alias("mom_change_percent"),
        F.coalesce(last["repeat_rate_percent"], F.lit(0)).cast(PCT).alias("current_repeat_rate"),
    )


def cohort_retention(
    customers: DataFrame,
    orders: DataFrame,
    end_month: date,
    cohorts: int,
    periods: int,
    report_end: date,
    tz: str = BUSINESS_TZ,
) -> DataFrame:
    """Share of each first-purchase month that ordered again N months later.

    One row per cohort and period; the share is NULL once the period lies past
    ``report_end``. One pass over customers: each joins its set of order months,
    which is bounded by the calendar however many orders it has.
    """
    first, through = _cohort_span(end_month, cohorts, periods)
    order_months = (
        orders.filter(business_day_range("created_at", first, through, tz))
        .groupBy("customer_id")
        .agg(F.collect_set(month_index(business_date("created_at", tz))).alias("order_months"))
    )
    return _cohort_cells(customers, order_months, end_month, cohorts, periods, report_end, tz)


def cohort_retention_from_activity(
    customers: DataFrame,
    activity: DataFrame,
    end_month: date,
    cohorts: int,
    periods: int,
    report_end: date,
    tz: str = BUSINESS_TZ,
) -> DataFrame:
    """The same retention from one row per customer (see ``activity``) instead of all orders."""
    span = _indexes(*_cohort_span(end_month, cohorts, periods))
    order_months = activity.select("customer_id", months_between(*span).alias("order_months"))
    return _cohort_cells(customers, order_months, end_month, cohorts, periods, report_end, tz)


def _cohort_span(end_month: date, cohorts: int, periods: int) -> tuple[date, date]:
    first, last = month_window(end_month, cohorts)
    return first, add_months(last.replace(day=1), periods + 1) - timedelta(days=1)


def _cohort_cells(
    customers: DataFrame, order_months: DataFrame, end_month: date, cohorts: int, periods: int, report_end: date, tz: str
) -> DataFrame:
    """Cells of the cohorts from each customer's set of order months."""
    first, last = month_window(end_month, cohorts)
    cohort = customers.filter(business_day_range("first_purchase_at", first, last, tz)).select(
        "customer_id", business_month("first_purchase_at", tz).alias("cohort_month")
    )
    start = month_index("cohort_month")
    offsets = F.transform(F.coalesce("order_months", F.array().cast("array<int>")), lambda m: m - start)
    later = F.filter(offsets, lambda p: (p >= 1) & (p <= periods))
    counts = (
        cohort.join(order_months, "customer_id", "left")
        .select("cohort_month", F.explode(F.concat(F.array(F.lit(0)), later)).alias("period"))
        .groupBy("cohort_month", "period")  # period 0 counts the cohort itself
        .agg(F.count("*").alias("n"))
    )
    sized = counts.groupBy("cohort_month").agg(
        F.max(F.when(F.col("period") == 0, F.col("n"))).alias("cohort_size"),
        F.map_from_entries(F.collect_list(F.struct("period", "n"))).alias("by_period"),
    )
    cells = sized.withColumn("period_number", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    returners = F.coalesce(F.try_element_at("by_period", F.col("period_number")), F.lit(0))
    complete = F.add_months("cohort_month", F.col("period_number")) <= F.lit(report_end)
    return cells.select(
        "cohort_month",
        "cohort_size",
        "period_number",
        returners.alias("returners"),
        F.when(complete, F.bround(F.lit(100.0) * returners / F.col("cohort_size"), 2)).alias("retention_pct"),
    )


def cohort_weighted_average(cohort: DataFrame) -> DataFrame:
    """Retention per period weighted by cohort size, over complete cells; NULL if there is none."""
    pct = F.col("retention_pct").cast("decimal(7,2)")
    size = F.when(pct.isNotNull(), F.col("cohort_size"))
    return cohort.groupBy("period_number").agg(
        F.round(F.sum(pct * size).cast("decimal(28,2)") / F.nullif(F.sum(size).cast("decimal(18,0)"), F.lit(0)), 6)
        .cast("double")
        .alias("weighted_retention_pct")
    )


def cohort_best_m1(cohort: DataFrame) -> DataFrame:
    """Cohort with the highest first-month retention; the earliest one on ties."""
    return (
        cohort.filter((F.col("period_number") == 1) & F.col("retention_pct").isNotNull())
        .orderBy(F.desc("retention_pct"), "cohort_month")
        .limit(1)
        .select("cohort_month", "retention_pct")
    )


def acquisition_channel_quality(
    customers: DataFrame, orders: DataFrame, attribution: DataFrame, ref_date: date, tz: str = BUSINESS_TZ
) -> DataFrame:
    """Volume, repeat rate, projected value and dormancy per acquisition channel.

    The cohort bought first 180 to 90 days before ``ref_date``, so everyone has
    had 90 days to return.
    """
    first = ref_date - timedelta(days=COHORT_FIRST_DAY)
    last = ref_date - timedelta(days=COHORT_END_DAY + 1)
    tenure = F.greatest(whole_months(F.lit(ref_date), business_date("first_purchase_at", tz)), F.lit(3))
    dormant = business_date("last_order_at", tz) < F.lit(ref_date - timedelta(days=HIBERNATING_DAYS))
    cohort = customers.filter(
        business_day_range("first_purchase_at", first, last, tz) & (F.col("number_of_orders") > 0)
    ).select(
        "customer_id",
        "first_purchase_at",
        F.col("first_order_id").alias("order_id"),
        (F.col("amount_spent") * 12 / tenure).cast("decimal(28,10)").alias("projected"),
        dormant.alias("dormant"),
    )
    # Inner join and distinct rather than a semi join: AQE can split a customer
    # with very many orders on either side of an inner join.
    repeaters = (
        orders.filter(business_day_range("created_at", first, last + timedelta(days=REPEAT_DAYS + 1), tz))
        .select("customer_id", "created_at")
        .join(cohort.select("customer_id", "first_purchase_at"), "customer_id")
        .filter(
            (F.col("created_at") > F.col("first_purchase_at"))
            & (F.col("created_at") <= F.col("first_purchase_at") + F.make_dt_interval(F.lit(REPEAT_DAYS)))
        )
        .select("customer_id", F.lit(True).alias("repeated"))
        .distinct()
    )
    source = attribution.select("order_id", "traffic_channel", "traffic_source", F.lit(True).alias("attributed"))
    channel = normalize_channel(
        F.col("traffic_channel"), F.col("traffic_source"), F.col("attributed").isNull(), "Unknown"
    )
    sums = (
        cohort.join(source, "order_id", "left")
        .join(repeaters, "customer_id", "left")
        .groupBy(channel.alias("channel"))
        .agg(
            F.count("*").alias("new_customers"),
            F.count("repeated").alias("repeated_m3"),
            F.sum("projected").alias("value"),
            F.count("projected").alias("valued"),
            F.count(F.when(F.col("dormant"), 1)).alias("dormant"),
        )
    )
    n = F.col("new_customers")
    mean = F.col("value").cast("decimal(30,6)") / F.nullif(F.col("valued").cast("decimal(18,0)"), F.lit(0))
    report = sums.select(
        "channel",
        "new_customers",
        "repeated_m3",
        percent_of(F.col("repeated_m3"), n, 1).alias("repeat_by_m3_pct"),
        F.round(F.coalesce(mean, F.lit(0)), 0).cast(PCT).alias("avg_projected_12mo_value"),
        percent_of(F.col("dormant"), n, 1).alias("hibernating_pct"),
    )
    return share_of_total(report, "new_customers", "pct_of_total", 1)


def acquisition_channel_quality_totals(channels: DataFrame, ref_date: date) -> DataFrame:
    """Cohort size, benchmark repeat rate and the largest channel (first by name on ties)."""
    lead = F.struct((-F.col("new_customers")).alias("rank"), "channel", "pct_of_total", "repeat_by_m3_pct")
    sums = channels.agg(
        F.coalesce(F.sum("new_customers"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("repeated_m3"), F.lit(0)).alias("back"),
        F.min(lead).alias("top"),
    )
    rate = F.bround(F.col("back").cast("decimal(20,0)") * 100 / F.nullif(F.col("n").cast("decimal(18,0)"), F.lit(0)), 1)
    return sums.select(
        F.lit(ref_date - timedelta(days=COHORT_FIRST_DAY)).alias("cohort_start"),
        F.lit(ref_date - timedelta(days=COHORT_END_DAY)).alias("cohort_end"),
        F.col("n").alias("total_new_customers"),
        F.coalesce(rate, F.lit(0)).cast(PCT).alias("avg_repeat_by_m3_pct"),
        F.coalesce("top.channel", F.lit("N/A")).alias("top_channel"),
        F.coalesce("top.pct_of_total", F.lit(0)).cast(PCT).alias("top_channel_share"),
        F.coalesce("top.repeat_by_m3_pct", F.lit(0)).cast(PCT).alias("top_channel_repeat_rate"),
    )
