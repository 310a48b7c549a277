"""Registered queries: ``(spark, sf_dir) -> DataFrame``, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.functions import bands, draws, text
from shopmetrics.functions.dates import business_date, business_day_range
from shopmetrics.operators import (
    acquisition,
    activity,
    ads,
    annotations,
    customers,
    distributed,
    ingest,
    ledger,
    perturb,
    privacy,
    products,
    quality,
    revenue,
    traffic,
)
from shopmetrics.plans import params as p
from shopmetrics.sources.lazy import LazyTables
from shopmetrics.sources.star import StarTables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Callable[[StarTables], DataFrame]) -> Callable[[StarTables], DataFrame]:
    """Register a builder over the canonical tables under its own name."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(StarTables(spark, sf_dir))
    return build


# --- ledger and views --------------------------------------------------------


@query
def net_sales_lines(t):
    return ledger.net_sales_lines(t["order_line_items"], t["orders"], t["refund_line_items"])


@query
def refund_reconciliation(t):
    return ledger.refund_reconciliation(t["refunds"], t["refund_line_items"])


@query
def daily_sales_by_channel(t):
    return ledger.daily_sales_by_channel(t["orders"], t["order_attribution"])


@query
def daily_conversion(t):
    return ledger.daily_conversion(t["sessions_daily"], t["orders"])


@query
def monthly_visitors(t):
    return traffic.monthly_visitors(t["visitors_daily"])


@query
def monthly_channels(t):
    return traffic.monthly_channels(t["channel_daily"])


@query
def us_states_monthly(t):
    return traffic.us_states_monthly(t["region_daily"])


@query
def monthly_channel_conversion(t):
    return traffic.monthly_channel_conversion(t["channel_daily"], t["orders"], t["order_attribution"])


@query
def campaign_monthly(t):
    return ads.campaign_monthly(t["campaign_daily"])


@query
def adset_monthly(t):
    return ads.adset_monthly(t["adset_daily"], t["adset_meta"])


@query
def ad_monthly(t):
    return ads.ad_monthly(t["ad_daily"], t["ad_meta"])


# --- revenue and products ----------------------------------------------------


@query
def revenue_summary(t):
    return revenue.revenue_summary(ledger.ledger_of(t), *p.SUMMARY)


@query
def revenue_sparklines(t):
    return revenue.revenue_sparklines(ledger.ledger_of(t), *p.SUMMARY)


@query
def revenue_trend(t):
    return revenue.revenue_trend(ledger.ledger_of(t), *p.TREND_DAYS, "day")


@query
def revenue_trend_weekly(t):
    return revenue.revenue_trend(ledger.ledger_of(t), *p.TREND_DAYS, "week")


@query
def revenue_trend_monthly(t):
    return revenue.revenue_trend(ledger.ledger_of(t), *p.TREND_MONTHS, "month")


@query
def revenue_trend_totals(t):
    return revenue.revenue_trend_totals(revenue_trend_monthly(t))


@query
def revenue_by_channel(t):
    return revenue.revenue_by_channel(t["orders"], t["order_attribution"], *p.SUMMARY)


@query
def revenue_by_channel_limited(t):
    return revenue.revenue_by_channel(t["orders"], t["order_attribution"], *p.SUMMARY, limit=2)


@query
def yearly_comparison_months(t):
    return revenue.yearly_comparison_months(ledger.ledger_of(t))


@query
def yearly_comparison_ytd(t):
    return revenue.yearly_comparison_ytd(ledger.ledger_of(t))


@query
def top_products(t):
    return products.top_products(ledger.ledger_of(t), *p.PRODUCTS)


@query
def product_count(t):
    return products.product_count(top_products(t))


# --- customers ---------------------------------------------------------------


@query
def customer_summary(t):
    return customers.customer_summary(t["customers"], t["orders"], *p.ACTIVE)


@query
def rfm_scores(t):
    return customers.rfm_scores(t["customers"], p.AS_OF)


@query
def rfm_segments(t):
    return customers.rfm_segments(rfm_scores(t), t["orders"], *p.ACTIVE)


@query
def order_segments(t):
    counts = rfm_scores(t).groupBy("segment").agg(F.count("*").alias("customer_count"))
    return customers.order_segments(counts)


@query
def rfm_top_value_share(t):
    return customers.rfm_top_value_share(rfm_segments(t))


@query
def top_customers(t):
    return customers.top_customers(t["customers"], rfm_scores(t), p.TOP_N, p.AS_OF)


@query
def buyer_count(t):
    return customers.buyer_count(t["customers"])


@query
def top_customers_concentration(t):
    return customers.top_customers_concentration(top_customers(t))


@query
def mask_email(t):
    return t["customers"].select("customer_id", text.mask_email(F.col("email")).alias("email_masked"))


@query
def acquisition_trend(t):
    return acquisition.acquisition_trend(t["customers"], t["orders"], p.TREND_END_MONTH, p.TREND_LENGTH)


@query
def acquisition_trend_from_activity(t):
    months = activity.activity_bitmaps(t["orders"])
    return acquisition.acquisition_trend_from_activity(t["customers"], months, p.TREND_END_MONTH, p.TREND_LENGTH)


@query
def acquisition_trend_totals(t):
    return acquisition.acquisition_trend_totals(acquisition_trend(t))


@query
def cohort_retention(t):
    return acquisition.cohort_retention(
        t["customers"], t["orders"], p.COHORT_END_MONTH, p.COHORTS, p.PERIODS, p.REPORT_END
    )


@query
def cohort_retention_from_activity(t):
    return acquisition.cohort_retention_from_activity(
        t["customers"], activity.activity_bitmaps(t["orders"]), p.COHORT_END_MONTH, p.COHORTS, p.PERIODS, p.REPORT_END
    )


@query
def cohort_weighted_average(t):
    return acquisition.cohort_weighted_average(cohort_retention(t))


@query
def cohort_best_m1(t):
    return acquisition.cohort_best_m1(cohort_retention(t))


@query
def acquisition_channel_quality(t):
    return acquisition.acquisition_channel_quality(
        t["customers"], t["orders"], t["order_attribution"], p.CHANNEL_REF
    )


@query
def acquisition_channel_quality_totals(t):
    return acquisition.acquisition_channel_quality_totals(acquisition_channel_quality(t), p.CHANNEL_REF)


@query
def severity_bands(t):
    """Bands next to the reports they colour."""
    days = F.date_diff(F.lit(p.AS_OF), business_date("last_order_at"))
    silent = t["customers"].select(
        F.concat(F.lit("customer "), F.col("customer_id")).alias("subject"),
        days.cast("double").alias("value"),
        bands.silence_band(days).alias("severity"),
        bands.recency_label(days).alias("label"),
    )
    pct = F.col("hibernating_pct")
    dormant = acquisition_channel_quality(t).select(
        F.concat(F.lit("channel "), F.col("channel")).alias("subject"),
        pct.cast("double").alias("value"),
        bands.hibernating_band(pct).alias("severity"),
        F.lit(None).cast("string").alias("label"),
    )
    return silent.unionByName(dormant)


# --- global numbering --------------------------------------------------------


@query
def assign_row_numbers(t):
    order = [F.col("created_at").asc(), F.col("order_id").asc()]
    return distributed.assign_row_numbers(t["orders"].select("order_id", "created_at"), order)


@query
def ntile_global(t):
    order = [distributed.Key("total_amount", nulls_last=True), distributed.Key("order_id")]
    return distributed.ntile_global(t["orders"].select("order_id", "total_amount"), order, 7, "bucket")


@query
def rank_top(t):
    spend = t["orders"].groupBy("customer_id").agg(F.sum("total_amount").cast("decimal(22,2)").alias("spend"))
    return distributed.rank_top(spend, "spend", ["customer_id"])


@query
def share_of_total(t):
    counts = t["order_attribution"].groupBy("device_type").agg(F.count("*").alias("orders"))
    return distributed.share_of_total(counts, "orders", "share")


# --- annotations -------------------------------------------------------------


@query
def annotations_list(t):
    return annotations.annotations_list(t["annotations"], *p.NOTES, "incident")


@query
def annotations_count(t):
    return annotations.annotations_count(annotations.annotations_list(t["annotations"], *p.NOTES))


@query
def annotations_append(t):
    stamp = F.lit("1996-02-01").cast("timestamp_ntz")
    return annotations.annotations_append(t["annotations"], t.annotation_requests(), stamp)[0]


@query
def annotations_rejected(t):
    return annotations.annotations_append(t["annotations"], t.annotation_requests())[1]


@query
def annotations_overlay(t):
    trend = revenue.revenue_trend(ledger.ledger_of(t), *p.NOTES, "day")
    return annotations.annotations_overlay(trend, t["annotations"]).select(
        "date", "current_net_sales", "annotation_id", "title", "category"
    )


# --- ingestion ---------------------------------------------------------------


@query
def derive_line_columns(t):
    return t["order_line_items"].select(
        "order_id", "line_item_id", "returned_quantity", "current_quantity", "is_returned", "net_sales"
    )


@query
def upsert_snapshot(t):
    """Current daily sessions up to a day, plus an overlapping batch with revised counts."""
    s = t["sessions_daily"]
    current = s.filter(F.col("session_date") <= F.lit(p.SPLIT_DAY))
    overlap = F.col("session_date") > F.lit(p.SPLIT_DAY - timedelta(days=p.REFETCH_DAYS))
    incoming = s.filter(overlap).withColumn("sessions", F.col("sessions") + 1)
    return ingest.upsert_snapshot(current, incoming, ["session_date", "referrer_source"], "updated_at")


@query
def refetch_window(t):
    s = t["sessions_daily"].select("session_date", "referrer_source", "sessions")
    incoming = s.withColumn("sessions", F.col("sessions") * 2)
    return ingest.refetch_window(s, incoming, "session_date", p.REFETCH_DAYS, p.SPLIT_DAY)


@query
def replace_children(t):
    """Discounts of the orders of a period delivered again, without second positions."""
    d = t["order_discounts"].select("id", "order_id", "position", "code_or_title")
    touched = t["orders"].filter(business_day_range("created_at", *p.SUMMARY)).select("order_id")
    incoming = d.filter(F.col("position") == 0).join(touched, "order_id", "left_semi")
    incoming = incoming.withColumn("code_or_title", F.upper("code_or_title"))
    return ingest.replace_children(d, incoming, "order_id")


@query
def pending_attribution(t):
    return ingest.pending_attribution(t["order_attribution"])


@query
def resolve_discount_allocations(t):
    return t["line_item_discount_allocations"]


# --- anonymisation and perturbation ------------------------------------------


@query
def salted_draws(t):
    key = F.col("customer_id").cast("string")
    return t["customers"].select(
        "customer_id",
        draws.salted_hash(key, p.SALT).alias("hash"),
        draws.salted_uniform(key, p.SALT).alias("uniform"),
        draws.fake_name(key, p.SALT).alias("name"),
    )


@query
def anonymize_path(t):
    pages = t["landing_pages_daily"]
    path = draws.anonymize_path(F.col("landing_page"), p.SALT)
    return pages.select("session_date", "landing_page", path.alias("path"))


@query
def build_mappings(t):
    m = privacy.build_mappings(t, p.SALT)
    value = {
        "product": "new_title", "season": "alias", "sku": "new_sku", "discount": "new_code",
        "utm": "new_val", "campaign": "new_name", "adset": "new_id", "ad": "new_id",
    }
    parts = [df.select(F.lit(kind).alias("kind"), "orig", F.col(value[kind]).alias("alias")) for kind, df in m.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def anonymize_customers(t):
    return privacy.anonymize_customers(t["customers"], p.K, p.SALT).select(
        "customer_id", "email", "display_name", "amount_spent", "zip", "tags"
    )


@query
def anonymize_orders(t):
    out = privacy.anonymize_orders(t["orders"], privacy.discount_mapping(t, p.SALT), p.K)
    money = ["total_amount", "current_total", "total_paid", "net_payment", "total_refunded"]
    return out.select("order_id", "order_name", *money, "discount_code")


@query
def anonymize_attribution(t):
    out = privacy.anonymize_attribution(t["order_attribution"], privacy.utm_mapping(t, p.SALT), p.SALT, p.BRAND)
    return out.select("order_id", "user_agent", "referrer_url", "landing_page", "utm_campaign", "utm_content")


@query
def anonymize_discounts(t):
    out = privacy.anonymize_discounts(t["order_discounts"], privacy.discount_mapping(t, p.SALT), p.K)
    return out.select("id", "value_amount", "value_percentage", "description", "code_or_title")


@query
def anonymize_lines(t):
    source = privacy.mapping_source(t)
    m = privacy.build_mappings(t, p.SALT, source)
    out = privacy.anonymize_lines(
        t["order_line_items"], source["order_line_items"], m["product"], m["sku"], m["season"], p.K
    )
    return out.select(
        "order_id", "line_item_id", "sku", "title", "season_code", "original_unit_price",
        "discounted_unit_price", "net_sales",
    )


@query
def anonymize_refunds(t):
    return privacy.anonymize_refunds(t["refunds"], p.K).select("refund_id", "total_refunded", "note")


@query
def anonymize_landing_pages(t):
    return privacy.anonymize_landing_pages(t["landing_pages_daily"], p.SALT).drop("updated_at")


@query
def anonymize_ads(t):
    m = {
        "campaign": privacy.campaign_mapping(t, p.SALT),
        "adset": privacy.adset_mapping(t, p.SALT),
        "ad": privacy.ad_mapping(t, p.SALT),
    }
    out = privacy.anonymize_ads(t["ad_daily"], m, p.K, "campaign", "adset", "ad")
    return out.drop("currency", "updated_at")


@query
def anonymize_campaigns(t):
    maps = {"campaign": privacy.campaign_mapping(t, p.SALT)}
    return privacy.anonymize_ads(t["campaign_daily"], maps, p.K, "campaign").drop("status", "currency", "updated_at")


@query
def anonymize_adsets(t):
    maps = {"campaign": privacy.campaign_mapping(t, p.SALT), "adset": privacy.adset_mapping(t, p.SALT)}
    return privacy.anonymize_ads(t["adset_daily"], maps, p.K, "campaign", "adset").drop("currency", "updated_at")


@query
def anonymize_refund_lines(t):
    out = privacy.anonymize(t, p.K, p.SALT)["refund_line_items"]
    return out.select("id", "order_id", "line_item_id", "quantity", "subtotal")


@query
def anonymize_allocations(t):
    out = privacy.anonymize(t, p.K, p.SALT)["line_item_discount_allocations"]
    return out.select("id", "line_item_id", "order_discount_id", "allocated_amount")


@query
def anonymize_ads_meta(t):
    out = privacy.anonymize_ad_meta(t["ad_meta"], privacy.ad_mapping(t, p.SALT), p.SALT)
    ads_side = out.select(
        "platform", F.col("ad_id").alias("id"), F.col("creative_id").alias("detail"), "landing_url"
    )
    sets = privacy.anonymize_adset_meta(t["adset_meta"], privacy.adset_mapping(t, p.SALT))
    return ads_side.unionByName(
        sets.select(
            "platform",
            F.col("adset_id").alias("id"),
            F.concat_ws("/", "lookalike_source", "audiences").alias("detail"),
            F.lit(None).cast("string").alias("landing_url"),
        )
    )


@query
def anonymize_reviews(t):
    out = privacy.anonymize_reviews(t["reviews"], privacy.product_mapping(t, p.SALT), p.SALT)
    return out.select(
        "id", "title", "body", "product_external_id", "product_handle", "product_title", "ip_address",
        "reviewer_id", "reviewer_external_id", "reviewer_name", "reviewer_email", "has_pictures", "pictures",
    )


@query
def anonymize_checks(t):
    return privacy.anonymize_checks(t, privacy.anonymize(t, p.K, p.SALT, p.BRAND, renumber=False), p.K)


@query
def term_scan(t):
    return quality.term_scan(t, p.BRAND)


@query
def drop_orders(t):
    """Rows left per table after thinning."""
    out = perturb.drop_orders(t, p.PERTURB_SALT)
    names = ["orders", "order_attribution", "order_discounts", "order_line_items", "refund_line_items", "refunds"]
    names.append("line_item_discount_allocations")
    parts = [out[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in names]
    return reduce(DataFrame.unionByName, parts)


@query
def perturb_lines(t):
    out = perturb.perturb_lines(t["order_line_items"], t["refund_line_items"], p.PERTURB_SALT)
    return out.select(
        "order_id", "line_item_id", "quantity", "current_quantity", "original_unit_price",
        "discounted_unit_price", "net_sales", "old_net", "times",
    )


@query
def perturb_refund_lines(t):
    return perturb.perturb_steps(t, p.PERTURB_SALT)["refund_lines"].select("id", "order_id", "subtotal")


@query
def perturb_allocations(t):
    # Nothing else here reads the changed lines, so they aren't written first.
    lines = perturb.perturb_steps(t, p.PERTURB_SALT)["lines"]
    return perturb.perturb_allocations(t["line_item_discount_allocations"], lines).select("id", "allocated_amount")


@query
def rederive_refunds(t):
    return perturb.perturb_steps(t, p.PERTURB_SALT)["refunds"].select(
        "refund_id", "order_id", "total_refunded", "old_total"
    )


@query
def rederive_orders(t):
    steps = perturb.perturb_steps(t, p.PERTURB_SALT)
    return perturb.rederive_orders(t["orders"], steps["refunds"], steps["ratios"]).select(
        "order_id", "total_amount", "total_paid", "total_refunded", "current_total", "net_payment"
    )


@query
def rederive_discounts(t):
    ratios = perturb.perturb_steps(t, p.PERTURB_SALT)["ratios"]
    return perturb.rederive_discounts(t["order_discounts"], ratios).select("id", "value_amount")


@query
def rederive_customers(t):
    orders = perturb.drop_orders(t, p.PERTURB_SALT)["orders"]
    return perturb.rederive_customers(t["customers"], orders).select(
        "customer_id", "number_of_orders", "amount_spent", "first_order_id", "first_purchase_at",
        "last_order_id", "last_order_at", "customer_since",
    )


@query
def renumber_orders(t):
    kept = perturb.drop_orders(t, p.PERTURB_SALT)["orders"]
    return privacy.renumber_orders(kept).select("order_id", "order_name", "created_at")


@query
def perturb_checks(t):
    return perturb.perturb_checks(t, perturb.perturb(t, p.PERTURB_SALT, renumber=False))


@query
def perturb_quantity(t):
    out = perturb.perturb_quantity(t["order_line_items"], t["orders"], t["refund_line_items"], p.QTY_SALT)
    return out.select(
        "order_id", "line_item_id", "quantity", "current_quantity", "unfulfilled_quantity",
        "original_unit_price", "discounted_unit_price",
    )


@query
def perturb_quantity_checks(t):
    new = perturb.perturb_quantity(t["order_line_items"], t["orders"], t["refund_line_items"], p.QTY_SALT)
    return perturb.perturb_quantity_checks(t, LazyTables({"order_line_items": lambda: new}, t))


# --- data quality ------------------------------------------------------------


@query
def check_keys(t):
    return quality.key_report(t)


@query
def check_references(t):
    return quality.reference_report(t)


@query
def check_domains(t):
    """Declared rules on every table, and on the unvalidated notes, which break some."""
    declared = quality.domain_report(t)
    raw = quality.check_domains(t.annotation_requests(), {
        "date not null": F.col("date").isNotNull(),
        "title not empty": F.col("title") != "",
        "category known": F.col("category").isin(annotations.CATEGORIES),
    })
    return declared.unionByName(raw.select(F.lit("annotation_requests").alias("table_name"), "*"))


@query
def check_metric_bounds(t):
    daily = revenue.revenue_sparklines(ledger.ledger_of(t), *p.SUMMARY)
    bounds = {"total_orders": (0, None), "total_returns": (0, None), "net_sales": (0, None), "total_qty": (0, None)}
    return quality.check_metric_bounds(daily, bounds)
