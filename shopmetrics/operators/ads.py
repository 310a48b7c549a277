"""Paid-ads reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.money import TOTAL, percent_of, rounded_ratio


def ads_monthly(daily: DataFrame, grain: str, latest_name: bool = False) -> DataFrame:
    """Monthly sums and ratios per platform and ``campaign``, ``adset`` or ``ad``.

    The name shown is the lexically greatest one of the month, or with
    ``latest_name`` the one of the latest day. Ratios are NULL on a zero base.
    """
    entity, name = f"{grain}_id", f"{grain}_name"
    shown = F.max_by(name, "date") if latest_name else F.max(name)
    sums = daily.groupBy("platform", F.trunc("date", "month").alias("month"), entity).agg(
        shown.alias(name),
        F.sum("spend").cast(TOTAL).alias("spend"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("purchases").alias("purchases"),
        F.sum("purchase_value").cast(TOTAL).alias("revenue"),
    )
    c = F.col
    return sums.select(
        "platform",
        "month",
        entity,
        name,
        "spend",
        "impressions",
        "clicks",
        percent_of(c("clicks"), c("impressions")).alias("ctr_pct"),
        rounded_ratio(c("spend"), c("clicks")).alias("cpc"),
        "purchases",
        "revenue",
        rounded_ratio(c("revenue"), c("spend")).alias("roas"),
        rounded_ratio(c("spend"), c("purchases")).alias("cpa"),
    )


def campaign_monthly(campaign_daily: DataFrame) -> DataFrame:
    """Monthly campaign report."""
    return ads_monthly(campaign_daily, "campaign")


def adset_monthly(adset_daily: DataFrame, adset_meta: DataFrame) -> DataFrame:
    """Monthly ad-set report with the current targeting of each set."""
    meta = adset_meta.select("platform", "adset_id", "status", "targeting_type", "geo")
    return ads_monthly(adset_daily, "adset").join(meta, ["platform", "adset_id"], "left")


def ad_monthly(ad_daily: DataFrame, ad_meta: DataFrame) -> DataFrame:
    """Monthly ad report with the current creative of each ad."""
    meta = ad_meta.select("platform", "ad_id", "status", "creative_format", "is_dynamic")
    return ads_monthly(ad_daily, "ad").join(meta, ["platform", "ad_id"], "left")
