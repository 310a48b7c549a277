from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shopmetrics.functions import bands, channels, dates, draws, text


def one(spark, col):
    return spark.range(1).select(col).first()[0]


@pytest.mark.parametrize(
    ("email", "want"),
    [
        (None, "(no email)"), ("", "(no email)"), ("  ", "***"), ("nobody", "***"), ("ab@x.com", "***@x.com"),
        ("abc@x.com", "ab***@x.com"), ("\tJane.Doe@X.com\n", "ja***@x.com"), ("abc@x@y", "ab***@x@y"),
        ("@x.com", "***@x.com"), ("abc@", "ab***@"),
    ],
)
def test_mask_email(spark, email, want):
    assert one(spark, text.mask_email(F.lit(email).cast("string"))) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, None), ("https://a.com", "/"), ("https://a.com?x=1", "/"), ("https://a.com/about?x=1#y", "/about"),
        ("/cart#top", "/cart"),
    ],
)
def test_plain_paths(spark, url, want):
    assert one(spark, draws.anonymize_path(F.lit(url).cast("string"), "s")) == want


def test_slugs_are_opaque_and_stable(spark):
    a = one(spark, draws.anonymize_path(F.lit("https://a.com/products/blue-hat?v=1"), "s"))
    b = one(spark, draws.anonymize_path(F.lit("http://b.org/products/blue-hat"), "s"))
    assert a == b and a.startswith("/products/item-") and "hat" not in a
    c = one(spark, draws.anonymize_path(F.lit("/collections/x"), "s"))
    assert c.startswith("/collections/collection-") and len(c.rsplit("-", 1)[1]) == 3


def test_draws_depend_on_salt_and_are_uniform(spark):
    df = spark.range(20000).select(
        draws.salted_uniform(F.col("id").cast("string"), "a").alias("a"),
        draws.salted_uniform(F.col("id").cast("string"), "b").alias("b"),
        draws.salted_hash(F.col("id").cast("string"), "a").alias("h"),
    )
    r = df.agg(
        F.avg("a").alias("m"), F.min("a").alias("lo"), F.max("a").alias("hi"), F.corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("c"),
        F.min("h").alias("h"),
    ).first()
    assert abs(float(r.m) - 0.5) < 0.01 and r.lo >= 0 and r.hi < 1 and abs(r.c) < 0.05 and r.h >= 0


def test_channel_vocabulary(spark):
    rows = [
        ("Paid Social", "x", "Paid Social"), ("Paid Other", None, "Paid Search"), ("Email", None, "Email"),
        ("Text", None, "SMS"), ("Seo", "x", "Organic Search"), (None, "DuckDuckGo", "Organic Search"),
        ("Referral", "Direct", "Direct"), (None, "Instagram", "Organic Social"), ("Affiliate", "p", "Unassigned"),
        (None, None, "Unassigned"),
    ]
    df = spark.createDataFrame(rows, "c string, s string, want string")
    got = df.select(channels.normalize_channel(F.col("c"), F.col("s")), "want").collect()
    assert all(r[0] == r[1] for r in got)
    missing = channels.normalize_channel(F.lit(None), F.lit(None), F.lit(True), "Unknown")
    assert one(spark, missing) == "Unknown"
    assert one(spark, channels.fold_channel_group(F.lit("Cross-network"))) == "Paid Search"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kuala_Lumpur"])
def test_day_range_equals_day_filter(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    d0, d1 = date(2026, 3, 7), date(2026, 3, 9)  # the clock changes on 8 March
    df = spark.range(0, 24 * 8).select(
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2026-03-05").cast("timestamp_ntz")).alias("t")
    )
    fast = df.filter(dates.business_day_range("t", d0, d1))
    slow = df.filter(dates.business_date("t").between(F.lit(d0), F.lit(d1)))
    assert fast.count() == slow.count() == 71
    assert fast.exceptAll(slow).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kuala_Lumpur"])
def test_zoned_instants(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    ts = F.timestamp_seconds(F.lit(1768102200))  # 2026-01-11 03:30 UTC
    assert one(spark, dates.instant_to_utc(ts)) == datetime(2026, 1, 11, 3, 30)
    assert one(spark, dates.business_date(dates.instant_to_utc(ts))) == date(2026, 1, 10)


def test_period_arithmetic():
    assert dates.previous_period(date(2026, 1, 1), date(2026, 1, 31)) == (date(2025, 12, 1), date(2025, 12, 31))
    assert dates.previous_year(date(2028, 2, 29), date(2028, 3, 1)) == (date(2027, 2, 28), date(2027, 3, 1))
    assert dates.month_window(date(2026, 7, 1), 3) == (date(2026, 5, 1), date(2026, 7, 31))
    with pytest.raises(ValueError):
        dates.check_range(date(2026, 1, 1), date(2028, 1, 2), 730)


def test_bands(spark):
    rows = [(0, "Today"), (1, "Yesterday"), (29, "29d ago"), (60, "2mo ago"), (365, "1.0yr ago"), (900, "2.5yr ago")]
    df = spark.createDataFrame(rows, "d int, want string").select(bands.recency_label(F.col("d")), "want")
    assert all(r[0] == r[1] for r in df.collect())
    df = spark.createDataFrame([(19.9,), (20.0,), (35.0,), (None,)], "p double")
    out = bands.severity_bands(df, "p", [(35, "red"), (20, "yellow")], "green", "band")
    assert [r.band for r in out.collect()] == ["green", "yellow", "red", None]
