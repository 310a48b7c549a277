from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from shopmetrics.functions.money import pct_change_nonpositive, pct_change_zero
from shopmetrics.operators import ledger, products, revenue

JAN = (date(2026, 1, 1), date(2026, 1, 31))
OCT = (date(2024, 10, 1), date(2024, 10, 31))


@pytest.fixture
def book(autumn):
    return ledger.ledger_of(autumn)


@pytest.fixture
def sold(make, order):
    """Ledger of single-line orders given as (order_id, created_at, title, amount)."""

    def _sold(rows):
        lines = [
            {"line_item_id": i, "order_id": i, "sku": t, "title": t, "quantity": 1, "discounted_unit_price": a}
            for i, _, t, a in rows
        ]
        orders = order([(i, at) for i, at, _, _ in rows])
        return ledger.sales_ledger(make("order_line_items", lines), orders, make("refund_line_items", []))

    return _sold


def test_month_summary(book):
    r = revenue.revenue_summary(book, *OCT).first()
    assert (r.total_sales, r.total_returns, r.net_sales) == (D("281.65"), D("36.75"), D("244.90"))
    assert (r.total_orders, r.total_qty, r.average_order_value) == (4, 8, D("61.22"))


def test_month_changes(book):
    r = revenue.revenue_summary(book, *OCT).first()
    assert r.net_sales_change_percent == D("206.12")
    assert r.total_sales_change_percent == D("252.06")
    assert r.orders_change_percent == D("100.00")
    assert r.total_qty_change_percent == D("60.00")
    assert r.aov_change_percent == D("53.06")
    assert r.total_returns_change_percent is None


def test_one_day_and_next_month(book):
    r = revenue.revenue_summary(book, date(2024, 10, 8), date(2024, 10, 8)).first()
    assert (r.net_sales, r.total_orders) == (D("95.75"), 2)
    r = revenue.revenue_summary(book, date(2024, 11, 1), date(2024, 11, 30)).first()
    assert (r.total_returns, r.net_sales) == (D("145.90"), D("-86.90"))


def test_summary_from_plain_ledger_columns(autumn):
    plain = ledger.net_sales_lines(autumn["order_line_items"], autumn["orders"], autumn["refund_line_items"])
    assert revenue.revenue_summary(plain, *OCT).first().net_sales == D("244.90")


def test_sparklines(book):
    got = sorted(tuple(r) for r in revenue.revenue_sparklines(book, *OCT).select(
        "date", "net_sales", "total_orders", "average_order_value").collect())
    assert got == [
        (date(2024, 10, 8), D("95.75"), 2, D("47.88")),
        (date(2024, 10, 11), D("-12.25"), 0, D("0.00")),
        (date(2024, 10, 21), D("-24.50"), 0, D("0.00")),
        (date(2024, 10, 27), D("40.00"), 1, D("40.00")),
        (date(2024, 10, 30), D("145.90"), 1, D("145.90")),
    ]


def test_empty_ledger(sold):
    r = revenue.revenue_summary(sold([]), *JAN).first()
    assert (r.net_sales, r.total_orders, r.average_order_value) == (D("0.00"), 0, D("0.00"))
    assert r.net_sales_change_percent is None
    assert revenue.revenue_trend(sold([]), *JAN, "month").count() == 0
    t = revenue.revenue_trend_totals(revenue.revenue_trend(sold([]), *JAN, "day")).first()
    assert (t.total_points, t.current_total_net_sales) == (0, D("0.00"))
    months = revenue.yearly_comparison_months(sold([])).collect()
    assert len(months) == 12 and {m.current_year_revenue for m in months} == {D("0.00")}
    assert revenue.yearly_comparison_ytd(sold([]), date(2026, 7, 1)).first().current_year == 2026


def test_exact_decimals(sold):
    r = revenue.revenue_summary(sold([(1, "2026-01-05", "A", "0.10"), (2, "2026-01-05", "A", "0.20")]), *JAN).first()
    assert r.net_sales == D("0.30")


def test_monthly_trend_equals_summary(book):
    p = revenue.revenue_trend(book, *OCT, "month").collect()
    assert [(x.date, x.current_net_sales, x.current_orders) for x in p] == [(date(2024, 10, 1), D("244.90"), 4)]


def test_trend_against_last_year(sold):
    led = sold([(1, "2025-01-10 15:00", "A", "100.00"), (2, "2026-01-10 15:00", "A", "150.00")])
    p = revenue.revenue_trend(led, *JAN, "day").first()
    assert (p.previous_net_sales, p.previous_orders, p.net_sales_change_percent) == (D("100.00"), 1, D("50.00"))


def test_trend_leap_day_and_overlapping_years(sold):
    led = sold(
        [
            (1, "2026-03-05 15:00", "A", "10.00"),
            (2, "2027-03-05 15:00", "A", "20.00"),
            (3, "2028-03-05 15:00", "A", "40.00"),
            (4, "2028-02-29 15:00", "A", "5.00"),
            (5, "2027-02-28 15:00", "A", "7.00"),
        ]
    )
    got = {r.date: r.previous_net_sales for r in revenue.revenue_trend(led, date(2027, 1, 1), date(2028, 12, 31)).collect()}
    # The earlier range covers 2026 and 2027, and the later of the two years counts.
    assert got[date(2027, 3, 5)] == D("20.00")
    assert got[date(2028, 3, 5)] == D("20.00")
    assert got[date(2028, 2, 29)] == D("0.00")


def test_weekly_trend_alignment(sold):
    led = sold([(1, "2025-01-08 15:00", "A", "10.00"), (2, "2026-01-07 15:00", "A", "30.00")])
    span = (date(2026, 1, 1), date(2026, 1, 31))
    assert revenue.revenue_trend(led, *span, "week").first().previous_net_sales == D("0.00")
    p = revenue.revenue_trend(led, *span, "week", align="ordinal").first()
    assert (p.date, p.previous_net_sales) == (date(2026, 1, 5), D("10.00"))


def test_bad_arguments(book):
    with pytest.raises(ValueError):
        revenue.revenue_summary(book, JAN[1], JAN[0])
    with pytest.raises(ValueError):
        revenue.revenue_trend(book, *JAN, "year")


@pytest.mark.parametrize(
    ("cur", "prev", "want"),
    [(150, 100, "50.00"), (50, 100, "-50.00"), (100, 100, "0.00"), (10, 0, None), (0, 0, None), (1, 3, "-66.67")],
)
def test_change(spark, cur, prev, want):
    r = spark.range(1).select(
        pct_change_zero(F.lit(cur), F.lit(prev)).alias("a"), pct_change_nonpositive(F.lit(cur), F.lit(-prev)).alias("b")
    ).first()
    assert r.a == (None if want is None else D(want))
    assert r.b is None


CHANNELS = [(600, "Paid Social"), (300, "Organic Search"), (100, "Direct")]


def channels(make, order, amounts, **kw):
    orders = order([(i, "2026-01-10 15:00", 1, str(a)) for i, (a, _) in enumerate(amounts)])
    attr = make(
        "order_attribution",
        [{"order_id": i, "traffic_channel": c} for i, (_, c) in enumerate(amounts) if c is not None],
    )
    rows = revenue.revenue_by_channel(orders, attr, *JAN, **kw).collect()
    return sorted(rows, key=lambda r: -r.revenue)


def test_channel_shares(make, order):
    got = channels(make, order, [(400, "Paid Social"), (200, "Paid Social"), *CHANNELS[1:]])
    assert [(r.channel, r.percentage) for r in got] == [
        ("Paid Social", D("60.00")), ("Organic Search", D("30.00")), ("Direct", D("10.00")),
    ]
    assert {(r.total_revenue, r.total_orders) for r in got} == {(D("1000.00"), 4)}


def test_top_four_and_other(make, order):
    amounts = [(600, "Ch1"), (500, "Ch2"), (400, "Ch3"), (300, "Ch4"), (150, "Ch5"), (50, "Ch6")]
    assert [(r.channel, r.revenue) for r in channels(make, order, amounts)][-1] == ("Other", D("200.00"))
    named = [(600, "Ch1"), (500, "Other"), (400, "Ch3"), (300, "Ch4"), (150, "Ch5")]
    assert ("Other", D("650.00")) in [(r.channel, r.revenue) for r in channels(make, order, named)]


def test_limit_keeps_totals(make, order):
    got = channels(make, order, CHANNELS, limit=2)
    assert len(got) == 2
    assert (got[0].total_revenue, got[0].percentage) == (D("1000.00"), D("60.00"))


def test_missing_attribution(make, order):
    assert [r.channel for r in channels(make, order, [(10, None)])] == ["UNKNOWN"]


def test_negative_total_has_zero_shares(make, order):
    assert {r.percentage for r in channels(make, order, [(-10, "A"), (5, "B")])} == {D("0.00")}


def test_yearly_comparison(sold):
    led = sold(
        [
            (1, "2025-02-10 15:00", "A", "10.00"),
            (2, "2025-09-10 15:00", "A", "90.00"),
            (3, "2026-02-10 15:00", "A", "15.00"),
            (4, "2024-02-10 15:00", "A", "70.00"),
        ]
    )
    months = {r.month: r for r in revenue.yearly_comparison_months(led).collect()}
    assert (months["Feb"].current_year_revenue, months["Feb"].previous_year_revenue) == (D("15.00"), D("10.00"))
    assert months["Sep"].previous_year_revenue == D("90.00")
    y = revenue.yearly_comparison_ytd(led).first()
    assert (y.current_year, y.ytd_end_date) == (2026, date(2026, 2, 10))
    assert (y.current_year_total, y.previous_year_total, y.yoy_change_percent) == (D("15.00"), D("10.00"), D("50.00"))


def test_top_products(sold):
    led = sold(
        [
            (1, "2026-01-10 15:00", "A", "50.00"),
            (2, "2026-01-11 15:00", "B", "80.00"),
            (3, "2025-12-20 15:00", "B", "40.00"),
            (4, "2025-12-20 15:00", None, "1.00"),
            (5, "2026-01-12 15:00", None, "2.00"),
            (6, "2025-12-20 15:00", "C", "9.00"),
        ]
    )
    df = products.top_products(led, *JAN)
    got = sorted(tuple(r) for r in df.select("rank", "product_name", "revenue", "previous_revenue", "revenue_change_percent").collect())
    assert got == [
        (1, "B", D("80.00"), D("40.00"), D("100.00")),
        (2, "A", D("50.00"), D("0.00"), None),
        (3, None, D("2.00"), D("0.00"), None),
    ]
    assert products.product_count(df).first()[0] == 3
