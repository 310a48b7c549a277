from datetime import date
from decimal import Decimal as D

import pytest

from shopmetrics.operators import ledger, revenue
from shopmetrics.sources.stored_ledger import read_ledger, write_ledger


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def net(t):
    return ledger.net_sales_lines(t["order_line_items"], t["orders"], t["refund_line_items"])


def test_sale_books_on_the_local_day(autumn):
    got = rows(net(autumn).filter("order_id = 58"), "sku", "date_key")
    assert got == [("LAMP", date(2024, 10, 8))]  # protection lines are left out


def test_refund_of_an_excluded_line_is_ignored(autumn):
    assert net(autumn).filter("row_type = 'RETURN' AND line_item_id = 572").count() == 0


def test_refund_books_on_its_own_day(autumn):
    got = rows(net(autumn).filter("row_type = 'RETURN'"), "order_id", "date_key", "quantity", "amount")
    assert got == [
        (41, date(2024, 10, 11), -1, D("-12.25")),
        (57, date(2024, 10, 21), -2, D("-24.50")),
        (64, date(2024, 11, 12), -1, D("-145.90")),
    ]


def test_columns_and_signs(autumn):
    df = net(autumn)
    assert df.columns == ledger.LEDGER_COLUMNS
    for r in df.collect():
        assert (r.amount > 0 and r.quantity > 0) == (r.row_type == "SALE")


def test_split_refund_adds_up(make, order):
    lines = make(
        "order_line_items",
        [{"line_item_id": 10, "order_id": 1, "sku": "A", "title": "A", "quantity": 2, "discounted_unit_price": "40.00"}],
    )
    back = [
        {"id": i, "refund_id": i, "order_id": 1, "line_item_id": 10, "processed_at": f"2026-03-0{i}", "quantity": 1, "subtotal": "40.00"}
        for i in (5, 6)
    ]
    df = ledger.net_sales_lines(lines, order([(1, "2026-03-01 12:00")]), make("refund_line_items", back))
    assert df.agg({"amount": "sum"}).first()[0] == 0


def test_null_sku_is_a_product(make, order):
    lines = make(
        "order_line_items",
        [{"line_item_id": 1, "order_id": 1, "quantity": 1, "discounted_unit_price": "5.00"}],
    )
    df = ledger.net_sales_lines(lines, order([(1, "2026-03-01")]), make("refund_line_items", []))
    assert df.count() == 1


def test_empty_input(make):
    df = ledger.net_sales_lines(make("order_line_items", []), make("orders", []), make("refund_line_items", []))
    assert df.count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kuala_Lumpur"])
def test_session_zone_does_not_matter(spark, autumn, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    got = rows(net(autumn).filter("order_id IN (57, 58)"), "row_type", "date_key", "amount")
    assert got == [
        ("RETURN", date(2024, 10, 21), D("-24.50")),
        ("SALE", date(2024, 10, 8), D("36.75")),
        ("SALE", date(2024, 10, 8), D("59.00")),
    ]


def test_reconciliation_isolates_refunds_without_lines(make):
    head = [
        {"refund_id": i, "order_id": 1, "processed_at": "2026-01-11 03:00", "total_refunded": t}
        for i, t in [(1, "10.00"), (2, "7.00"), (3, "0.00")]
    ]
    back = [
        {"id": i, "refund_id": r, "order_id": 1, "line_item_id": i, "processed_at": "2026-01-11", "quantity": 1, "subtotal": s}
        for i, r, s in [(1, 1, "6.00"), (2, 1, "3.00"), (3, 3, "4.00")]
    ]
    got = rows(
        ledger.refund_reconciliation(make("refunds", head), make("refund_line_items", back)),
        "refund_id", "processed_date", "allocated_subtotal", "refund_line_count", "unallocated_refund",
    )
    assert got == [
        (1, date(2026, 1, 10), D("9.00"), 2, D("0.00")),
        (2, date(2026, 1, 10), D("0.00"), 0, D("7.00")),
        (3, date(2026, 1, 10), D("4.00"), 1, D("0.00")),
    ]


def test_daily_conversion_without_orders_or_sessions(make, order):
    sessions = [
        {"session_date": d, "referrer_source": s, "sessions": n}
        for d, s, n in [("2026-01-10", "search", 2), ("2026-01-10", "email", 1), ("2026-01-11", "search", 0)]
    ]
    got = rows(
        ledger.daily_conversion(make("sessions_daily", sessions), order([(1, "2026-01-11 03:00", 1, "9.50")])),
        "order_date", "sessions", "orders", "net_revenue", "conversion_pct",
    )
    assert got == [
        (date(2026, 1, 10), 3, 1, D("9.50"), D("33.33")),
        (date(2026, 1, 11), 0, 0, None, None),
    ]


def test_stored_ledger(spark, autumn, tmp_path):
    whole, path = ledger.ledger_of(autumn), str(tmp_path / "ledger")
    write_ledger(whole, path)
    stored = read_ledger(spark, path)
    assert stored.count() == whole.count()
    for d0, d1 in [(date(2024, 10, 1), date(2024, 10, 31)), (date(2024, 10, 8), date(2024, 11, 5)), (date(2020, 1, 1), date(2020, 1, 2))]:
        assert revenue.revenue_summary(stored, d0, d1).collect() == revenue.revenue_summary(whole, d0, d1).collect()
    by_month = ["month_number", "current_year_revenue", "previous_year_revenue"]
    assert rows(revenue.yearly_comparison_months(stored), *by_month) == rows(revenue.yearly_comparison_months(whole), *by_month)
    assert revenue.yearly_comparison_ytd(stored).collect() == revenue.yearly_comparison_ytd(whole).collect()
    october = ledger.booked_in(stored, [(date(2024, 10, 2), date(2024, 10, 9))])
    plan = october._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan
    assert {f.split("month_key=")[1][:10] for f in october.inputFiles()} >= {"2024-10-01"}


def test_stored_ledger_without_rows(spark, make, tmp_path):
    empty = ledger.sales_ledger(make("order_line_items", []), make("orders", []), make("refund_line_items", []))
    write_ledger(empty, str(tmp_path / "empty"))
    assert revenue.yearly_comparison_ytd(read_ledger(spark, str(tmp_path / "empty")), date(2026, 7, 1)).first().current_year == 2026
