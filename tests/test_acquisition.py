from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from shopmetrics.functions.dates import month_span, whole_months
from shopmetrics.operators import acquisition as a

END = date(2026, 7, 1)


def people(make, rows):
    return make("customers", [{"customer_id": i, "first_purchase_at": t} for i, t in rows])


def trend(cust, orders, months=12):
    return {r.month: r for r in a.acquisition_trend(cust, orders, END, months).collect()}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kuala_Lumpur"])
def test_new_customers_by_local_month(spark, make, order, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    got = trend(people(make, [(1, "2026-07-01 02:00"), (2, "2026-07-01 04:00"), (3, "2026-07-01 14:00")]), order([]))
    assert (got["2026-06"].new_customers, got["2026-07"].new_customers) == (1, 2)
    assert len(got) == 12 and got["2025-08"].repeat_rate_percent == D("0.00")


def test_returning_is_by_month(make, order):
    cust = people(make, [(1, "2026-06-10"), (2, "2026-07-02")])
    orders = order([(1, "2026-06-10", 1), (2, "2026-07-05", 1), (3, "2026-07-02", 2), (4, "2026-07-20", 2)])
    july = trend(cust, orders)["2026-07"]
    assert (july.new_customers, july.returning_customers, july.repeat_rate_percent) == (1, 1, D("50.00"))


def test_first_purchase_without_orders_counts(make, order):
    cust = make("customers", [{"customer_id": 1, "first_purchase_at": "2026-07-02", "number_of_orders": 0}])
    assert trend(cust, order([]))["2026-07"].new_customers == 1


def test_trend_totals(make, order):
    cust = people(make, [(1, "2026-06-10"), (2, "2026-06-11"), (3, "2026-07-02")])
    orders = order([(1, "2026-07-05", 1), (2, "2026-07-05", 2)])
    t = a.acquisition_trend_totals(a.acquisition_trend(cust, orders, END, 12)).first()
    assert (t.total_new, t.total_returning, t.current_month_total) == (3, 2, 3)
    assert (t.mom_change_percent, t.current_repeat_rate) == (D("50.00"), D("66.67"))
    one = a.acquisition_trend_totals(a.acquisition_trend(cust, orders, END, 1)).first()
    assert one.mom_change_percent is None


def test_long_range(make, order):
    months, last = month_span(date(2017, 10, 3), date(2026, 7, 9))
    assert (months, last) == (106, END)
    assert len(trend(people(make, []), order([]), months)) == 106


def cohorts(cust, orders, n, periods, end=END):
    return a.cohort_retention(cust, orders, end, n, periods, END)


def cells(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.cohort_month, r.period_number)):
        out.setdefault(r.cohort_month, []).append(r.retention_pct)
    return out


def test_cohort_without_returners_is_listed(make, order):
    df = cohorts(people(make, [(1, "2026-06-10")]), order([(1, "2026-06-10", 1)]), 3, 2)
    assert {(r.cohort_month, r.cohort_size, r.returners) for r in df.collect()} == {(date(2026, 6, 1), 1, 0)}


def test_cohort_sizes_equal_new_customers(make, order):
    firsts = ["2026-05-01 02:00", "2026-05-10", "2026-06-01 03:00", "2026-06-15", "2026-07-01 05:00", "2026-07-20",
              "2026-04-30 12:00"]
    cust = people(make, [*enumerate(firsts, 1), (8, None)])
    df = cohorts(cust, order([]), 3, 2)
    sizes = {r.cohort_month.strftime("%Y-%m"): r.cohort_size for r in df.collect()}
    new = {m: r.new_customers for m, r in trend(cust, order([]), 3).items()}
    assert sizes == new and sum(new.values()) == 5


def test_retention_past_the_range(make, order):
    cust = people(make, [(1, "2026-05-10")])
    orders = order([(1, "2026-05-10", 1), (2, "2026-06-05", 1), (3, "2026-06-25", 1)])
    got = cells(cohorts(cust, orders, 1, 3, date(2026, 5, 1)))
    assert got == {date(2026, 5, 1): [100.0, 0.0, None]}


def test_incomplete_periods(make, order):
    cust = people(make, [(1, "2026-06-10"), (2, "2026-07-10")])
    got = cells(cohorts(cust, order([(1, "2026-07-05", 1)]), 2, 2))
    assert got == {date(2026, 6, 1): [100.0, None], date(2026, 7, 1): [None, None]}


def test_weighted_average_and_best(spark):
    rows = [
        (date(2026, 4, 1), 1, 1, 50.0), (date(2026, 5, 1), 3, 1, 10.0), (date(2026, 6, 1), 2, 1, 50.0),
        (date(2026, 4, 1), 1, 2, None),
    ]
    df = spark.createDataFrame(rows, "cohort_month date, cohort_size long, period_number int, retention_pct double")
    got = {r.period_number: r.weighted_retention_pct for r in a.cohort_weighted_average(df).collect()}
    assert got == {1: 30.0, 2: None}
    assert a.cohort_best_m1(df).first().cohort_month == date(2026, 4, 1)


def test_channel_quality(make, order):
    # Cohort: first purchase from 2026-01-02 to 2026-04-01 for 2026-07-01.
    base = {"amount_spent": "60.00", "last_order_at": "2026-06-01"}
    cust = make(
        "customers",
        [
            {"customer_id": 1, "first_purchase_at": "2026-02-01 12:00", "first_order_id": 1, **base},
            {"customer_id": 2, "first_purchase_at": "2026-02-01 12:00", "first_order_id": 2, **base},
            {"customer_id": 3, "first_purchase_at": "2026-02-01 12:00", "first_order_id": 3, "amount_spent": None,
             "last_order_at": "2026-01-01 12:00"},
            {"customer_id": 4, "first_purchase_at": "2026-05-01 12:00", "first_order_id": 4, **base},
        ],
    )
    orders = order(
        [
            (1, "2026-02-01 12:00", 1), (11, "2026-05-02 12:00", 1),  # exactly 90 days later
            (2, "2026-02-01 12:00", 2), (12, "2026-05-02 12:01", 2),  # a minute too late
            (3, "2026-02-01 12:00", 3),
        ]
    )
    attr = make("order_attribution", [
        {"order_id": 1, "traffic_channel": "Email"}, {"order_id": 2, "traffic_channel": "Email"},
    ])
    df = a.acquisition_channel_quality(cust, orders, attr, END)
    got = {r.channel: r for r in df.collect()}
    email, unknown = got["Email"], got["Unknown"]
    assert (email.new_customers, email.repeated_m3, email.repeat_by_m3_pct) == (2, 1, D("50.00"))
    assert (email.pct_of_total, email.avg_projected_12mo_value, email.hibernating_pct) == (D("66.70"), D("144.00"), D("0.00"))
    assert (unknown.avg_projected_12mo_value, unknown.hibernating_pct) == (D("0.00"), D("100.00"))
    t = a.acquisition_channel_quality_totals(df, END).first()
    assert (t.total_new_customers, t.top_channel, t.avg_repeat_by_m3_pct) == (3, "Email", D("33.30"))
    none = a.acquisition_channel_quality_totals(df.limit(0), END).first()
    assert (none.top_channel, none.avg_repeat_by_m3_pct) == ("N/A", D("0.00"))


def test_whole_months(spark):
    pairs = [("2026-04-30", "2026-01-31", 2), ("2026-04-30", "2026-01-30", 3), ("2026-01-01", "2025-12-31", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    later, earlier = F.col("a").cast("date"), F.col("b").cast("date")
    assert all(r[0] == r[1] for r in df.select(whole_months(later, earlier), "n").collect())
