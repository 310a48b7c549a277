from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import customers as c

JULY = (date(2026, 7, 1), date(2026, 7, 31))
AS_OF = date(2026, 7, 31)


@pytest.fixture
def buyers(make, order):
    """Customers and their orders from (id, [order times], number_of_orders, amount_spent)."""

    def _buyers(rows):
        people, orders = [], []
        for cid, times, n, spent in rows:
            people.append(
                {
                    "customer_id": cid, "first_purchase_at": times[0], "last_order_at": times[-1],
                    "customer_since": times[0], "number_of_orders": n, "amount_spent": spent,
                }
            )
            orders += [(cid * 100 + i, t, cid) for i, t in enumerate(times)]
        return make("customers", people), order(orders)

    return _buyers


def segments(people, orders):
    return c.rfm_segments(c.rfm_scores(people, AS_OF), orders, *JULY).collect()


def test_members_are_the_buyers_of_the_range(buyers):
    people, orders = buyers(
        [(1, ["2026-07-10"], 1, "10"), (2, ["2026-07-20"], 1, "10"), (3, ["2026-06-20"], 1, "10")]
    )
    got = segments(people, orders)
    assert [(s.segment, s.customer_count, s.percentage) for s in got] == [("New Customers", 2, D("100.00"))]
    assert c.customer_summary(people, orders, *JULY).first().total_customers == 2


def test_range_uses_local_days(buyers):
    times = ["2026-07-01 02:00", "2026-07-01 04:00", "2026-08-01 03:30", "2026-08-01 04:00"]
    people, orders = buyers([(i, [t], 1, "10") for i, t in enumerate(times, 1)])
    assert sum(s.customer_count for s in segments(people, orders)) == 2


def test_scores_cover_all_customers(buyers):
    rows = [(i, ["2026-06-15"], 4, str(100 * i)) for i in range(1, 5)] + [(5, ["2026-07-15"], 4, "500")]
    assert [(s.segment, s.customer_count) for s in segments(*buyers(rows))] == [("Champions", 1)]


def test_no_members_no_segments(buyers):
    assert segments(*buyers([(1, ["2026-06-20"], 1, "10")])) == []


def test_null_spend_ranks_last(buyers):
    people, _ = buyers([(i, ["2026-07-10"], 1, None if i == 1 else str(i)) for i in range(1, 6)])
    scores = {r.customer_id: r.m_score for r in c.rfm_scores(people, AS_OF).collect()}
    assert scores == {2: 1, 3: 2, 4: 3, 5: 4, 1: 5}


def test_recency_and_frequency_edges(spark):
    days = [(d,) for d in (0, 90, 91, 180, 181, 365, 366, 730, 731)]
    got = spark.createDataFrame(days, "d int").select(c._recency_score(F.col("d"))).collect()
    assert [r[0] for r in got] == [5, 5, 4, 4, 3, 3, 2, 2, 1]
    got = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 10, 11)], "n int").select(c._frequency_score(F.col("n")))
    assert [r[0] for r in got.collect()] == [1, 2, 3, 4, 4, 5]


def test_customer_summary(buyers):
    people, orders = buyers(
        [
            (1, ["2026-05-01", "2026-07-10"], 2, "10.00"),
            (2, ["2026-07-02", "2026-07-20"], 2, None),
            (3, ["2026-07-20"], 1, "5.01"),
            (4, ["2026-06-20"], 1, "99.00"),
        ]
    )
    r = c.customer_summary(people, orders, *JULY).first()
    assert (r.total_customers, r.new_customers, r.returning_customers) == (3, 2, 1)
    assert r.average_ltv == D("7.50")  # 15.01 / 2 = 7.505, half-even
    assert r.repeat_purchase_rate == D("66.67")
    empty = c.customer_summary(people, orders, date(2020, 1, 1), date(2020, 1, 2)).first()
    assert (empty.total_customers, empty.average_ltv, empty.repeat_purchase_rate) == (0, D("0.00"), D("0.00"))


def test_top_customers(buyers):
    rows = [(i, ["2026-07-10 12:00"], 1, str(s)) for i, s in [(1, 50), (2, 70), (3, 70), (4, 0), (5, 10)]]
    people, _ = buyers(rows)
    people = people.withColumn("email", F.concat(F.lit("  Person"), "customer_id", F.lit("@Shop.com ")))
    top = c.top_customers(people, c.rfm_scores(people.filter("customer_id != 3"), AS_OF), 3, date(2026, 8, 1))
    got = sorted(top.collect(), key=lambda r: (-r.lifetime_value, r.customer_id))
    assert [r.customer_id for r in got] == [2, 3, 1]
    assert got[1].rfm_segment == "Others" and got[0].rfm_segment == "New Customers"
    assert got[0].email_masked == "pe***@shop.com"
    assert got[0].days_since_last_order == 22
    assert c.top_customers_concentration(top).first().top_lifetime_value == D("190.00")
    assert c.buyer_count(people).first()[0] == 5
    with pytest.raises(ValueError):
        c.top_customers(people, top, 51, AS_OF)


def test_segment_order_and_value_share(spark):
    df = spark.createDataFrame(
        [("Others", D("25.00")), ("Lost", D("25.00")), ("Loyal", D("20.00")), ("Champions", D("30.00"))],
        "segment string, total_lifetime_value decimal(22,2)",
    )
    assert [r.segment for r in c.order_segments(df).collect()] == ["Champions", "Loyal", "Lost", "Others"]
    assert c.rfm_top_value_share(df).first().top_value_share_pct == D("50.00")
