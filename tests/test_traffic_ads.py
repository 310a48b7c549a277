from datetime import date
from decimal import Decimal as D

from shopmetrics.operators import ads, traffic


def test_channel_conversion_is_driven_by_sessions(make, order):
    visits = make("channel_daily", [
        {"session_date": d, "channel_group": g, "source": s, "sessions": n}
        for d, g, s, n in [
            ("2026-01-05", "Paid Shopping", "a", 10), ("2026-01-06", "Cross-network", "b", 20),
            ("2026-01-07", "Paid Search", "c", 0), ("2026-02-01", "Email", "d", 4),
        ]
    ])
    orders = order([(1, "2026-01-05 15:00", 1, "10.40"), (2, "2026-02-01 03:00", 1, "11.20"), (3, "2026-01-05 15:00", 1, "9")])
    attr = make("order_attribution", [
        {"order_id": 1, "traffic_channel": "Paid"}, {"order_id": 2, "traffic_source": "Bing", "traffic_channel": "Paid Search"},
        {"order_id": 3, "traffic_channel": "Email"},
    ])
    got = {(r.month, r.channel): r for r in traffic.monthly_channel_conversion(visits, orders, attr).collect()}
    paid = got[date(2026, 1, 1), "Paid Search"]
    # both orders fall into January in New York; the average divides the rounded revenue: 22 / 2
    assert (paid.sessions, paid.orders, paid.net_revenue, paid.aov, paid.conversion_pct) == (
        30, 2, D("22.00"), D("11.00"), D("6.67"),
    )
    email = got[date(2026, 2, 1), "Email"]
    assert (email.orders, email.net_revenue, email.aov, email.conversion_pct) == (0, None, None, D("0.00"))
    assert len(got) == 2  # January e-mail orders had no sessions


def test_campaign_ratios(make):
    rows = [
        {"date": d, "platform": "meta", "campaign_id": c, "campaign_name": n, "spend": s, "impressions": i, "clicks": k,
         "purchases": p, "purchase_value": v}
        for d, c, n, s, i, k, p, v in [
            ("2026-01-05", "1", "zeta", "10.00", 200, 3, 1, "25.00"), ("2026-01-06", "1", "alpha", "5.00", 100, 0, 0, "0.00"),
            ("2026-01-06", "2", "b", "0.00", 0, 0, 0, "0.00"),
        ]
    ]
    daily = make("campaign_daily", rows)
    one, two = sorted(ads.campaign_monthly(daily).collect(), key=lambda r: r.campaign_id)
    assert (one.campaign_name, one.ctr_pct, one.cpc, one.roas, one.cpa) == ("zeta", D("1.00"), D("5.00"), D("1.67"), D("15.00"))
    assert (two.ctr_pct, two.cpc, two.roas, two.cpa) == (None, None, None, None)
    latest = ads.ads_monthly(daily, "campaign", latest_name=True).filter("campaign_id = '1'").first()
    assert latest.campaign_name == "alpha"
