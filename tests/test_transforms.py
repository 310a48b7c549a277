"""Anonymisation, perturbation and their checks on the smallest test dataset."""

import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import perturb, privacy, quality
from shopmetrics.sources.lazy import LazyTables
from shopmetrics.sources.star import StarTables

STAR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(STAR), reason="needs the test dataset")
K = D("0.68")


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """The canonical tables written once, as a loaded dataset would be."""
    from shopmetrics.sources.tables import load_tables, write_table

    path = str(tmp_path_factory.mktemp("canonical"))
    names = [
        "customers", "orders", "order_attribution", "order_discounts", "order_line_items", "refund_line_items",
        "refunds", "line_item_discount_allocations", "reviews", "campaign_daily", "adset_daily", "ad_daily",
        "adset_meta", "ad_meta", "landing_pages_daily",
    ]
    t = StarTables(spark, STAR)
    for n in names:
        write_table(t[n], n, path)
    return load_tables(spark, path, names)


def failed(checks):
    return sorted(r.check_name for r in checks.filter("NOT ok").collect())


def test_anonymize(star):
    out = privacy.anonymize(star, K, "salt", "facebook")
    assert failed(privacy.anonymize_checks(star, out, K)) == []
    for name in ("orders", "order_line_items", "reviews", "ad_daily"):
        assert out[name].columns == star[name].columns and out[name].count() == star[name].count()
    assert quality.term_scan({n: out[n] for n in ("order_attribution",)}, "utm-|agent/").count() == 0
    hosts = out["order_attribution"].filter("referrer_url LIKE '%facebook%' OR landing_page LIKE '%http%'")
    assert hosts.count() == 0
    ads = out["ad_daily"].select("campaign_id").distinct().join(
        out["campaign_daily"].select("campaign_id").distinct(), "campaign_id", "left_anti"
    )
    assert ads.count() == 0  # the same campaign has the same pseudonym everywhere
    lines = out["order_line_items"].join(
        star["order_line_items"].selectExpr("line_item_id", "sku AS real"), "line_item_id"
    )
    assert lines.filter("real = 'x-redo' AND sku != 'x-redo'").count() == 0
    assert lines.filter("real LIKE 'SKU-%' AND sku LIKE 'SKU-%'").count() == 0
    with pytest.raises(ValueError):
        privacy.anonymize(star, D("9"), "salt")


def test_anonymize_checks_find_problems(star):
    broken = LazyTables({"refunds": lambda: star["refunds"].limit(5)}, privacy.anonymize(star, K, "salt"))
    assert failed(privacy.anonymize_checks(star, broken, K)) == ["refunds"]
    untouched = failed(privacy.anonymize_checks(star, star, K))
    assert untouched == sorted([*privacy.MONEY_CHECKS, "customer_emails", "reviewer_emails"])


def test_mappings_are_unique(star):
    for kind, df in privacy.build_mappings(star, "salt").items():
        alias = [c for c in df.columns if c not in ("orig", "n", "new_handle")][0]
        assert df.count() == df.select("orig").distinct().count() == df.select(alias).distinct().count(), kind


def test_perturb(star):
    out = perturb.perturb(star, "salt")
    assert failed(perturb.perturb_checks(star, out)) == []
    kept = out["orders"].count() / star["orders"].count()
    assert 0.65 < kept < 0.97
    assert sorted(perturb.perturb(star, "salt")["orders"].select("order_id").collect()) == sorted(
        out["orders"].select("order_id").collect()
    )
    for child, parent, keys, parent_keys in [
        ("order_line_items", "orders", ["order_id"], None), ("refunds", "orders", ["order_id"], None),
        ("orders", "customers", ["customer_id"], None),
        ("line_item_discount_allocations", "order_line_items", ["line_item_id"], None),
    ]:
        assert quality.check_references(out[child], out[parent], keys, parent_keys).count() == 0
    prices = out["order_line_items"].filter("sku LIKE 'SKU-%'").selectExpr("original_unit_price * 100 % 100 AS c")
    assert {int(r.c) for r in prices.distinct().collect()} == {99}
    spent = out["customers"].join(
        out["orders"].groupBy("customer_id").agg(F.sum("net_payment").alias("s")), "customer_id"
    )
    assert spent.filter("amount_spent != s").count() == 0
    names = sorted(int(r[0][1:]) for r in out["orders"].select("order_name").collect())
    assert names == list(range(10001, 10001 + len(names)))


def test_perturb_checks_find_problems(star):
    same = failed(perturb.perturb_checks(star, star))
    assert "orders_changed" in same
    lines = star["order_line_items"].withColumn("quantity", F.lit(0))
    bad = failed(perturb.perturb_checks(star, LazyTables({"order_line_items": lambda: lines}, star)))
    assert {"invalid_quantities", "refunds_over_line", "multi_unit_share"} <= set(bad)


def test_perturb_quantity_holds_money(star):
    # Single units make up 2 % of the star's lines, so the 5 % growth rule needs lines that are mostly single.
    lines = star["order_line_items"].withColumns(
        {
            "quantity": F.when(F.col("returned_quantity") > 0, F.col("quantity")).otherwise(1),
            "current_quantity": F.when(F.col("returned_quantity") > 0, 0).otherwise(1),
        }
    )
    before = LazyTables({"order_line_items": lambda: lines}, star)
    new = perturb.perturb_quantity(lines, star["orders"], star["refund_line_items"], "salt")
    after = LazyTables({"order_line_items": lambda: new}, star)
    assert failed(perturb.perturb_quantity_checks(before, after)) in ([], ["units_grew"])
    grown = new.join(lines.selectExpr("line_item_id", "quantity AS old"), "line_item_id").filter("quantity != old")
    assert grown.count() > 100 and grown.filter("old != 1 OR quantity NOT IN (2, 3, 4)").count() == 0
    assert failed(perturb.perturb_quantity_checks(before, before)) == ["units_grew"]


def test_refund_cash_rules(make, spark):
    refunds = make(
        "refunds",
        [
            {"refund_id": i, "order_id": 1, "processed_at": "2026-01-01", "total_refunded": t}
            for i, t in [(1, "10.00"), (2, "0.00"), (3, "8.00")]
        ],
    )

    lines = make(
        "refund_line_items",
        [{"id": i, "refund_id": i, "order_id": 1, "line_item_id": i, "processed_at": "2026-01-01", "quantity": 1, "subtotal": "5.00"} for i in (1, 2)],
    ).withColumn("old_subtotal", F.lit(D("4.00")))

    ratios = spark.createDataFrame([(1, D("1.5"))], "order_id long, rho decimal(20,16)")
    out = perturb.rederive_refunds(refunds, lines, ratios)
    got = {r.refund_id: r.total_refunded for r in out.collect()}
    # by its lines, no cash stays no cash, by the order where no line is named
    assert got == {1: D("12.50"), 2: D("0.00"), 3: D("12.00")}


def test_allocations_without_a_line_stay(spark, make):
    allocations = make(
        "line_item_discount_allocations",
        [{"id": i, "line_item_id": i, "order_discount_id": 1, "allocated_amount": "3.00"} for i in (1, 2)],
    )
    changes = spark.createDataFrame([(1, D("2.00"), D("3.00"), 2)], "line_item_id long, price_from decimal(12,2), price_to decimal(12,2), times int")
    got = {r.id: r.allocated_amount for r in perturb.perturb_allocations(allocations, changes).collect()}
    assert got == {1: D("9.00"), 2: D("3.00")}
