"""Fused checks: totals against joins, and how often each table is read."""

import random
import re
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import perturb, privacy, quality, revenue
from shopmetrics.operators.ledger import LEDGER_COLUMNS, ledger_of, net_sales_lines
from shopmetrics.operators.totals import SALES_MEASURES, sales_totals
from shopmetrics.sources import tables as io
from shopmetrics.sources.schema import REFERENCES
from shopmetrics.sources.star import StarTables

STAR = "/root/testdata/sf0.001"
SOLD = ["orders", "order_line_items", "refund_line_items"]
NAMES = [*SOLD, "refunds", "campaign_daily", "reviews", "customers", "order_attribution", "order_discounts", "line_item_discount_allocations"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shop"))
    star = StarTables(spark, STAR)
    for name in NAMES:
        io.write_table(star[name], name, path)
    return io.load_tables(spark, path, NAMES)


@pytest.fixture(scope="module")
def copied(spark, stored, tmp_path_factory):
    """The same tables in other files, so that Spark doesn't share their scans."""
    path = str(tmp_path_factory.mktemp("copy"))
    for name in NAMES:
        io.write_table(stored[name], name, path)
    return io.load_tables(spark, path, NAMES)


@pytest.fixture
def static(spark):
    """Plans that are fixed before the run and print every node once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def scans(df):
    """Scans per table in the executed plan, subqueries included; what is reused is not read again."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"Location: InMemoryFileIndex[^\n]*?/(\w+)(?:\.parquet)?\]", plan))


@pytest.fixture
def odd(make, order):
    """Repeated keys, orphans, nulls and refunds over their line."""
    rng = random.Random(4)
    orders = order([(k, "2026-01-01", 1, k) for k in range(30)] + [(3, "2026-01-02", 1, 5)])
    lines = [
        {
            "line_item_id": rng.randint(0, 60), "order_id": rng.randint(0, 34), "sku": rng.choice(["A", None, "x-redo", "ROUTEINS-1"]),
            "quantity": rng.randint(0, 4), "current_quantity": rng.choice([None, 0, 1, 5]),
            "original_unit_price": rng.choice(["9.00", "2.00", None]), "discounted_unit_price": rng.choice(["5.00", "-1.00", None]),
        }
        for _ in range(120)
    ]
    keys = [(r["order_id"], r["line_item_id"]) for r in lines] + [(1, 999), (77, 1)]
    back = []
    for k in range(150):
        o, i = rng.choice(keys)
        row = {"id": k, "refund_id": k, "order_id": o, "line_item_id": i, "quantity": rng.randint(0, 5), "subtotal": "3.50"}
        back.append({**row, "processed_at": "2026-01-03"})
    return {"orders": orders, "order_line_items": make("order_line_items", lines), "refund_line_items": make("refund_line_items", back)}


def test_totals_equal_joins(odd):
    got = sales_totals(odd, SALES_MEASURES).first().asDict()
    lines, refunds, orders = odd["order_line_items"], odd["refund_line_items"], odd["orders"]
    assert got["net_sales"] == ledger_of(odd).agg(F.sum("amount")).first()[0]
    sold = lines.select("order_id", "line_item_id", F.col("quantity").alias("sold"))
    assert got["refunds_over_line"] == refunds.join(sold, ["order_id", "line_item_id"]).filter("quantity > sold").count()
    assert got["invalid_quantities"] == lines.filter("quantity < 1 OR current_quantity > quantity").count()
    o, d = "original_unit_price", "discounted_unit_price"
    assert got["inconsistent_prices"] == lines.filter(f"{o} < 0 OR {d} < 0 OR {d} > {o}").count()
    assert (got["line_items"], got["orders"]) == (lines.count(), orders.count())
    assert got["units"] == lines.agg(F.sum("quantity")).first()[0]
    assert got["net_payment"] == orders.agg(F.sum("net_payment")).first()[0]


def test_net_sales_lines_equal_the_ledger(odd):
    lost = F.expr("IF(order_id % 7 = 4, NULL, line_item_id)")
    lines, back = odd["order_line_items"], odd["refund_line_items"]
    named = {c: F.expr(f"IF(line_item_id % 4 = 0, NULL, concat('{c} ', quantity))") for c in ("title", "season_code")}
    again = lines.filter("order_id % 3 = 0").withColumns({"quantity": F.lit(9)})
    lines = lines.unionByName(again).unionByName(again).withColumns(named).withColumn("line_item_id", lost)
    back = back.withColumn("line_item_id", lost).withColumn("processed_at", F.expr("IF(quantity = 2, NULL, processed_at)"))
    got = net_sales_lines(lines, odd["orders"], back)
    want = ledger_of({"order_line_items": lines, "orders": odd["orders"], "refund_line_items": back}).select(*LEDGER_COLUMNS)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    # The case holds lines of one key with several refunds, refunds of several lines, and lines without an id.
    returned = Counter((r.order_id, r.line_item_id) for r in want.collect() if r.row_type == "RETURN")
    sold = Counter((r.order_id, r.line_item_id) for r in want.collect() if r.row_type == "SALE")
    assert any(n > sold[k] > 1 for k, n in returned.items()) and any(k[1] is None for k in sold)


def test_net_sales_lines_move_each_line_once_by_order(spark, static):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = StarTables(spark, STAR)
        df = net_sales_lines(star["order_line_items"], star["orders"], star["refund_line_items"])
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert scans(df)["lineitem"] == 2  # the lines, and the refunded ones that the star derives from them
    # Lines to their parts, parts, lines with refunds by order, orders.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 4


def test_totals_of_nothing(odd):
    none = {n: df.limit(0) for n, df in odd.items()}
    got = sales_totals(none, SALES_MEASURES).first().asDict()
    assert got["net_sales"] is None and got["orders"] == 0 and got["refunds_over_line"] == 0


def test_checks_read_each_table_once_per_side(stored, copied, static):
    k = Decimal("1")
    twice = {n: 2 for n in [*SOLD, "refunds", "campaign_daily", "reviews", "customers"]}
    assert scans(privacy.anonymize_checks(stored, copied, k)) == twice
    assert scans(perturb.perturb_checks(stored, copied)) == {"orders": 2, "order_line_items": 1, "refund_line_items": 1}
    assert scans(perturb.perturb_quantity_checks(stored, copied)) == {n: 2 for n in SOLD}


def test_checks_count_the_line_scans_of_the_star(spark, static):
    star = StarTables(spark, STAR)
    # Lines, refunded lines, orders (their refunded amounts) and refunds are derived from one table there: four scans a side.
    assert scans(privacy.anonymize_checks(star, star, Decimal("1")))["lineitem"] <= 8


def test_references_read_each_table_once(stored, static):
    report = quality.reference_report(stored)
    assert scans(report) == {n: 1 for n in {t for child, parent, _, _ in REFERENCES for t in (child, parent)}}
    assert "Join" not in report._jdf.queryExecution().executedPlan().toString()


def test_references_equal_anti_joins(spark):
    child = spark.createDataFrame([(k, None if k % 5 == 0 else k % 7, "a" if k % 2 else "b") for k in range(90)] + [(1, 99, "a")] * 500, "id long, p long, q string")
    parent = spark.createDataFrame([(k, k % 3, "ab"[k % 2]) for k in range(5)], "pid long, x long, y string")
    refs = [("child", "parent", ["p"], ["pid"]), ("child", "parent", ["p", "q"], ["pid", "y"]), ("parent", "child", ["x"], ["id"]), ("parent", "parent", ["x"], ["pid"])]
    tables = {"child": child, "parent": parent}
    got = [tuple(r) for r in quality.reference_report(tables, refs).collect()]
    want = []
    for c, p, keys, parent_keys in refs:
        bad = quality.check_references(tables[c], tables[p], keys, parent_keys).collect()
        want.append((c, p, ",".join(keys), len(bad), sum(r.n for r in bad)))
    assert got == want and got[0][4] > 500


def test_yearly_comparison_reads_the_lines_three_times(spark, static):
    led = ledger_of(StarTables(spark, STAR))
    assert scans(revenue.yearly_comparison_months(led))["lineitem"] == 3
    assert scans(revenue.yearly_comparison_ytd(led))["lineitem"] == 3


def test_yearly_comparison_with_a_latest_day_in_mid_year(make, order):
    orders = order([(1, "2025-03-10 12:00"), (2, "2025-07-20 12:00"), (3, "2026-02-01 12:00"), (4, "2026-07-04 12:00"), (5, "2024-12-31 12:00"), (6, "2025-07-04 12:00")])
    lines = make("order_line_items", [
        {"line_item_id": k, "order_id": k, "sku": "A", "quantity": 1, "discounted_unit_price": str(10**k)} for k in range(1, 7)
    ])
    none = make("refund_line_items", [])
    led = ledger_of({"orders": orders, "order_line_items": lines, "refund_line_items": none})
    year = revenue.yearly_comparison_ytd(led).first()
    assert (year.current_year, str(year.ytd_end_date)) == (2026, "2026-07-04")
    assert (int(year.current_year_total), int(year.previous_year_total)) == (11_000, 1_000_010)
    months = {r.month_number: (int(r.current_year_revenue), int(r.previous_year_revenue)) for r in revenue.yearly_comparison_months(led).collect()}
    assert len(months) == 12 and months[7] == (10_000, 1_000_100) and months[3] == (0, 10) and months[12] == (0, 0)


def test_three_mappings_from_one_line_scan(spark, stored, monkeypatch):
    labels = []
    plain = privacy.stage
    monkeypatch.setattr(privacy, "stage", lambda df, label: labels.append(label) or plain(df, label))
    maps = privacy.build_mappings(stored, "salt")
    for name in ("product", "season", "sku"):
        assert not [f for f in maps[name].inputFiles() if "/order_line_items/" in f]
    assert labels == ["line-values"]
    out = privacy.anonymize(stored, Decimal("2"), "salt")
    assert out["order_line_items"].count() == stored["order_line_items"].count()
    assert labels == ["line-values"] * 2


def test_lines_with_null_values_keep_their_row(make):
    lines = make("order_line_items", [
        {"line_item_id": k, "order_id": 1, "sku": s, "title": t, "season_code": c, "quantity": 1}
        for k, (s, t, c) in enumerate([(None, None, None), ("A", None, "w"), ("A", "T", None), (None, "T", "w"), ("x-redo", "Cover", "w"), ("A", "T", None)])
    ])
    reviews = make("reviews", [{"id": 1, "product_title": "T"}])
    source = privacy.mapping_source({"order_line_items": lines, "reviews": reviews})
    m = privacy.build_mappings(source, "salt", source)
    out = privacy.anonymize_lines(lines, source["order_line_items"], m["product"], m["sku"], m["season"], Decimal("1"))
    got = {r.line_item_id: r for r in out.collect()}
    assert len(got) == 6 and got[0].title is None and got[0].season_code is None
    assert (got[4].title, got[4].sku) == ("Cover", "x-redo") and got[4].season_code == got[1].season_code == "S01"
    assert got[2].title == got[3].title == got[5].title != "T" and got[2].sku == got[1].sku


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_send_whole_numbers_and_few_counters(spark):
    child = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id long, p int")
    parent = spark.createDataFrame([(5,)], "pid long")
    refs = [("child", "parent", ["p"], ["pid"]), ("parent", "child", ["pid"], ["id"])]
    report = quality.reference_report({"child": child, "parent": parent}, refs)
    assert [tuple(r)[3:] for r in report.collect()] == [(1, 1), (1, 1)]
    keys = re.findall(r"Aggregate \[g#\d+, num0#[^\n]*", plan_of(report))
    assert len(keys) == 1 and " AS n1#" not in keys[0]


def test_line_keys_of_the_star_read_no_parts(spark):
    lines = StarTables(spark, STAR)["order_line_items"]
    assert "p_name" in plan_of(lines) and "Join" not in plan_of(lines.select("order_id", "line_item_id"))


def test_totals_without_quantities_group_a_line_once(odd):
    some = ["net_sales", "units", "orders"]
    assert plan_of(sales_totals(odd, some)).count("Aggregate [") < plan_of(sales_totals(odd, SALES_MEASURES)).count("Aggregate [")
    assert sales_totals(odd, some).first().asDict() == {n: v for n, v in sales_totals(odd, SALES_MEASURES).first().asDict().items() if n in some}


def test_anonymize_checks_number_no_orders(spark, monkeypatch):
    star, numbered = StarTables(spark, STAR), []
    monkeypatch.setattr(privacy, "renumber_orders", numbered.append)
    privacy.anonymize_checks(star, privacy.anonymize(star, Decimal("1"), "salt", renumber=False), Decimal("1")).collect()
    assert numbered == []


def test_perturb_checks_stage_each_step_once(spark, stored, monkeypatch):
    staged, plain = [], perturb.stage
    monkeypatch.setattr(perturb, "stage", lambda df, label: staged.append(label) or plain(df, label))
    monkeypatch.setattr(perturb, "renumber_orders", lambda orders: staged.append("numbered"))
    out = perturb.perturb(stored, "salt", renumber=False)
    perturb.perturb_checks(stored, out).collect()
    assert sorted(staged) == ["changes", "kept-orders", "refund-lines"]
    assert not [f for n in ("order_line_items", "refund_line_items") for f in out[n].inputFiles() if "/shop" in f]
