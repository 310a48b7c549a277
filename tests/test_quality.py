from datetime import date

from pyspark.sql import functions as F

from shopmetrics.operators import quality as q


def test_keys_and_references(spark):
    child = spark.createDataFrame([(1, 5), (2, 6), (3, 6), (4, None)], "id int, parent int")
    parent = spark.createDataFrame([(5,), (5,)], "pid int")
    assert [tuple(r) for r in q.check_keys(parent, ["pid"]).collect()] == [(5, 2)]
    assert [tuple(r) for r in q.check_references(child, parent, ["parent"], ["pid"]).collect()] == [(6, 2)]


def test_domains(make):
    bad = make("order_discounts", [
        {"id": 1, "order_id": 1, "position": 0, "kind": "CODE", "value_amount": "1.00"},
        {"id": 2, "order_id": 1, "position": 1, "kind": "GIFT", "value_amount": "1.00"},
        {"id": 3, "order_id": 1, "position": 2, "kind": "MANUAL"},
    ])
    got = {r.rule: r.violations for r in q.domain_report({"order_discounts": bad}, ["order_discounts"]).collect()}
    assert got == {"kind known": 1, "amount or percentage": 1}


def test_metric_bounds(spark):
    df = spark.createDataFrame([(1, 50.0), (-2, 101.0), (None, -1.0)], "n int, pct double")
    got = [tuple(r) for r in q.check_metric_bounds(df, {"n": (0, None), "pct": (0, 100)}).orderBy("metric").collect()]
    assert got == [("n", 1, -2.0, -2.0), ("pct", 2, -1.0, 101.0)]


def test_term_scan(spark):
    a = spark.createDataFrame([("ACME hat", 1, None), ("plain", 2, "by acme co")], "title string, n int, note string")
    b = spark.createDataFrame([(date(2026, 1, 1),)], "d date")
    c = spark.createDataFrame([("x",)], "title string")
    got = sorted(tuple(r) for r in q.term_scan({"a": a, "b": b, "c": c}, "acme").collect())
    assert got == [("a", "note", 1), ("a", "title", 1)]
    assert q.term_scan({"a": a.limit(0), "c": c}, "acme").agg(F.count("*")).first()[0] == 0
