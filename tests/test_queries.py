"""Every registered query against its SQL oracle, and properties of the plans."""

import os
import re
from decimal import Decimal

import pytest

import __spark_entry__ as entry_point
from shopmetrics.operators import perturb

STAR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(STAR), reason="needs the test dataset")
duckdb = pytest.importorskip("duckdb")

QUERIES, ORACLES = entry_point.QUERIES, entry_point.ORACLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(STAR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{STAR}/{file}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return format(v.normalize(), "f") if v else "0"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("zone", ["America/Los_Angeles"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_the_oracle(spark, db, name, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    df = QUERIES[name](spark, STAR)
    rel = db.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(cols)
    order = [cols.index(c) for c in df.columns]
    got = sorted([plain(v) for v in r] for r in df.collect())
    want = sorted([plain(r[i]) for i in order] for r in rel.fetchall())
    assert got == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
    # A window without PARTITION BY is allowed over a bounded aggregate, never over a base table.
    for window in re.finditer(r"\n[^\n]*Window \[[^\n]*\n(?:[^\n]*\n){0,4}", plain_plan(plan)):
        assert "FileScan" not in window.group(0)


def plain_plan(plan: str) -> str:
    return plan.split("== Initial Plan ==")[0]


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1


def test_date_filter_reaches_the_scan(spark):
    plan = QUERIES["revenue_summary"](spark, STAR)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"o_orderdate#\d+ >= 1999-07-03 04:00:00", plan)
    assert re.search(r"l_shipdate#\d+ >= 1999-07-03 04:00:00", plan)
    assert "o_totalprice" not in plan and "l_tax" not in plan


def test_perturbed_allocations_write_no_lines(spark, monkeypatch):
    staged, write = [], perturb.stage
    monkeypatch.setattr(perturb, "stage", lambda df, label: staged.append(label) or write(df, label))
    assert QUERIES["perturb_allocations"](spark, STAR).count() > 0
    assert staged == []
