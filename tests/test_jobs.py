"""Transform jobs, cleanup of staged tables, activity bitmaps and planned copies."""

from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import acquisition, activity, transform_job
from shopmetrics.sources import partition_store, publish, staging
from shopmetrics.sources import tables as io
from shopmetrics.sources.schema import DDL
from shopmetrics.sources.star import StarTables

STAR = "/root/testdata/sf0.001"
K = Decimal("0.68")


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A published dataset."""
    path = str(tmp_path_factory.mktemp("shop"))
    star = StarTables(spark, STAR)
    publish.publish_checked(spark, {n: star[n] for n in DDL}, lambda t: t["orders"].limit(0), path)
    return path


def staged(spark):
    root = Path(staging.staging_root(spark).removeprefix("file:"))
    return {p.name for p in root.iterdir() if p.name.startswith("run-")}


def test_jobs_publish_what_passes_and_leave_nothing_staged(spark, shop, monkeypatch):
    first = publish.published(spark, shop)
    with pytest.raises(ValueError, match="needs anonymize"):
        transform_job.run_step(spark, shop, "perturb", "salt")
    # A term that remains, a check that fails, a reference that is lost and a transform that breaks: nothing is published.
    with pytest.raises(publish.CheckFailed) as e:
        transform_job.run_step(spark, shop, "anonymize", "salt", K, "customer")
    assert {r.kind for r in spark.read.parquet(str(e.value).split("listed in ")[1]).collect()} == {"term"}
    whole = transform_job.anonymize

    def spoiled(change):
        def transform(tables, *args):
            return transform_job.LazyTables({n: (lambda f=f, n=n: f(whole(tables, *args)[n])) for n, f in change.items()}, whole(tables, *args))

        return transform

    change = {
        "refunds": lambda df: df.withColumn("total_refunded", (F.col("total_refunded") * 2).cast("decimal(12,2)")),
        "customers": lambda df: df.where("customer_id % 2 = 0"),
    }
    monkeypatch.setattr(transform_job, "anonymize", spoiled(change))
    with pytest.raises(publish.CheckFailed) as e:
        transform_job.run_step(spark, shop, "anonymize", "salt", K)
    found = {(r.kind, r.name) for r in spark.read.parquet(str(e.value).split("listed in ")[1]).collect()}
    assert {("check", "refunds"), ("reference", "orders.customer_id")} <= found
    monkeypatch.setattr(transform_job, "anonymize", spoiled({"orders": lambda df: df.select("nothing")}))
    with pytest.raises(Exception, match="nothing"):
        transform_job.run_step(spark, shop, "anonymize", "salt", K)
    monkeypatch.undo()
    assert publish.published(spark, shop) == first and not staged(spark)

    for step, k in (("anonymize", K), ("perturb", None)):
        folder = transform_job.run_step(spark, shop, step, "salt", k, "facebook_shop" if k else None)
        assert publish.published(spark, shop)[0] == folder and not staged(spark)
    assert publish.published(spark, shop)[1] == ["anonymize", "perturb"]
    tables = io.load_tables(spark, folder)
    # Customers were derived from the perturbed orders, and refunds follow their lines.
    spent = tables["orders"].groupBy("customer_id").agg(F.sum("net_payment").alias("spent"))
    assert tables["customers"].join(spent, "customer_id").where("amount_spent <> spent").count() == 0
    assert tables["customers"].count() == spent.count()
    with pytest.raises(ValueError, match="already"):
        transform_job.run_step(spark, shop, "perturb", "salt")


def test_a_run_removes_its_tables_only(spark):
    outside = staging.stage(spark.range(3), "outside")
    with pytest.raises(RuntimeError), staging.staged_run(spark, "run-test") as run:
        staging.stage(spark.range(3), "inside")
        assert run == "run-test" and "run-test" in staged(spark)
        raise RuntimeError
    assert "run-test" not in staged(spark) and outside.count() == 3


def test_activity_gives_the_same_reports(spark):
    star = StarTables(spark, STAR)
    months = staging.stage(activity.activity_bitmaps(star["orders"]), "activity")
    assert months.count() == months.select("customer_id").distinct().count()
    rows = lambda df: sorted(map(str, df.collect()))
    for end in (date(1996, 12, 1), date(2001, 8, 1)):
        assert rows(acquisition.acquisition_trend_from_activity(star["customers"], months, end, 30)) == rows(
            acquisition.acquisition_trend(star["customers"], star["orders"], end, 30)
        )
        args = (end, 12, 6, date(2001, 3, 1))
        assert rows(acquisition.cohort_retention_from_activity(star["customers"], months, *args)) == rows(
            acquisition.cohort_retention(star["customers"], star["orders"], *args)
        )


def test_activity_is_extended_by_one_month(spark, order, tmp_path):
    root = str(tmp_path / "activity")
    old = [(k, "2026-01-10", k % 9, 1) for k in range(60)] + [(90, "2020-02-01", 1, 1), (91, "2025-12-31", None, 1)]
    new = [(70, "2026-02-03", 2, 1), (71, "2026-02-27 20:00", 2, 1), (72, "2026-03-02", 3, 1)]
    january, february = (date(2020, 1, 1), date(2026, 1, 31)), (date(2026, 2, 1), date(2026, 2, 28))
    activity.extend_activity(spark, root, order(old), *january, "v1", 4)
    before = partition_store.listing(spark, root)
    activity.extend_activity(spark, root, order(old + new), *february, "v2", 4)
    activity.extend_activity(spark, root, order(old + new), *february, "v2", 4)
    after = partition_store.listing(spark, root)
    assert len([p for p in after if after[p] != before.get(p)]) == 1  # the bucket of customer 2
    got = {r.customer_id: dict(r.months) for r in activity.stored_activity(spark, root).collect()}
    want = {r.customer_id: dict(r.months) for r in activity.activity_bitmaps(order(old + new[:2])).collect()}
    assert got == want and None not in got
    index = F.lit(2020 * 12), F.lit(2027 * 12)
    listed = activity.stored_activity(spark, root).where("customer_id IN (1, 2)").select("customer_id", activity.months_between(*index).alias("m"))
    # 1 February 2020 at midnight UTC is still January in the business time zone.
    assert {r.customer_id: [(m - 1) // 12 * 100 + (m - 1) % 12 + 1 for m in r.m] for r in listed.collect()} == {1: [202001, 202601], 2: [202601, 202602]}


def test_copy_is_planned_in_even_ranges(spark):
    ids = F.when(F.col("id") < 6000, F.col("id") % 50).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") * 13 - 90000)
    spark.range(9000).select(ids.alias("k")).createOrReplaceTempView("planned")
    low, high, rows = spark.sql(io.bounds_query("planned", "k")).first()
    width = io.histogram_width(low, high, rows, 500)
    counts = {int(r.part): r.n for r in spark.sql(io.histogram_query("planned", "k", low, width)).collect()}
    ranges = io.even_predicates("k", low, width, counts, 500)
    held = [spark.table("planned").where(r).count() for r in ranges]
    nulls = spark.table("planned").where("k is null").count()
    assert sum(held) == 9000 and len(ranges) > 3
    assert max(held[1:]) <= max(500, max(counts.values())) and held[0] >= nulls
    for k in ("null", str(low - 1), str(high + 1), "0"):  # rows that came later are read as well, each once
        assert sum(spark.sql(f"SELECT {k} AS k").where(r).count() for r in ranges) == 1
    assert io.even_predicates("k", 0, 10, {}, 5) == ["1 = 1"] and io.even_predicates("k", 0, 10, {0: 3}, 5) == ["1 = 1"]
