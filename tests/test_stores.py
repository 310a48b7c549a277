"""Stores of parts, the bucketed snapshots and the maintained ledger."""

from datetime import date
from functools import partial

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import ingest
from shopmetrics.operators.ledger import LEDGER_COLUMNS, net_sales_lines
from shopmetrics.sources import partition_store as store
from shopmetrics.sources.schema import table_schema
from shopmetrics.sources.staging import stage_buckets, staged_run
from shopmetrics.streaming import ledger_sync, sync

UPSERT = partial(ingest.upsert_snapshot, keys=["order_id"], order_col="synced_at")


def ids(df):
    return sorted((r.order_id, int(r.net_payment)) for r in df.collect())


def test_only_touched_buckets_are_written(spark, order, tmp_path):
    root, schema = str(tmp_path / "orders"), table_schema("orders")
    store.merge_bucketed(spark, root, order([(k, "2026-01-01", 1, k) for k in range(40)]), "v1", ["order_id"], UPSERT, 8)
    first = store.listing(spark, root)
    assert len(first) == 8
    batch = order([(3, "2026-01-01", 1, 99), (40, "2026-01-01", 1, 7)])
    store.merge_bucketed(spark, root, batch, "v2", ["order_id"], UPSERT, 8)
    second = store.listing(spark, root)
    touched = {str(b) for b in store.buckets_of(batch, ["order_id"], 8)}
    assert {p for p in second if second[p] != first.get(p)} == touched and len(touched) <= 2
    now = ids(store.read_parts(spark, root, schema))
    assert now == sorted([(k, 99 if k == 3 else k) for k in range(40)] + [(40, 7)])
    # The same version again changes nothing, also with other rows; the earlier one can still be read.
    store.merge_bucketed(spark, root, order([(5, "2026-01-01", 1, 1)]), "v2", ["order_id"], UPSERT, 8)
    assert store.committed(spark, root) == ["v1", "v2"] and ids(store.read_parts(spark, root, schema)) == now
    assert len(ids(store.read_parts(spark, root, schema, as_of="v1"))) == 40
    with pytest.raises(ValueError, match="laid out"):
        store.merge_bucketed(spark, root, batch, "v3", ["order_id"], UPSERT, 16)


def test_vacuum_keeps_what_recent_versions_list(spark, order, tmp_path):
    root, schema = str(tmp_path / "orders"), table_schema("orders")
    for v in range(3):
        store.merge_bucketed(spark, root, order([(k, "2026-01-01", 1, v) for k in range(v, 12)]), f"v{v}", ["order_id"], UPSERT, 4)
    removed = store.vacuum(spark, root, keep=1)
    assert removed and not set(removed) & set(store.listing(spark, root).values())
    assert ids(store.read_parts(spark, root, schema)) == [(k, min(k, 2)) for k in range(12)]
    assert store.committed(spark, root) == ["v2"]
    assert not [p for p in (tmp_path / "orders").glob("v0/_part=*") if p.name in {f.split("/")[1] for f in removed if f.startswith("v0/")}]


def test_a_part_can_empty_and_rows_of_other_parts_are_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, part string")
    store.commit_parts(spark, root, df, "part", ["a", "b"], "v1")
    store.commit_parts(spark, root, df.limit(0), "part", ["a"], "v2")
    assert [r.id for r in store.read_parts(spark, root, df.schema).collect()] == [2]
    assert store.read_parts(spark, root, df.schema, ["a", "zz"]).count() == 0
    with pytest.raises(ValueError, match="not touched"):
        store.commit_parts(spark, root, df, "part", ["a"], "v3")
    assert store.committed(spark, root) == ["v1", "v2"]
    with pytest.raises(ValueError, match="no version"):
        store.listing(spark, root, "v9")
    assert store.listing(spark, str(tmp_path / "none")) == {} and store.vacuum(spark, str(tmp_path / "none")) == []


def test_children_are_replaced_in_their_buckets(spark, make, tmp_path):
    landing, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    name, run = "order_discounts", partial(sync.sync_snapshot, spark, landing, target, "order_discounts", cp, parent_key="order_id", buckets=4)
    rows = lambda *r: make(name, [{"id": i, "order_id": o, "position": p, "kind": "CODE"} for i, o, p in r])
    rows((1, 1, 0), (2, 1, 1), (3, 2, 0)).write.mode("append").parquet(f"{landing}/{name}")
    run().awaitTermination()
    rows((4, 1, 0), (5, 3, 0)).write.mode("append").parquet(f"{landing}/{name}")
    run().awaitTermination()
    assert sorted(r.id for r in sync.current_snapshot(spark, target, name).collect()) == [3, 4, 5]
    with pytest.raises(FileNotFoundError):
        sync.current_snapshot(spark, target, "orders")


LINE = ["line_item_id", "order_id", "sku", "title", "quantity", "discounted_unit_price"]
BACK = ["id", "refund_id", "order_id", "line_item_id", "processed_at", "quantity", "subtotal"]


@pytest.fixture
def changes(make, order):
    def _changes(orders=(), lines=(), refunds=()):
        return {
            "orders": order(list(orders)),
            "order_line_items": make("order_line_items", [dict(zip(LINE, r, strict=True)) for r in lines]).select(
                *table_schema("order_line_items").fieldNames()
            ),
            "refund_line_items": make("refund_line_items", [dict(zip(BACK, r, strict=True)) for r in refunds]),
        }

    return _changes


FIRST = dict(
    orders=[(1, "2025-11-03 15:00"), (2, "2025-12-01 03:00"), (3, "2025-12-20 12:00"), (4, "2026-02-02 09:00")],
    lines=[(11, 1, "MUG", "Mug", 2, "5.00"), (21, 2, "RUG", "Rug", 1, "80.00"), (31, 3, "MUG", "Mug", 1, "5.00"), (41, 4, "x-redo", "Cover", 1, "1.00")],
    refunds=[(1, 900, 1, 11, "2025-12-05 10:00", 1, "5.00")],
)
# Order 2 changes its line and moves to an earlier month, a late refund of order 3 books in January, order 5 is new.
SECOND = dict(
    orders=[(2, "2025-11-30 03:00"), (5, "2026-02-10 12:00")],
    lines=[(22, 2, "RUG", "Rug", 3, "70.00"), (51, 5, "LAMP", "Lamp", 1, "31.00")],
    refunds=[(2, 901, 3, 31, "2026-01-15 10:00", 1, "5.00")],
)
# A refund before its order; the refund of order 1 is corrected.
THIRD = dict(refunds=[(3, 902, 6, 61, "2026-02-20 10:00", 1, "9.00"), (4, 900, 1, 11, "2026-02-06 10:00", 2, "10.00")])
FOURTH = dict(orders=[(6, "2026-01-31 23:00")], lines=[(61, 6, "CUP", "Cup", 4, "9.00")])


def ledger_rows(df):
    return sorted(map(str, df.select(LEDGER_COLUMNS).collect()))


def whole(spark, target):
    t = {n: ledger_sync.base_table(spark, target, n) for n in ledger_sync.MERGES}
    return ledger_rows(net_sales_lines(t["order_line_items"], t["orders"], t["refund_line_items"]))


def test_ledger_follows_every_batch(spark, changes, tmp_path):
    target = str(tmp_path / "shop")
    root = f"{target}/{ledger_sync.LEDGER}"
    moved = [None, {"2025-11-01", "2025-12-01", "2026-01-01", "2026-02-01"}, {"2025-12-01", "2026-02-01"}, {"2026-01-01", "2026-02-01"}]
    for k, batch in enumerate([FIRST, SECOND, THIRD, FOURTH]):
        old = store.listing(spark, root)
        ledger_sync.apply_changes(spark, target, changes(**batch), f"v{k}", buckets=4)
        new = store.listing(spark, root)
        assert ledger_rows(ledger_sync.current_ledger(spark, target)) == whole(spark, target)
        if moved[k] is not None:
            assert {m for m in {*old, *new} if old.get(m) != new.get(m)} <= moved[k]
        # A replay finds nothing to do.
        ledger_sync.apply_changes(spark, target, changes(**batch), f"v{k}", buckets=4)
        assert store.listing(spark, root) == new
    amounts = {r.order_id: r.amount for r in ledger_sync.current_ledger(spark, target).where("row_type = 'RETURN'").collect()}
    assert {k: int(v) for k, v in amounts.items()} == {1: -10, 3: -5, 6: -9}
    january = ledger_sync.current_ledger(spark, target, date(2026, 1, 9), date(2026, 1, 20))
    assert {r.order_id for r in january.collect()} == {3, 6}
    assert ids(ledger_sync.base_table(spark, target, "orders", [2, 6], 4)) == [(2, 0), (6, 0)]


def test_untouched_months_keep_their_files(spark, changes, tmp_path):
    target = str(tmp_path / "shop")
    ledger_sync.apply_changes(spark, target, changes(**FIRST), "v0", buckets=4)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "shop" / ledger_sync.LEDGER).rglob("*.parquet")}
    ledger_sync.apply_changes(spark, target, changes(**THIRD), "v1", buckets=4)
    listed = store.listing(spark, f"{target}/{ledger_sync.LEDGER}")
    # The refund of order 1 moves from December to February; its sale in November stays as it is.
    assert {m: f.split("/")[0] for m, f in listed.items()} == {"2025-11-01": "v0", "2025-12-01": "v1", "2026-02-01": "v1"}
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())


def test_ledger_after_a_failure_between_base_and_ledger(spark, changes, tmp_path, monkeypatch):
    target = str(tmp_path / "shop")
    ledger_sync.apply_changes(spark, target, changes(**FIRST), "v0", buckets=4)

    def fail(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(ledger_sync, "commit_parts", fail)
    with pytest.raises(RuntimeError):
        ledger_sync.apply_changes(spark, target, changes(**SECOND), "v1", buckets=4)
    monkeypatch.undo()
    ledger_sync.apply_changes(spark, target, changes(**SECOND), "v1", buckets=4)
    assert ledger_rows(ledger_sync.current_ledger(spark, target)) == whole(spark, target)


def test_stream_ledger(spark, changes, tmp_path):
    landing, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    run = partial(ledger_sync.stream_ledger, spark, landing, target, cp, 4)
    for batch in (FIRST, SECOND, FOURTH):
        for name, df in changes(**batch).items():
            df.write.mode("append").parquet(f"{landing}/{name}")
        run().awaitTermination()
        assert ledger_rows(ledger_sync.current_ledger(spark, target)) == whole(spark, target)
    assert len(store.committed(spark, f"{target}/{ledger_sync.LEDGER}")) == 3


def test_staged_buckets_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with staged_run(spark):
            left = stage_buckets(spark.range(1000).selectExpr("id % 7 AS k", "id AS v"), "left", "k")
            right = stage_buckets(spark.range(7).selectExpr("id AS k", "id * 2 AS w"), "right", "k")
            joined = left.join(right, "k").groupBy("k").agg(F.count("*").alias("n"), F.max("w").alias("w"))
            assert {tuple(r) for r in joined.collect()} == {(k, 143 if k < 6 else 142, 2 * k) for k in range(7)}
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
            assert not [t for t in spark.catalog.listTables() if t.name.startswith("staged_")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
