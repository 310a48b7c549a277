from datetime import date, datetime

import pytest

from shopmetrics.operators import ingest
from shopmetrics.sources import tables as io
from shopmetrics.sources.publish import CheckFailed, guard_step, publish_checked, published
from shopmetrics.streaming import sync


def sessions(make, rows):
    return make(
        "sessions_daily",
        [{"session_date": d, "referrer_source": s, "sessions": n, "updated_at": u} for d, s, n, u in rows],
    )


def test_upsert(make):
    now = sessions(make, [("2026-01-01", "a", 1, "2026-01-05"), ("2026-01-02", "a", 2, "2026-01-05")])
    new = sessions(
        make,
        [("2026-01-02", "a", 20, "2026-01-03"), ("2026-01-02", "a", 21, "2026-01-04"), ("2026-01-03", "b", 3, "2026-01-06")],
    )
    out = ingest.upsert_snapshot(now, new, ["session_date", "referrer_source"], "updated_at")
    assert out.columns == now.columns
    # incoming wins even with an older stamp; of two incoming versions the newer one
    assert sorted((r.session_date.day, r.sessions) for r in out.collect()) == [(1, 1), (2, 21), (3, 3)]


def test_replace_children(spark):
    now = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "order_id int, position int")
    new = spark.createDataFrame([(1, 5), (3, 0)], "order_id int, position int")
    got = sorted(tuple(r) for r in ingest.replace_children(now, new, "order_id").collect())
    assert got == [(1, 5), (2, 0), (3, 0)]


def test_refetch_window(make):
    now = sessions(make, [(f"2026-01-0{d}", "a", d, "2026-01-09") for d in range(1, 6)])
    new = sessions(make, [(f"2026-01-0{d}", "a", d * 10, "2026-01-09") for d in range(1, 6)])
    out = ingest.refetch_window(now, new, "session_date", 2, date(2026, 1, 5))
    assert sorted(r.sessions for r in out.collect()) == [1, 2, 3, 40, 50]


def test_overwrite_days(spark, make, tmp_path):
    path = str(tmp_path / "s")
    ingest.overwrite_days(spark, sessions(make, [("2026-01-01", "a", 1, "2026-01-09"), ("2026-01-02", "a", 2, "2026-01-09")]), path, "session_date")
    ingest.overwrite_days(spark, sessions(make, [("2026-01-02", "a", 9, "2026-01-09")]), path, "session_date")
    assert sorted(r.sessions for r in spark.read.parquet(path).collect()) == [1, 9]


def test_pending_and_resolve(spark, make):
    attr = make("order_attribution", [{"order_id": 1, "journey_ready": False}, {"order_id": 2}])
    assert [r.order_id for r in ingest.pending_attribution(attr).collect()] == [1]
    alloc = spark.createDataFrame([(1, 10, "A", 5), (2, 20, "A", 6)], "id long, line_item_id long, code_or_title string, allocated_amount int")
    alloc = alloc.selectExpr("*", "'USD' AS currency")
    lines = spark.createDataFrame([(10, 100), (20, 200)], "line_item_id long, order_id long")
    disc = spark.createDataFrame([(1, 100, 1, "A"), (2, 100, 0, "A"), (3, 200, 0, "A")], "id long, order_id long, position int, code_or_title string")
    got = sorted((r.id, r.order_discount_id) for r in ingest.resolve_discount_allocations(alloc, lines, disc).collect())
    assert got == [(1, 2), (2, 3)]


def test_load_and_copy(spark, autumn, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    for name, df in autumn.items():
        io.write_table(df, name, src)
    assert io.copy_tables(spark, src, dst, autumn) == list(autumn)
    assert "net_sales" not in spark.read.parquet(f"{dst}/order_line_items").columns
    back = io.load_tables(spark, dst, autumn)
    assert back["order_line_items"].filter("net_sales = 59 AND NOT is_returned").count() == 2
    assert back["orders"].schema["created_at"].dataType.typeName() == "timestamp_ntz"
    with pytest.raises(ValueError):
        io.copy_tables(spark, src, src)


def test_publish_only_when_checks_pass(spark, autumn, tmp_path):
    path = str(tmp_path / "pub")
    clean = lambda t: t["orders"].filter("false")
    first = publish_checked(spark, autumn, clean, path, "anonymize")
    assert published(spark, path) == (first, ["anonymize"])
    with pytest.raises(CheckFailed):
        publish_checked(spark, autumn, lambda t: t["orders"].select("order_id"), path, "perturb")
    assert published(spark, path) == (first, ["anonymize"])
    with pytest.raises(ValueError):
        publish_checked(spark, autumn, clean, path, "anonymize")
    second = publish_checked(spark, autumn, clean, path, "perturb")
    assert published(spark, path) == (second, ["anonymize", "perturb"])


def test_step_guards():
    with pytest.raises(ValueError):
        guard_step("perturb", [])
    with pytest.raises(ValueError):
        guard_step("anonymize", [], 0.01)
    guard_step("perturb_quantity", ["anonymize", "perturb"])


def land(df, path, name):
    df.write.mode("append").parquet(f"{path}/{name}")


def test_sync_days(spark, make, tmp_path):
    landing, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    args = (spark, landing, target, "sessions_daily", "session_date", cp)
    land(sessions(make, [("2026-01-01", "a", 1, "2026-01-03"), ("2026-01-02", "a", 2, "2026-01-03")]), landing, "sessions_daily")
    sync.sync_days(*args).awaitTermination()
    land(sessions(make, [("2026-01-02", "a", 7, "2026-01-04"), ("2026-01-02", "b", 8, "2026-01-04")]), landing, "sessions_daily")
    sync.sync_days(*args).awaitTermination()
    got = spark.read.parquet(f"{target}/sessions_daily")
    assert sorted((r.session_date.day, r.sessions) for r in got.collect()) == [(1, 1), (2, 7), (2, 8)]


def test_sync_snapshot(spark, order, tmp_path):
    landing, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    land(order([(1, "2026-01-01", 1, 5), (2, "2026-01-01", 1, 5)]), landing, "orders")
    sync.sync_snapshot(spark, landing, target, "orders", cp, order_col="synced_at").awaitTermination()
    land(order([(2, "2026-01-01", 1, 9), (3, "2026-01-02", 1, 1)]), landing, "orders")
    sync.sync_snapshot(spark, landing, target, "orders", cp, order_col="synced_at").awaitTermination()
    now = sync.current_snapshot(spark, target, "orders").collect()
    assert sorted((r.order_id, int(r.net_payment)) for r in now) == [(1, 5), (2, 9), (3, 1)]
    assert isinstance(now[0].created_at, datetime)
