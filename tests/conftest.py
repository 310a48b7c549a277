from __future__ import annotations

import os
import sys
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shopmetrics.sources.schema import table_schema  # noqa: E402
from shopmetrics.sources.tables import derive_line_columns  # noqa: E402

NOW = datetime(2026, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("shopmetrics-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stage")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


DEFAULTS = {
    "customers": {"number_of_orders": 1, "updated_at": NOW},
    "orders": {"synced_at": NOW, "total_refunded": Decimal(0)},
    "order_attribution": {"journey_ready": True, "updated_at": NOW},
    "order_line_items": {"returned_quantity": 0, "line_status": "FULFILLED"},
    "refund_line_items": {"restock_type": "RETURN"},
    "sessions_daily": {"updated_at": NOW},
    "channel_daily": {"source": "s", "medium": "m", "total_users": 0, "updated_at": NOW},
    "campaign_daily": {"currency": "USD", "updated_at": NOW, "campaign_name": "c"},
    "annotations": {"category": "other", "created_at": NOW, "updated_at": NOW},
}


@pytest.fixture
def make(spark):
    """Small canonical tables from dicts; missing columns get a default or NULL."""

    def _make(name: str, rows: list[dict]):
        schema = table_schema(name)
        full = [{**DEFAULTS.get(name, {}), **r} for r in rows]
        data = [tuple(_value(r.get(f.name), f.dataType.typeName()) for f in schema.fields) for r in full]
        df = spark.createDataFrame(data, schema)
        return derive_line_columns(df) if name == "order_line_items" else df

    return _make


def _value(v, kind: str):
    if v is None:
        return None
    if kind == "decimal":
        return Decimal(str(v))
    if kind == "timestamp_ntz" and isinstance(v, str):
        return datetime.fromisoformat(v)
    if kind == "date" and isinstance(v, str):
        return date.fromisoformat(v)
    return v


@pytest.fixture
def order(make):
    def _orders(rows: list[tuple]):
        """(order_id, created_at[, customer_id[, net_payment]])"""
        out = []
        for r in rows:
            amount = r[3] if len(r) > 3 else 0
            out.append(
                {
                    "order_id": r[0],
                    "order_name": f"#{r[0]}",
                    "created_at": r[1],
                    "customer_id": r[2] if len(r) > 2 else None,
                    "net_payment": amount,
                    "total_amount": amount,
                }
            )
        return make("orders", out)

    return _orders


@pytest.fixture
def autumn(make, order):
    """Hand-checkable weeks around October; the expected numbers are worked out in FIXTURES.md §2.1."""
    orders = order(
        [
            (41, "2024-09-18 21:15"),
            (42, "2024-10-01 02:40"),
            (57, "2024-10-08 13:05"),
            (58, "2024-10-09 03:10"),
            (63, "2024-10-27 19:00"),
            (64, "2024-10-30 11:30"),
            (70, "2024-11-05 16:20"),
        ]
    )
    sold = [
        (411, 41, "MUG", "Mug", 4, "12.25"),
        (421, 42, "LAMP", "Desk lamp", 1, "31.00"),
        (571, 57, "MUG", "Mug", 3, "12.25"),
        (572, 57, "ROUTEINS-77", "Shipping cover", 1, "3.40"),
        (581, 58, "LAMP", "Desk lamp", 2, "29.50"),
        (582, 58, "x-redo", "Return cover", 2, "1.15"),
        (631, 63, None, "Loose tea", 5, "8.00"),
        (641, 64, "RUG", "Rug", 1, "145.90"),
        (701, 70, "LAMP", "Desk lamp", 2, "29.50"),
    ]
    names = ["line_item_id", "order_id", "sku", "title", "quantity", "discounted_unit_price"]
    back = [
        (1, 501, 57, 571, "2024-10-21 14:00", 2, "24.50"),
        (2, 501, 57, 572, "2024-10-21 14:00", 1, "3.40"),
        (3, 502, 41, 411, "2024-10-12 01:30", 1, "12.25"),
        (4, 503, 64, 641, "2024-11-12 18:45", 1, "145.90"),
    ]
    returned = ["id", "refund_id", "order_id", "line_item_id", "processed_at", "quantity", "subtotal"]
    return {
        "orders": orders,
        "order_line_items": make("order_line_items", [{**dict(zip(names, r, strict=True)), "current_quantity": r[4]} for r in sold]),
        "refund_line_items": make("refund_line_items", [dict(zip(returned, r, strict=True)) for r in back]),
    }
