"""Grand totals for checks: every table is read once, however many measures are taken from it.

The ledger total needs no join here. Lines and refunded lines of one key meet in an aggregate, their sums meet
the order in a second one, and what belongs to no order drops out; each step combines before its shuffle,
so an order or line that holds most rows is no hot key. The products of the row counts are those
of the joins behind the ledger, also where keys repeat.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.money import TOTAL
from shopmetrics.functions.text import is_product_sku
from shopmetrics.operators.ledger import AMOUNT
from shopmetrics.sources.lazy import Tables

VALUE = "decimal(28,4)"

#: Measures of orders, lines and refunded lines together.
SALES_MEASURES = [
    "net_sales", "line_items", "units", "multi_units", "invalid_quantities", "inconsistent_prices", "refunds_over_line",
    "orders", "net_payment", "negative_money",
]


def unpivoted(row: DataFrame) -> DataFrame:
    """(measure, value) rows from a one-row aggregate."""
    pairs = [F.struct(F.lit(c).alias("measure"), F.col(c).cast(VALUE).alias("value")) for c in row.columns]
    return row.select(F.inline(F.array(*pairs)))


def measures(tables: Tables, registry: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """(measure, value) of named aggregates per table, one pass over each."""
    rows = [unpivoted(tables[t].agg(*[e.alias(n) for n, e in named.items()])) for t, named in registry.items()]
    return reduce(DataFrame.unionByName, rows)


def sales_totals(tables: Tables, names: list[str]) -> DataFrame:
    """One row with the chosen SALES_MEASURES."""
    product = is_product_sku(F.col("sku"))
    o, d = F.col("original_unit_price"), F.col("discounted_unit_price")
    nothing, none = F.lit(None).cast("int"), F.lit(0).cast("long")
    flag = lambda c: F.when(c, 1).otherwise(0).cast("long")
    money = lambda c: c.cast(AMOUNT)
    lines = tables["order_line_items"].select(
        "order_id", "line_item_id", F.col("quantity").alias("sold"), nothing.alias("back"),
        money(F.when(product, d * F.col("quantity"))).alias("sale"), money(F.lit(0)).alias("returned"),
        flag(product).alias("products"), F.lit(1).cast("long").alias("line_items"), none.alias("refund_rows"),
        F.col("quantity").cast("long").alias("units"), flag(F.col("quantity") > 1).alias("multi_units"),
        flag((F.col("quantity") < 1) | (F.col("current_quantity") > F.col("quantity"))).alias("invalid_quantities"),
        flag((o < 0) | (d < 0) | (d > o)).alias("inconsistent_prices"),
    )
    refunds = tables["refund_line_items"].select(
        "order_id", "line_item_id", nothing.alias("sold"), F.col("quantity").alias("back"),
        money(F.lit(0)).alias("sale"), money(F.col("subtotal")).alias("returned"),
        *[none.alias(c) for c in ("products", "line_items")], F.lit(1).cast("long").alias("refund_rows"),
        *[none.alias(c) for c in ("units", "multi_units", "invalid_quantities", "inconsistent_prices")],
    )
    counts = ["units", "multi_units", "invalid_quantities", "inconsistent_prices"]
    sums = [F.sum(c).alias(c) for c in counts]
    amounts = [F.sum(c).cast(TOTAL).alias(c) for c in ("sale", "returned")]
    total = lambda *cs: [F.sum(c).alias(c) for c in cs]

    by_line, exceeded = lines.union(refunds), none
    quantities = []
    if "refunds_over_line" in names:
        # Quantities of a key with their numbers of rows, so that the key itself holds few entries.
        by_line = by_line.groupBy("order_id", "line_item_id", "sold", "back").agg(
            *amounts, *total("products", "line_items", "refund_rows"), *sums
        )
        sold = F.collect_list(F.when(F.col("line_items") > 0, F.struct(F.col("sold").alias("q"), F.col("line_items").alias("n"))))
        back = F.collect_list(F.when(F.col("refund_rows") > 0, F.struct(F.col("back").alias("q"), F.col("refund_rows").alias("n"))))
        quantities = [sold.alias("sold"), back.alias("back")]

        def over(b: Column) -> Column:
            lower = F.filter("sold", lambda s: s["q"] < b["q"])
            return b["n"] * F.aggregate(lower, F.lit(0).cast("long"), lambda n, s: n + s["n"])

        exceeded = F.aggregate("back", F.lit(0).cast("long"), lambda n, b: n + over(b))
    by_line = by_line.groupBy("order_id", "line_item_id").agg(*amounts, *total("products", "line_items"), *sums, *quantities)
    net = F.when(F.col("products") > 0, F.coalesce("sale", F.lit(0)) - F.coalesce("returned", F.lit(0)) * F.col("products"))
    by_line = by_line.select(
        "order_id", net.cast(TOTAL).alias("net"), "line_items", *counts, exceeded.alias("refunds_over_line"),
        none.alias("orders"), F.lit(None).cast(TOTAL).alias("net_payment"), none.alias("negative_money"),
    )
    negative = (F.col("total_amount") < 0) | (F.col("total_paid") < 0) | (F.col("total_refunded") < 0)
    orders = tables["orders"].select(
        "order_id", F.lit(None).cast(TOTAL).alias("net"),
        *[none.alias(c) for c in ("line_items", *counts, "refunds_over_line")],
        F.lit(1).cast("long").alias("orders"), F.col("net_payment").cast(TOTAL).alias("net_payment"), flag(negative).alias("negative_money"),
    )
    counted = ["line_items", *counts, "refunds_over_line", "orders", "negative_money"]
    by_order = by_line.union(orders).groupBy("order_id").agg(
        F.sum("net").cast(TOTAL).alias("net"), F.sum("net_payment").cast(TOTAL).alias("net_payment"), *total(*counted)
    )
    booked = F.when(F.col("orders") > 0, F.col("net") * F.col("orders"))
    values = {
        "net_sales": F.sum(booked).cast(VALUE),
        "net_payment": F.sum("net_payment").cast(VALUE),
        **{c: F.coalesce(F.sum(c), F.lit(0)).cast(VALUE) for c in counted},
        "units": F.sum("units").cast(VALUE),
    }
    return by_order.agg(*[values[n].alias(n) for n in names])
