"""Structural perturbation of an anonymised dataset, with self-verification.

Every draw is a salted hash of a key, so a rerun, a retried task or another
partitioning gives the same dataset.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.dates import BUSINESS_TZ, business_date
from shopmetrics.functions.draws import salted_uniform
from shopmetrics.functions.money import TOTAL, UNIT
from shopmetrics.functions.text import is_product_sku
from shopmetrics.operators.privacy import renumber_orders
from shopmetrics.operators.totals import sales_totals
from shopmetrics.sources.lazy import LazyTables, Tables
from shopmetrics.sources.staging import stage
from shopmetrics.sources.tables import derive_line_columns

RHO = "decimal(20,16)"


def _dec(value: str) -> Column:
    digits = len(value.replace(".", "").lstrip("0")) or 1
    scale = len(value.split(".")[1]) if "." in value else 0
    return F.lit(value).cast(f"decimal({max(digits, scale) + 1},{scale})")


def _draw(prefix: str, value: Column, salt: str) -> Column:
    return salted_uniform(F.concat(F.lit(prefix), value.cast("string")), salt)


def drop_rate(created_at: Column, salt: str, tz: str = BUSINESS_TZ) -> Column:
    """Share of the orders of a moment to drop: 5 % plus a month and a day component."""
    day = business_date(created_at, tz)
    month_draw = _draw("m", F.date_format(day, "yyyy-MM"), salt)
    day_draw = _draw("d", day, salt)
    return _dec("0.05") + _dec("0.20") * month_draw + _dec("0.10") * (day_draw - _dec("0.5"))


def drop_orders(tables: Tables, salt: str, tz: str = BUSINESS_TZ) -> Tables:
    """Thin out orders; everything that belongs to a dropped order goes with it."""
    t = tables
    keep = _draw("o", F.col("order_id"), salt) >= drop_rate(F.col("created_at"), salt, tz)
    children = ["order_attribution", "order_discounts", "order_line_items", "refund_line_items", "refunds"]

    def kept(child: str) -> DataFrame:
        return t[child].join(ids["kept"], "order_id", "left_semi")

    # Six tables ask which orders stay: drawn once, their ids written.
    ids = LazyTables({"kept": lambda: stage(t["orders"].filter(keep).select("order_id"), "kept-orders")})
    out = LazyTables(
        {
            "orders": lambda: t["orders"].filter(keep),
            **{child: partial(kept, child) for child in children},
            "line_item_discount_allocations": lambda: t["line_item_discount_allocations"].join(
                out["order_line_items"].select("line_item_id"), "line_item_id", "left_semi"
            ),
        },
        tables,
    )
    return out


def refunded_lines(refund_lines: DataFrame) -> DataFrame:
    return refund_lines.select("order_id", "line_item_id").distinct()


def line_factors(lines: DataFrame, refund_lines: DataFrame, salt: str) -> DataFrame:
    """Lines with ``price_from``/``price_to`` (their price ratio) and ``times`` (their quantity factor).

    Each product has one factor between 0.70 and 1.40, snapped to a price ending
    in .99. Single units nothing ever happened to become 2, 3 or 4 units.
    """
    marked = lines.join(
        refunded_lines(refund_lines).withColumn("has_refund", F.lit(True)), ["order_id", "line_item_id"], "left"
    )
    price = F.coalesce("original_unit_price", F.lit(0))
    changeable = is_product_sku(F.col("sku")) & (price > 0)
    factor = _dec("0.70") + _dec("0.70") * _draw("p", F.col("title"), salt)
    snapped = F.greatest(F.round(F.col("original_unit_price") * F.col("_factor"), 0) - _dec("0.01"), _dec("0.99"))
    repriced = changeable & F.col("title").isNotNull()
    untouched = (
        changeable
        & (F.col("quantity") == 1)
        & (F.coalesce("current_quantity", F.lit(0)) == 1)
        & (F.col("returned_quantity") <= 0)
        & F.col("has_refund").isNull()
    )
    u = F.col("_u")
    times = F.when(u < _dec("0.12"), 2).when(u < _dec("0.16"), 3).when(u < _dec("0.18"), 4)
    return (
        # Each digest is computed once, and only where it is used.
        marked.withColumns(
            {
                "_factor": F.when(repriced, factor),
                "_u": F.when(untouched, _draw("q", F.col("line_item_id"), salt)),
            }
        )
        .withColumns(
            {
                "price_from": F.when(repriced, F.col("original_unit_price")).otherwise(1).cast(UNIT),
                "price_to": F.when(repriced, snapped).otherwise(1).cast(UNIT),
                "times": times.otherwise(1),
            }
        )
        .drop("has_refund", "_factor", "_u")
    )


def _repriced(amount: str) -> Column:
    """Amount times the price ratio; multiplying first keeps exact half cents exact."""
    return F.col(amount) * F.col("price_to") / F.col("price_from")


def perturb_lines(lines: DataFrame, refund_lines: DataFrame, salt: str) -> DataFrame:
    """New prices and quantities, next to the value and ratio of the line before."""
    f = line_factors(lines, refund_lines, salt).withColumn(
        "old_net", (F.col("discounted_unit_price") * F.col("quantity")).cast(TOTAL)
    )
    quantities = ["quantity", "current_quantity", "unfulfilled_quantity", "non_fulfillable_quantity"]
    return derive_line_columns(
        f.withColumns(
            {
                "original_unit_price": F.round(_repriced("original_unit_price"), 2).cast(UNIT),
                "discounted_unit_price": F.round(_repriced("discounted_unit_price"), 2).cast(UNIT),
                **{q: F.col(q) * F.col("times") for q in quantities},
            }
        )
    )


def perturb_allocations(allocations: DataFrame, new_lines: DataFrame) -> DataFrame:
    """Discount allocations follow the price and quantity of their line; one without a line stays as it is."""
    f = new_lines.select("line_item_id", "price_from", "price_to", "times")
    grown = F.col("allocated_amount") * F.col("times").cast("decimal(1,0)")
    amount = F.coalesce(F.round(grown * F.col("price_to") / F.col("price_from"), 2), F.col("allocated_amount"))
    return (
        allocations.join(f, "line_item_id", "left")
        .withColumn("allocated_amount", amount.cast(UNIT))
        .select(*allocations.columns)
    )


def perturb_refund_lines(refund_lines: DataFrame, new_lines: DataFrame) -> DataFrame:
    """Refunded values follow the price of their line, with ``old_subtotal`` kept for the refunds."""
    f = new_lines.select("order_id", "line_item_id", "price_from", "price_to")
    amount = F.coalesce(F.round(_repriced("subtotal"), 2), F.col("subtotal"))
    return (
        refund_lines.join(f, ["order_id", "line_item_id"], "left")
        .withColumns({"old_subtotal": F.col("subtotal"), "subtotal": amount.cast(UNIT)})
        .select(*refund_lines.columns, "old_subtotal")
    )


def order_ratios(new_lines: DataFrame) -> DataFrame:
    """New over old line value per order (``rho``), 1 where there was none."""
    sums = new_lines.groupBy("order_id").agg(
        F.sum("old_net").cast(TOTAL).alias("old_net"),
        F.sum(F.col("discounted_unit_price") * F.col("quantity")).cast(TOTAL).alias("new_net"),
    )
    ratio = F.when(F.col("old_net") > 0, F.col("new_net") / F.nullif(F.col("old_net"), F.lit(0)))
    return sums.select("order_id", F.coalesce(ratio.cast(RHO), F.lit(1)).cast(RHO).alias("rho"))


def _by_rho(amount: str, kind: str) -> Column:
    return F.round(F.col(amount) * F.coalesce("rho", F.lit(1)).cast(RHO), 2).cast(kind)


def rederive_refunds(refunds: DataFrame, new_refund_lines: DataFrame, ratios: DataFrame) -> DataFrame:
    """Refund cash after the change, with ``old_total`` kept for the order totals.

    Cash follows the booked lines; without lines it follows the order; a refund
    without cash stays without.
    """
    booked = new_refund_lines.groupBy("refund_id").agg(
        F.sum("old_subtotal").cast(TOTAL).alias("old_alloc"), F.sum("subtotal").cast(TOTAL).alias("new_alloc")
    )
    total = F.col("total_refunded")
    # Multiplied first, in a type that leaves the quotient ten decimals.
    scaled = (total * F.col("new_alloc")).cast("decimal(30,4)")
    by_lines = F.round(scaled / F.nullif(F.col("old_alloc"), F.lit(0)), 2)
    return (
        refunds.join(booked, "refund_id", "left")
        .join(ratios, "order_id", "left")
        .withColumn("old_total", total)
        .withColumn(
            "total_refunded",
            F.when(total == 0, F.lit(0).cast(UNIT))
            .when(F.col("old_alloc") > 0, by_lines.cast(UNIT))
            .otherwise(_by_rho("total_refunded", UNIT)),
        )
        .select(*refunds.columns, "old_total")
    )


def rederive_orders(orders: DataFrame, new_refunds: DataFrame, ratios: DataFrame) -> DataFrame:
    """Order totals that follow the new lines and refunds."""
    deltas = new_refunds.groupBy("order_id").agg(
        F.sum(F.col("total_refunded") - F.col("old_total")).cast(TOTAL).alias("delta")
    )
    zero = F.lit(0).cast(TOTAL)
    delta = F.coalesce("delta", zero)
    amount, paid = _by_rho("total_amount", TOTAL), _by_rho("total_paid", TOTAL)
    changed = (
        orders.join(ratios, "order_id", "left")
        .join(deltas, "order_id", "left")
        .withColumns(
            {
                "_amount": amount,
                "_paid": paid,
                "_refunded": F.greatest((F.col("total_refunded") + delta).cast(TOTAL), zero),
                "_current": F.greatest(
                    (F.col("current_total") + amount - F.col("total_amount") - delta).cast(TOTAL), zero
                ),
                "_net": (F.col("net_payment") + paid - F.col("total_paid") - delta).cast(TOTAL),
            }
        )
    )
    new = {
        "total_amount": "_amount", "total_paid": "_paid", "total_refunded": "_refunded",
        "current_total": "_current", "net_payment": "_net",
    }
    return changed.select(*[F.col(new.get(c, c)).alias(c) for c in orders.columns])


def rederive_discounts(discounts: DataFrame, ratios: DataFrame) -> DataFrame:
    """Absolute discounts follow their order's ratio."""
    return (
        discounts.join(ratios, "order_id", "left")
        .withColumn("value_amount", _by_rho("value_amount", UNIT))
        .select(*discounts.columns)
    )


def rederive_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Lifetime fields recomputed from the orders; customers without orders are dropped.

    The first and last order of one instant are told apart by order id.
    """
    key = F.struct("created_at", "order_id")
    stats = orders.groupBy("customer_id").agg(
        F.count("*").cast("int").alias("n"),
        F.sum("net_payment").cast(TOTAL).alias("spent"),
        F.min(key).alias("first"),
        F.max(key).alias("last"),
    )
    return (
        customers.join(stats, "customer_id")
        .withColumns(
            {
                "number_of_orders": F.col("n"),
                "amount_spent": F.col("spent"),
                "first_order_id": F.col("first.order_id"),
                "first_purchase_at": F.col("first.created_at"),
                "last_order_id": F.col("last.order_id"),
                "last_order_at": F.col("last.created_at"),
                "customer_since": F.least("customer_since", F.col("first.created_at")),
            }
        )
        .select(*customers.columns)
    )


CHANGE_COLUMNS = [
    "order_id", "line_item_id", "price_from", "price_to", "times", "old_net", "discounted_unit_price", "quantity",
]


def perturb_steps(t: Tables, salt: str, whole: bool = False) -> Tables:
    """Intermediate results of a perturbation, planned on first use.

    What changes on each line feeds the order ratios, the refund lines and the
    allocations, so those few columns are written once instead of being joined
    together again for each. ``whole`` writes all columns of the lines, and the refund lines too,
    for a caller that goes on to read the lines themselves.
    """

    def refund_lines() -> DataFrame:
        changed = perturb_refund_lines(t["refund_line_items"], steps["changes"])
        return stage(changed, "refund-lines") if whole else changed

    steps = LazyTables(
        {
            "lines": lambda: perturb_lines(t["order_line_items"], t["refund_line_items"], salt),
            "changes": lambda: stage(steps["lines"] if whole else steps["lines"].select(*CHANGE_COLUMNS), "changes"),
            "ratios": lambda: order_ratios(steps["changes"]),
            "refund_lines": refund_lines,
            "refunds": lambda: rederive_refunds(t["refunds"], steps["refund_lines"], steps["ratios"]),
            "orders": lambda: rederive_orders(t["orders"], steps["refunds"], steps["ratios"]),
        }
    )
    return steps


def perturb(tables: Tables, salt: str, tz: str = BUSINESS_TZ, renumber: bool = True) -> Tables:
    """Dropped orders, new prices and quantities, and everything that follows from them.

    Without ``renumber`` the orders keep their names, which no check reads.
    """
    t = drop_orders(tables, salt, tz)
    steps = perturb_steps(t, salt, whole=True)
    out = LazyTables(
        {
            "order_line_items": lambda: steps["changes"].drop("old_net", "price_from", "price_to", "times"),
            "line_item_discount_allocations": lambda: perturb_allocations(
                t["line_item_discount_allocations"], steps["changes"]
            ),
            "refund_line_items": lambda: steps["refund_lines"].drop("old_subtotal"),
            "refunds": lambda: steps["refunds"].drop("old_total"),
            "order_discounts": lambda: rederive_discounts(t["order_discounts"], steps["ratios"]),
            "orders": lambda: renumber_orders(steps["orders"]) if renumber else steps["orders"],
            # Numbering writes the orders, so the customers read them from there.
            "customers": lambda: rederive_customers(t["customers"], out["orders"]),
        },
        t,
    )
    return out


def quantity_draws(
    lines: DataFrame, orders: DataFrame, refund_lines: DataFrame, salt: str, tz: str = BUSINESS_TZ
) -> DataFrame:
    """Lines that gain units: their id and the new quantity."""
    eligible = (
        lines.filter(
            (F.col("quantity") == 1)
            & (F.coalesce("current_quantity", F.lit(0)) == 1)
            & (F.col("returned_quantity") == 0)
            & (F.col("original_unit_price") > 0)
            & F.col("title").isNotNull()
            & is_product_sku(F.col("sku"))
        )
        .select("order_id", "line_item_id", "title")
        .join(refunded_lines(refund_lines), ["order_id", "line_item_id"], "left_anti")
        .join(orders.select("order_id", "created_at"), "order_id")
    )
    month = F.date_format(business_date("created_at", tz), "yyyy-MM")
    strength = _dec("0.10") + _dec("0.35") * _draw("m", month, salt)
    p = F.least(_dec("0.95"), strength * (_dec("0.50") + _draw("t", F.col("title"), salt)))
    u, v = _draw("q", F.col("line_item_id"), salt), _draw("s", F.col("line_item_id"), salt)
    new_q = F.when(v < _dec("0.70"), 2).when(v < _dec("0.92"), 3).otherwise(4)
    return eligible.filter(u < p).select("order_id", "line_item_id", new_q.alias("new_quantity"))


def perturb_quantity(
    lines: DataFrame, orders: DataFrame, refund_lines: DataFrame, salt: str, tz: str = BUSINESS_TZ
) -> DataFrame:
    """More units at constant line value: unit prices shrink by the factor the quantity grows."""
    drawn = quantity_draws(lines, orders, refund_lines, salt, tz)
    q = F.col("new_quantity")
    grown = q.isNotNull()

    def price(name: str) -> Column:
        return F.when(grown, F.round(F.col(name) / F.nullif(q, F.lit(0)), 2).cast(UNIT)).otherwise(F.col(name))

    def follow(name: str) -> Column:
        return F.when(grown & (F.col(name) == F.col("quantity")), q).otherwise(F.col(name))

    changed = lines.join(drawn, ["order_id", "line_item_id"], "left").withColumns(
        {
            "original_unit_price": price("original_unit_price"),
            "discounted_unit_price": price("discounted_unit_price"),
            "unfulfilled_quantity": follow("unfulfilled_quantity"),
            "non_fulfillable_quantity": follow("non_fulfillable_quantity"),
            "quantity": F.coalesce("new_quantity", "quantity"),
            "current_quantity": F.coalesce("new_quantity", "current_quantity"),
        }
    )
    return derive_line_columns(changed).select(*lines.columns)


# --- verification ------------------------------------------------------------


LINE_CHECKS = ["invalid_quantities", "refunds_over_line", "inconsistent_prices"]


def _judged(row: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(check_name, value, ok) from a row of totals and a condition on it per check; an unknown outcome passes."""
    checks = [
        F.struct(F.lit(n).alias("check_name"), F.col(n).cast("decimal(28,4)").alias("value"), F.coalesce(ok, F.lit(True)).alias("ok"))
        for n, ok in conditions.items()
    ]
    return row.select(F.inline(F.array(*checks)))


def perturb_checks(before: Tables, after: Tables) -> DataFrame:
    """Quantities, refunds and prices valid, no negative money, and the dataset really changed.

    One pass over the lines, refunded lines and orders afterwards, one over the orders before.
    """
    old_orders = before["orders"].agg(F.count("*")).scalar()
    counted = [*LINE_CHECKS, "negative_money", "orders", "line_items", "multi_units"]
    new = sales_totals(after, counted).withColumnRenamed("orders", "orders_changed")
    share = F.col("multi_units").cast("decimal(18,0)") / F.nullif(F.col("line_items").cast("decimal(18,0)"), F.lit(0))
    new = new.withColumn("multi_unit_share", F.round(share, 4))
    conditions = {
        **{n: F.col(n) == 0 for n in [*LINE_CHECKS, "negative_money"]},
        "orders_changed": F.col("orders_changed") != old_orders,
        "multi_unit_share": F.col("multi_unit_share") >= _dec("0.05"),
    }
    return _judged(new, conditions)


def perturb_quantity_checks(before: Tables, after: Tables) -> DataFrame:
    """Lines still valid, at least 5 % more units, net sales within 0.1 %; one pass over the tables of either side."""
    old = sales_totals(before, ["units", "net_sales"]).select(F.struct("units", "net_sales")).scalar()
    new = sales_totals(after, [*LINE_CHECKS, "units", "net_sales"])
    new = new.withColumnsRenamed({"units": "units_grew", "net_sales": "net_sales_held"})
    net = old["net_sales"]
    conditions = {
        **{n: F.col(n) == 0 for n in LINE_CHECKS},
        "units_grew": F.col("units_grew") >= old["units"] * _dec("1.05"),
        "net_sales_held": F.abs(F.col("net_sales_held") - net) <= F.abs(net) * _dec("0.001"),
    }
    return _judged(new, conditions)
