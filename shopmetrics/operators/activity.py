"""Order activity as one row per customer: a bitmap of the months with an order.

Bits are kept in words of 60 months, (word number -> bits), so the calendar bounds a row however many orders it
stands for. A later month is added by its orders alone: bitmaps of equal customers are or-ed. Stored in
hash buckets of the customer, a month's load rewrites the buckets of its buyers. Retention and trend
reports take their months from here instead of from all orders. Bits are only ever added: where an order is
removed or changes its customer, the table is to be built again.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shopmetrics.functions.dates import BUSINESS_TZ, business_date, business_day_range, month_index
from shopmetrics.sources.partition_store import merge_bucketed, read_parts

WORD = 60
DDL = "customer_id bigint, months map<int,bigint>"
BUCKETS = 64


def _gathered(words: DataFrame) -> DataFrame:
    """One row per customer from rows (customer_id, word, bits)."""
    merged = words.groupBy("customer_id", "word").agg(F.bit_or("bits").alias("bits"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "bits"))))
    return merged.groupBy("customer_id").agg(entries.alias("months"))


def activity_bitmaps(orders: DataFrame, tz: str = BUSINESS_TZ) -> DataFrame:
    """(customer_id, months) of all customers with an order; orders without a customer are left out."""
    month = month_index(business_date("created_at", tz))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (month % WORD).cast("int"))
    known = orders.where("customer_id is not null and created_at is not null")
    word = F.call_function("div", month, F.lit(WORD)).cast("int")
    return _gathered(known.select("customer_id", word.alias("word"), bit.alias("bits")))


def combine(current: DataFrame, more: DataFrame) -> DataFrame:
    """Activity of both tables together."""
    return _gathered(current.unionByName(more).select("customer_id", F.explode("months").alias("word", "bits")))


def extend_activity(
    spark: SparkSession, root: str, orders: DataFrame, first: date, last: date, version: str, buckets: int = BUCKETS, tz: str = BUSINESS_TZ
) -> None:
    """Add the orders of the local days ``first`` to ``last``, and no others, to a stored activity table."""
    months = activity_bitmaps(orders.where(business_day_range("created_at", first, last, tz)), tz)
    merge_bucketed(spark, root, months, version, ["customer_id"], combine, buckets)


def stored_activity(spark: SparkSession, root: str) -> DataFrame:
    return read_parts(spark, root, StructType.fromDDL(DDL))


def months_between(first: Column, last: Column) -> Column:
    """Month indexes of a customer's orders from ``first`` to ``last``, ascending, from column ``months``."""

    def active(m: Column) -> Column:
        bits = F.coalesce(F.try_element_at("months", F.call_function("div", m, F.lit(WORD)).cast("int")), F.lit(0).cast("bigint"))
        return F.call_function("shiftright", bits, (m % WORD).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1

    return F.filter(F.sequence(first, last), active)
