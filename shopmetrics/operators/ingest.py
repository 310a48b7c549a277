"""Incremental loading: upserts, child replacement, trailing re-fetch, reference resolution."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order_cols``.

    A ``max`` of structs keeps one running row per key and combines before the
    shuffle, so a key with very many versions is never sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    packed = F.max(F.struct(*order_cols, *rest)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns]
    )


def upsert_snapshot(current: DataFrame, incoming: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Insert-or-update: incoming rows win over current ones of the same key.

    Several incoming versions of a key resolve to the newest by ``order_col``.
    """
    versions = current.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    return latest_per_key(versions, keys, ["_batch", order_col]).drop("_batch")


def replace_children(current: DataFrame, incoming: DataFrame, parent_key: str) -> DataFrame:
    """Delete-and-reinsert: every child of a parent in the batch is replaced."""
    touched = incoming.select(parent_key).distinct()
    return current.join(touched, parent_key, "left_anti").unionByName(incoming)


def refetch_window(
    current: DataFrame, incoming: DataFrame, date_col: str, days: int, last_day: date
) -> DataFrame:
    """Rewrite the trailing ``days`` days up to ``last_day`` with what was fetched again."""
    first = F.lit(last_day - timedelta(days=days - 1))
    recent = F.col(date_col).between(first, F.lit(last_day))
    return current.filter(~recent | F.col(date_col).isNull()).unionByName(incoming.filter(recent))


def overwrite_days(spark: SparkSession, incoming: DataFrame, path: str, date_col: str) -> None:
    """Sink of the trailing re-fetch: replaces only the date partitions present in ``incoming``."""
    # Rebalanced by day: a day that holds most rows is split over several tasks and files.
    (
        incoming.hint("rebalance", date_col)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date_col)
        .parquet(path)
    )


def pending_attribution(attribution: DataFrame) -> DataFrame:
    """Orders whose attribution is not final and must be fetched again."""
    return attribution.filter(~F.col("journey_ready")).select("order_id", "updated_at")


def resolve_discount_allocations(alloc: DataFrame, lines: DataFrame, discounts: DataFrame) -> DataFrame:
    """Replace the discount name of each allocation by the discount id of the line's order.

    When an order carries the same name twice the first position is taken. An
    allocation delivered with its order id joins its line on both keys.
    """
    line_keys = ["order_id", "line_item_id"] if "order_id" in alloc.columns else ["line_item_id"]
    named = discounts.groupBy("order_id", "code_or_title").agg(
        F.min_by("id", "position").alias("order_discount_id")
    )
    return (
        alloc.join(lines.select("order_id", "line_item_id"), line_keys)
        .join(named, ["order_id", "code_or_title"])
        .select("id", "line_item_id", "order_discount_id", "allocated_amount", "currency")
    )
