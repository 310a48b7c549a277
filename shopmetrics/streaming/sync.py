"""Sync of landed files with Structured Streaming.

Each run picks up the files that arrived since the last one
(``trigger(availableNow=True)``) and applies the same batch operators the
nightly load uses. Replaying a micro-batch after a failure gives the same
result: days are overwritten, snapshots are committed under the batch id.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shopmetrics.operators.ingest import overwrite_days, replace_children, upsert_snapshot
from shopmetrics.sources.partition_store import committed, merge_bucketed, read_parts
from shopmetrics.sources.schema import KEYS, table_schema

#: Hash buckets of a snapshot table; fixed once the first batch is stored.
BUCKETS = 64


def _landed(spark: SparkSession, landing: str, name: str) -> DataFrame:
    return spark.readStream.schema(table_schema(name)).parquet(f"{landing}/{name}")


def sync_days(
    spark: SparkSession, landing: str, target: str, name: str, date_col: str, checkpoint: str
) -> StreamingQuery:
    """Trailing re-fetch of a daily table: every delivered day replaces the stored one.

    A delivery holds whole days; only the partitions of those days are rewritten.
    A day delivered twice in one micro-batch keeps the newest row of each key.
    """

    def apply(batch: DataFrame, _: int) -> None:
        newest = upsert_snapshot(batch.limit(0), batch, KEYS[name][0], "updated_at")
        overwrite_days(batch.sparkSession, newest, f"{target}/{name}", date_col)

    return (
        _landed(spark, landing, name)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sync_snapshot(
    spark: SparkSession,
    landing: str,
    target: str,
    name: str,
    checkpoint: str,
    order_col: str | None = None,
    parent_key: str | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Upsert of a parent table (``order_col``) or child replacement (``parent_key``).

    The table is a store of hash buckets of the key: a micro-batch rewrites the buckets it touches
    and makes them current under its id; readers use :func:`current_snapshot`.
    """
    if (order_col is None) == (parent_key is None):
        raise ValueError("give either order_col or parent_key")
    keys = KEYS[name][0] if parent_key is None else [parent_key]
    if order_col is not None:
        merge = partial(upsert_snapshot, keys=keys, order_col=order_col)
    else:
        merge = partial(replace_children, parent_key=parent_key)

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_bucketed(batch.sparkSession, f"{target}/{name}", batch, f"batch-{batch_id:010d}", keys, merge, buckets)

    return (
        _landed(spark, landing, name)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_snapshot(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The current version of a synced snapshot table."""
    if not committed(spark, f"{target}/{name}"):
        raise FileNotFoundError(f"no version of {name} has been published in {target}")
    return read_parts(spark, f"{target}/{name}", table_schema(name))
