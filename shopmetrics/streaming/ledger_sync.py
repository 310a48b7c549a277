"""The stored sales ledger kept current by micro-batches of changed orders, lines and refunded lines.

A batch names the orders it touches. Their old ledger rows are those of the base tables as of the ledger's
last version, their new ones those after the batch; the months in which the two differ are rewritten without the
old rows and with the new ones, every other month keeps its files. Base tables are stores of hash buckets of the order
id, so a batch reads the buckets of its orders and not the tables. The ledger remembers no state but its
version: a batch that failed half-way finds its base tables merged, takes the old rows from their earlier
version and ends as if it had run once.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shopmetrics.functions.dates import BUSINESS_TZ
from shopmetrics.operators.ingest import replace_children, upsert_snapshot
from shopmetrics.operators.ledger import ledger_of
from shopmetrics.sources.partition_store import bucket_of, buckets_of, commit_parts, committed, listing, merge_bucketed, read_parts
from shopmetrics.sources.schema import table_schema
from shopmetrics.sources.staging import clean_stage, stage
from shopmetrics.sources.stored_ledger import DDL, typed_ledger

LEDGER = "net_sales_lines"
BUCKETS = 64
KEY = ["order_id"]

#: How a delivery of each base table changes the stored one.
MERGES = {
    "orders": partial(upsert_snapshot, keys=KEY, order_col="synced_at"),
    "order_line_items": partial(replace_children, parent_key="order_id"),
    "refund_line_items": partial(replace_children, parent_key="order_id"),
}


def apply_changes(
    spark: SparkSession,
    target: str,
    changes: dict[str, DataFrame],
    version: str,
    buckets: int = BUCKETS,
    tz: str = BUSINESS_TZ,
) -> None:
    """Merge one batch of ``changes`` (tables by name, those without change may be missing) and refresh the ledger.

    Lines and refunded lines are delivered whole per order, as the loaders do. Versions must not come back
    once a later one has been committed.
    """
    ledger = f"{target}/{LEDGER}"
    done = committed(spark, ledger)
    if version in done:
        return
    before = done[-1] if done else None
    run = f"ledger-{version}"
    typed = {n: changes[n].select(*table_schema(n).fieldNames()) for n in MERGES if n in changes}
    if not typed:
        return
    touched = stage(reduce(DataFrame.union, [df.select("order_id") for df in typed.values()]).distinct(), "touched", run)
    touched_buckets = buckets_of(touched, KEY, buckets)
    for name, merge in MERGES.items():
        # Every base table gets every version, so that it can be read as of any version of the ledger.
        batch = typed.get(name, spark.createDataFrame([], table_schema(name)))
        merge_bucketed(spark, f"{target}/{name}", batch, version, KEY, merge, buckets)

    def rows_of(as_of: str) -> DataFrame:
        parts = {
            name: read_parts(spark, f"{target}/{name}", table_schema(name), touched_buckets, as_of)
            .join(touched, "order_id", "left_semi")
            for name in MERGES
        }
        return typed_ledger(ledger_of(parts, tz))

    new = stage(rows_of(version), "new-rows", run)
    months = new.select("month_key")
    if before is not None:
        old = stage(rows_of(before), "old-rows", run)
        months = new.exceptAll(old).union(old.exceptAll(new)).select("month_key")
    months = [r[0] for r in months.distinct().collect()]  # bounded by the calendar
    kept = read_parts(spark, ledger, StructType.fromDDL(DDL), months).join(touched, "order_id", "left_anti")
    changed = new.where(F.col("month_key").isin(months))
    commit_parts(spark, ledger, kept.select(new.columns).union(changed), "month_key", months, version)
    clean_stage(spark, run)


def current_ledger(spark: SparkSession, target: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """The maintained ledger; with bounds, only the months from that of ``first`` to that of ``last`` are opened."""
    root = f"{target}/{LEDGER}"
    months = listing(spark, root)
    low = str(first.replace(day=1)) if first else ""
    high = str(last.replace(day=1)) if last else "9999-99-99"
    return read_parts(spark, root, StructType.fromDDL(DDL), [m for m in months if low <= m <= high])


def base_table(spark: SparkSession, target: str, name: str, order_ids: Iterable[int] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A maintained base table; for a few order ids only their buckets are opened."""
    root, schema = f"{target}/{name}", table_schema(name)
    if order_ids is None:
        return read_parts(spark, root, schema)
    asked = spark.createDataFrame([(i,) for i in order_ids], "order_id bigint")
    parts = [r[0] for r in asked.select(bucket_of(KEY, buckets)).distinct().collect()]
    return read_parts(spark, root, schema, parts).join(asked, "order_id", "left_semi")


def stream_ledger(
    spark: SparkSession, landing: str, target: str, checkpoint: str, buckets: int = BUCKETS, tz: str = BUSINESS_TZ
) -> StreamingQuery:
    """Apply the files landed for orders, lines and refunded lines since the last run, as one stream.

    The tables travel in one query, so a micro-batch holds what arrived together and one checkpoint covers all.
    """
    streams = []
    for name in MERGES:
        landed = spark.readStream.schema(table_schema(name)).parquet(f"{landing}/{name}")
        row = F.struct(*landed.columns)
        others = [F.lit(None).cast(table_schema(n)).alias(n) for n in MERGES if n != name]
        tagged = landed.select(F.lit(name).alias("table_name"), row.alias(name), *others)
        streams.append(tagged.select("table_name", *MERGES))

    def apply(batch: DataFrame, batch_id: int) -> None:
        changes = {n: batch.where(F.col("table_name") == n).select(f"{n}.*") for n in MERGES}
        apply_changes(batch.sparkSession, target, changes, f"batch-{batch_id:010d}", buckets, tz)

    return (
        reduce(DataFrame.union, streams)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
