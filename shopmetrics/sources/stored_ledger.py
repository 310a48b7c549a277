"""The sales ledger as a stored table, partitioned by the month of its dates.

A filter through ``booked_in`` or ``booked_from`` reads the files of its months only, so the joins
behind the ledger run once per load and not once per report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DDL = (
    "row_type string, booked_at timestamp_ntz, date_key date, order_id bigint, order_name string, "
    "line_item_id bigint, sku string, title string, season_code string, line_status string, quantity int, "
    "amount decimal(18,2), restock_type string, month_key date"
)


def typed_ledger(ledger: DataFrame) -> DataFrame:
    """A ledger in the stored columns and types."""
    monthly = ledger.withColumn("month_key", F.trunc("date_key", "month"))
    return monthly.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(DDL).fields])


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Write a ledger to a new folder; a month that holds most rows is split over several tasks and files.

    ``streaming/ledger_sync.py`` keeps a ledger current without writing it whole.
    """
    typed_ledger(ledger).hint("rebalance", "month_key").write.mode("errorifexists").partitionBy("month_key").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Scan of a stored ledger."""
    return spark.read.schema(DDL).parquet(path)
