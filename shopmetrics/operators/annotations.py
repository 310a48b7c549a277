"""Event notes: validated append, filtered listing, overlay on a trend."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.dates import check_range
from shopmetrics.operators.distributed import assign_row_numbers
from shopmetrics.sources.staging import stage

# Note categories.
CATEGORIES = ["campaign", "product", "incident", "promotion", "other"]
MAX_LENGTH = 200


def _problem() -> Column:
    """First rule a request breaks, NULL when it is valid."""
    title, category = F.col("title"), F.col("category")
    return (
        F.when(F.col("date").isNull(), "date is required")
        .when(title.isNull() | (title == ""), "title is required")
        .when(F.length(title) > MAX_LENGTH, "title is too long")
        .when(F.length("description") > MAX_LENGTH, "description is too long")
        .when(F.length("created_by") > MAX_LENGTH, "created_by is too long")
        .when(~category.isin(CATEGORIES), "category is unknown")
    )


def annotations_append(
    current: DataFrame, incoming: DataFrame, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split a batch into rows ready to append and rejected rows with the reason.

    Ids continue after the current maximum, in order of date, title and author.
    """
    checked = incoming.withColumn("category", F.coalesce("category", F.lit("other"))).withColumn(
        "reason", _problem()
    )
    rejected = checked.filter(F.col("reason").isNotNull())
    columns = ["date", "title", "description", "category", "created_by"]
    accepted = checked.filter(F.col("reason").isNull()).select(*columns)
    order = [F.col(c).asc_nulls_first() for c in ("date", "title", "created_by", "category", "description")]
    numbered = assign_row_numbers(accepted, order, "n", "notes")
    last_id = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()
    stamp = (F.localtimestamp() if now is None else now).alias("created_at")
    ready = numbered.select(
        (last_id + F.col("n")).cast("bigint").alias("id"), *columns, stamp, stamp.alias("updated_at")
    )
    return ready, rejected


def annotations_list(
    annotations: DataFrame, d0: date | None = None, d1: date | None = None, category: str | None = None
) -> DataFrame:
    """Notes of an optional inclusive range and category, newest first."""
    if d0 is not None and d1 is not None:
        check_range(d0, d1)
    out = annotations
    if d0 is not None:
        out = out.filter(F.col("date") >= F.lit(d0))
    if d1 is not None:
        out = out.filter(F.col("date") <= F.lit(d1))
    if category is not None:
        out = out.filter(F.col("category") == category)
    return out.orderBy(F.desc("date"), F.desc("id"))


def annotations_count(annotations: DataFrame) -> DataFrame:
    """Number of notes in a listing."""
    return annotations.agg(F.count("*").alias("total"))


def annotations_overlay(trend: DataFrame, annotations: DataFrame, grain: str = "day") -> DataFrame:
    """Trend points with the notes that fall into their bucket, one row per point and note.

    Points without notes keep one row. The long form leaves a day with very
    many notes spread over rows, and an inner join plus the bare points lets AQE
    split such a day, which it cannot do on the inner side of an outer join. The
    trend (one row per bucket) is written once and read twice.
    """
    points = stage(trend, "trend")
    bucket = F.col("date") if grain == "day" else F.trunc("date", grain)
    notes = annotations.select(bucket.alias("date"), F.col("id").alias("annotation_id"), "title", "category")
    bare = points.join(notes.select("date").distinct(), "date", "left_anti")
    return points.join(notes, "date").unionByName(bare, allowMissingColumns=True)
