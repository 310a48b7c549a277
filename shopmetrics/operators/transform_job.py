"""A dataset transform as one guarded job: order of steps, transform, verification, publication, cleanup.

Nothing is published unless every check holds on what was written: the step's own checks, no reference that
lost its parent, and after an anonymisation no text that still names one of the given terms. Tables staged on the
way belong to the job's run and are removed at its end, whatever the outcome.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.functions.dates import BUSINESS_TZ
from shopmetrics.operators.perturb import perturb, perturb_checks, perturb_quantity, perturb_quantity_checks
from shopmetrics.operators.privacy import anonymize, anonymize_checks
from shopmetrics.operators.quality import reference_report, term_scan
from shopmetrics.sources.lazy import LazyTables, Tables
from shopmetrics.sources.publish import guard_step, publish_checked, published
from shopmetrics.sources.schema import DDL
from shopmetrics.sources.staging import staged_run
from shopmetrics.sources.tables import load_tables


def transformed(step: str, tables: Tables, salt: str, k: Decimal | None = None, terms: str | None = None, tz: str = BUSINESS_TZ) -> Tables:
    """The dataset after one of the publishable steps."""
    if step == "anonymize":
        if k is None:
            raise ValueError("anonymize needs k")
        return anonymize(tables, k, salt, terms)
    if step == "perturb":
        return perturb(tables, salt, tz)
    lines = [tables[n] for n in ("order_line_items", "orders", "refund_line_items")]
    return LazyTables({"order_line_items": lambda: perturb_quantity(*lines, salt, tz)}, tables)


def violations(step: str, before: Tables, after: Mapping[str, DataFrame], k: Decimal | None = None, terms: str | None = None) -> DataFrame:
    """Rows (kind, name, detail), one for each thing that forbids publication."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    if step == "anonymize":
        checks = anonymize_checks(before, after, k).withColumn("value", F.concat_ws(" -> ", text("before_value"), text("after_value")))
    else:
        checks = (perturb_checks if step == "perturb" else perturb_quantity_checks)(before, after)
    failed = checks.where("not coalesce(ok, true)").select(F.lit("check").alias("kind"), F.col("check_name").alias("name"), text("value").alias("detail"))
    old = reference_report(before).select("child", "parent", "key", F.col("rows").alias("old"))
    lost = reference_report(after).join(old, ["child", "parent", "key"]).where("rows > old")
    named = F.concat_ws(".", "child", "key").alias("name")
    parts = [failed, lost.select(F.lit("reference").alias("kind"), named, F.concat(F.lit("rows without parent: "), text("rows")).alias("detail"))]
    if step == "anonymize" and terms:
        hits = term_scan(after, terms)
        where = F.concat_ws(".", "table_name", "column_name").alias("name")
        parts.append(hits.select(F.lit("term").alias("kind"), where, F.concat(F.lit("rows: "), text("hits")).alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def run_step(
    spark: SparkSession, path: str, step: str, salt: str, k: Decimal | None = None, terms: str | None = None, tz: str = BUSINESS_TZ
) -> str:
    """Apply a step to the published dataset of ``path`` and publish the result; returns its folder.

    ``terms`` is a pattern of words that must not remain. Raises before any work if the step is out of order or was
    applied before, and ``CheckFailed`` if the result has violations, which are listed next to the rejected version.
    """
    version, done = published(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing has been published in {path}")
    guard_step(step, done, k)
    before = load_tables(spark, version, list(DDL))
    with staged_run(spark):
        after = transformed(step, before, salt, k, terms, tz)
        return publish_checked(spark, after, lambda written: violations(step, before, written, k, terms), path, step, k)
