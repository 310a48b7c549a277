"""Verify-then-publish sink.

Tables are written to a new version folder, the checks run against what was
written, and a one-line marker written last makes the version current. A run
that fails leaves the published version as it was. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from shopmetrics.sources.tables import load_tables, write_table

# Order in which the dataset transforms may run, each once.
STEPS = ["anonymize", "perturb", "perturb_quantity"]


class CheckFailed(Exception):
    """A check on the written tables found violations; nothing was published."""


def guard_step(step: str, done: list[str], k: float | None = None) -> None:
    """Refuse a second run, a run out of order, or an unreasonable money factor."""
    if step in done:
        raise ValueError(f"{step} has already been applied")
    missing = [s for s in STEPS[: STEPS.index(step)] if s not in done]
    if missing:
        raise ValueError(f"{step} needs {missing[0]} to run first")
    if k is not None and not 0.1 <= k <= 5:
        raise ValueError("k must be between 0.1 and 5")


def _log_path(path: str) -> str:
    return f"{path}/_published"


def published(spark: SparkSession, path: str) -> tuple[str | None, list[str]]:
    """Current version folder and the steps applied so far."""
    try:
        log = spark.read.schema("seq bigint, version string, steps string").json(_log_path(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, []
    row = log.orderBy("seq", ascending=False).first()
    return f"{path}/{row['version']}", [s for s in row["steps"].split(",") if s]


def publish_checked(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    checks: Callable[[dict[str, DataFrame]], DataFrame],
    path: str,
    step: str | None = None,
    k: float | None = None,
) -> str:
    """Write, verify and publish a dataset; returns the version folder.

    ``checks`` gets scans of the written tables and returns violations, one row
    each. They are written next to the rejected version, and the error names their number and
    place. The marker is a single JSON row appended after every check passed.
    """
    _, done = published(spark, path)
    if step is not None:
        guard_step(step, done, k)
    version = f"v-{uuid.uuid4().hex}"
    target = f"{path}/{version}"
    for name, df in tables.items():
        write_table(df, name, target)
    written = load_tables(spark, target, list(tables))
    rejected = f"{target}-violations"
    checks(written).write.parquet(rejected)
    found = spark.read.parquet(rejected).count()
    if found:
        raise CheckFailed(f"{found} violations, listed in {rejected}")
    steps = ",".join([*done, step] if step else done)
    marker = spark.range(1).selectExpr(
        "unix_micros(current_timestamp()) AS seq", f"'{version}' AS version", f"'{steps}' AS steps"
    )
    marker.coalesce(1).write.mode("append").json(_log_path(path))
    return target
