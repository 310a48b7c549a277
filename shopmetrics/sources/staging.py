"""Staged tables: a written copy that cuts lineage and pins its contents.

Anything that reads the same intermediate twice and must see the same physical
rows (global numbering) goes through here. A written table in the shared
folder survives the loss of executors; cached blocks do not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ALLOW_FILE = "shopmetrics.staging.allowFileScheme"

_run: ContextVar[str] = ContextVar("staged_run", default="stage")


def staging_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, else one in the warehouse of the session.

    A ``file:`` warehouse is a shared folder only on a local master or on a mount that all
    executors see; a cluster session says so by setting ``shopmetrics.staging.allowFileScheme``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = spark.sparkContext.master.split("[")[0] == "local"
    if root.startswith(("file:", "/")) and not local and spark.conf.get(ALLOW_FILE, "false") != "true":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder shared by all executors, or {ALLOW_FILE}=true")
    return f"{root}/_staged"


def stage(df: DataFrame, label: str, run_id: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    It belongs to ``run_id``, else to the ``staged_run`` around the call, which removes it at its end.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{run_id or _run.get()}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Like ``stage``, in hash buckets of ``keys``: joins and groups by these keys read it without a shuffle.

    There is one bucket per shuffle partition. Rows that come partitioned by ``keys`` make one file per bucket.
    The table's name leaves the catalogue at once; the files stay, and the returned scan reads them.
    """
    spark = df.sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    path = f"{staging_root(spark)}/{_run.get()}/{label}-{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *keys).saveAsTable(name)
    scan = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return scan


def clean_stage(spark: SparkSession, run_id: str) -> None:
    """Remove every table staged under ``run_id``, once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{staging_root(spark)}/{run_id}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staged_run(spark: SparkSession, run_id: str | None = None) -> Iterator[str]:
    """All tables staged inside belong to one run and are removed at its end, also if it fails.

    What is read from them has to be written or collected before.
    """
    run_id = run_id or f"run-{uuid.uuid4().hex}"
    token = _run.set(run_id)
    try:
        yield run_id
    finally:
        _run.reset(token)
        clean_stage(spark, run_id)
