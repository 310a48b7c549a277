"""Tables kept up to date in parts: a commit rewrites the parts it touches and leaves the files of all others.

A part is a value of one column (a month, a hash bucket of the key). Each commit writes its parts to a
folder of its own and then one manifest, which lists every part with its folder; the manifest with
the highest number is the current table. A commit that fails before its manifest changes nothing, one
that is repeated under the same version does nothing, and an older version can still be read until
``vacuum`` removes the folders that only such versions list. One writer at a time.

The manifest is read by the driver; it has a row per part, so parts are to be bounded: by the calendar, or by
the number of buckets, which is fixed by the first commit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "bucket_no"
_MANIFEST = "seq bigint, version string, layout string, part string, folder string"


def _versions(spark: SparkSession, root: str) -> list[Row]:
    """(seq, version, layout) of every version, oldest first; each manifest has one row without a part."""
    try:
        log = spark.read.schema(_MANIFEST).json(f"{root}/_manifest/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(log.where("part is null").select("seq", "version", "layout").collect())


def committed(spark: SparkSession, root: str) -> list[str]:
    """Versions of a store, oldest first."""
    return [r["version"] for r in _versions(spark, root)]


def _manifest_path(root: str, seq: int) -> str:
    return f"{root}/_manifest/{seq:012d}"


def _folders(spark: SparkSession, root: str, seq: int) -> dict[str, str]:
    rows = spark.read.schema(_MANIFEST).json(_manifest_path(root, seq)).where("part is not null").collect()
    return {r["part"]: r["folder"] for r in rows}


def listing(spark: SparkSession, root: str, as_of: str | None = None) -> dict[str, str]:
    """Folder of every part in the current version, or in the version ``as_of``."""
    versions = _versions(spark, root)
    named = [r for r in versions if as_of in (None, r["version"])]
    if as_of is not None and not named:
        raise ValueError(f"{root} has no version {as_of}")
    return _folders(spark, root, named[-1]["seq"]) if named else {}


def read_parts(
    spark: SparkSession, root: str, schema: StructType, parts: Iterable | None = None, as_of: str | None = None
) -> DataFrame:
    """Rows of a store; with ``parts``, only the folders of those are opened."""
    folders = listing(spark, root, as_of)
    wanted = folders if parts is None else [p for p in map(str, parts) if p in folders]
    paths = [f"{root}/{folders[p]}" for p in sorted(wanted)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def commit_parts(
    spark: SparkSession, root: str, rows: DataFrame, part_col: str, touched: Iterable, version: str, layout: str = ""
) -> None:
    """Replace the parts ``touched`` by ``rows``; a touched part without rows is gone afterwards.

    ``rows`` may read the store: it is written before the manifest changes. A large part is split over
    several tasks and files.
    """
    versions = _versions(spark, root)
    if versions and versions[-1]["layout"] != layout:
        raise ValueError(f"{root} was laid out as {versions[-1]['layout'] or 'plain parts'}, not as {layout or 'plain parts'}")
    if version in [r["version"] for r in versions]:
        return
    parts = {str(p) for p in touched}
    found = _write_parts(spark, f"{root}/{version}", rows, part_col) if parts else set()
    if found - parts:
        raise ValueError(f"rows of parts that are not touched: {sorted(found - parts)[:5]}")
    before = _folders(spark, root, versions[-1]["seq"]) if versions else {}
    now = {p: f for p, f in before.items() if p not in parts}
    now.update({p: f"{version}/_part={p}" for p in found})
    seq = versions[-1]["seq"] + 1 if versions else 1
    entries = [(seq, version, layout, None, None), *[(seq, version, layout, p, f) for p, f in sorted(now.items())]]
    # One task writes one file, which appears whole or not at all.
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").json(_manifest_path(root, seq))


def _write_parts(spark: SparkSession, target: str, rows: DataFrame, part_col: str) -> set[str]:
    """Write rows in a folder per part; returns the parts that have rows.

    The folders' column is a copy, so that a folder read by itself holds all columns.
    """
    marked = rows.withColumn("_part", F.col(part_col).cast("string"))
    marked.hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part").parquet(target)
    written = spark.read.schema(f"`{part_col}` {rows.schema[part_col].dataType.simpleString()}").parquet(target)
    return {str(r[0]) for r in written.distinct().collect()}


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_layout(keys: list[str], buckets: int) -> str:
    return f"{buckets} buckets of {','.join(keys)}"


def buckets_of(df: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """Buckets that the rows of ``df`` fall into, at most ``buckets``."""
    return [r[0] for r in df.select(bucket_of(keys, buckets)).distinct().collect()]


def merge_bucketed(
    spark: SparkSession,
    root: str,
    batch: DataFrame,
    version: str,
    keys: list[str],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int,
) -> None:
    """Merge a batch into a store of hash buckets of ``keys``, reading and rewriting the batch's buckets only.

    ``merge(current, batch)`` may combine rows of the same ``keys`` alone, as upserts and child replacements do.
    """
    layout = bucket_layout(keys, buckets)
    touched = buckets_of(batch, keys, buckets)
    schema = batch.schema
    current = read_parts(spark, root, schema, touched)
    merged = merge(current, batch).withColumn(BUCKET, bucket_of(keys, buckets))
    commit_parts(spark, root, merged, BUCKET, touched, version, layout)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all but the last ``keep`` manifests and the folders that only others list; returns those folders."""
    if keep < 1:
        raise ValueError("keep at least one version")
    versions = _versions(spark, root)
    old, recent = versions[:-keep], versions[-keep:]
    kept = {f for r in recent for f in _folders(spark, root, r["seq"]).values()}
    gone = {f for r in old for f in _folders(spark, root, r["seq"]).values()} - kept
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in [*[_manifest_path(root, r["seq"]) for r in old], *[f"{root}/{f}" for f in gone]]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return sorted(gone)
