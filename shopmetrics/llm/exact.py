"""Exact deduplication over an extendible-hash index that is written to shared files.

The index maps the 64-bit hash of a text to the entries of the distinct texts that have this
hash (its chain). Entries come from a grouping on hash and text, so texts are compared byte by
byte, and copies are combined before the shuffle: a group that holds a third of all rows
reaches its owner as one row per task. The directory starts at the depth that fits the number
of entries and is doubled until no bucket holds more than ``capacity`` entries; a bucket whose
hash prefix is shorter than the directory's depth is shared by several cells, as in any
extendible hash. Owner tasks each write a range of buckets, sorted by key, to shared storage; a chain
of several entries keeps their texts. A lookup takes a row's key to its cell, the cell to its bucket and the
bucket to the key's chain, along which the stored texts are compared byte by byte.

Defined cases: a null text equals the empty text; rows that agree in id and text are one group,
of which one row is kept; a null id is smaller than any other; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import fresh
from shopmetrics.sources.staging import stage

#: Distinct hashes that a bucket may hold before the directory splits it.
BUCKET_CAPACITY = 4096


def _key(text: Column, hash_bits: int) -> Column:
    low = 64 - hash_bits
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    return F.shiftleft(F.shiftrightunsigned(key, low), low) if low else key


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = BUCKET_CAPACITY, hash_bits: int = 64) -> tuple[DataFrame, int]:
    """Cells (cell, local_depth, bucket) of the directory over distinct ``keys`` and its global depth.

    Doubling ends when every bucket fits; a chain counts once, so equal hashes can't overfill one.
    """
    n = keys.count()
    start = depth = min(max(0, math.ceil(math.log2(max(1, n) / capacity))), hash_bits)
    while True:
        cells = keys.groupBy(_prefix(F.col("key"), depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        fullest = cells.agg(F.max("n")).first()[0] or 0
        if fullest <= capacity or depth == hash_bits:
            break
        depth += 1
    # A bucket stays at the shallowest depth at which it fits; the cells below point to the same one.
    local = F.lit(depth)
    for d in range(depth - 1, start - 1, -1):
        buddies = cells.groupBy(F.shiftright("cell", depth - d).alias("parent")).agg(F.sum("n").alias(f"n{d}"))
        cells = cells.withColumn("parent", F.shiftright("cell", depth - d)).join(buddies, "parent").drop("parent")
        local = F.when(F.col(f"n{d}") <= capacity, F.lit(d)).otherwise(local)
    cells = cells.select("cell", local.alias("local_depth"))
    bucket = F.expr(f"shiftleft(shiftright(cell, {depth} - local_depth), {depth} - local_depth)")
    return cells.select("cell", "local_depth", bucket.alias("bucket")), depth


def build_index(docs: DataFrame, capacity: int = BUCKET_CAPACITY, hash_bits: int = 64) -> tuple[DataFrame, DataFrame, int]:
    """The index and its directory: (entries, cells, depth).

    Entries: bucket, local_depth, key, chain_length, keep_id, group_size, text_sha256 and, where a key has a chain of
    several entries, the text that tells them apart. Each task owns a range of buckets and writes their entries in order of the key.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", _key(text, hash_bits).alias("key"), text.alias("text"))
    group = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    entries = rows.groupBy("key", "text").agg(*group).select("key", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"))
    entries = stage(entries, "exact-entries")
    chains = stage(entries.groupBy("key").agg(F.count(F.lit(1)).alias("chain_length")), "exact-chains")
    cells, depth = directory(chains.select("key"), capacity, hash_bits)
    cells = stage(cells, "exact-directory")
    entries = entries.withColumn("text", F.lit(None).cast("string")).join(chains, "key")
    chained = chains.where("chain_length > 1")
    if not chained.isEmpty():
        again = rows.join(chained, "key").groupBy("key", "chain_length", "text").agg(*group)
        again = again.withColumn("text_sha256", F.sha2("text", 256)).select(entries.columns)
        entries = entries.where("chain_length = 1").union(again)
    owned = _placed(entries, cells, depth).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    columns = ["bucket", "local_depth", "key", "chain_length", "keep_id", "group_size", "text_sha256", "text"]
    return stage(owned.select(columns), "exact-index"), cells, depth


def _placed(rows: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """Rows with the bucket that the directory names for their key."""
    return rows.withColumn("cell", _prefix(F.col("key"), depth)).join(cells, "cell").drop("cell")


def exact_groups(docs: DataFrame, capacity: int = BUCKET_CAPACITY, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _lookup(docs, capacity, hash_bits).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def _lookup(docs: DataFrame, capacity: int, hash_bits: int) -> DataFrame:
    """Every row's entry: the directory maps its key to a bucket, the bucket's entries of the key are its chain."""
    index, cells, depth = build_index(docs, capacity, hash_bits)
    found = ["keep_id", "group_size", "text_sha256"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", _key(text, hash_bits).alias("key"), text.alias("text"))
    same = F.count(F.lit(1)).alias("same")  # rows that agree in id and text
    asked = _placed(rows.groupBy("doc_id", "key").agg(same), cells, depth)
    answer = asked.join(index.where("chain_length = 1").select("bucket", "key", *found), ["bucket", "key"])
    answer = answer.select("doc_id", "key", "same", *found)
    chains = index.where("chain_length > 1")
    if not chains.isEmpty():
        # Along a chain the stored text decides, byte by byte.
        asked = rows.join(chains.select("key").distinct(), "key", "left_semi").groupBy("doc_id", "key", "text").agg(same)
        asked = _placed(asked, cells, depth).join(chains.select("bucket", "key", "text", *found), ["bucket", "key", "text"])
        answer = answer.union(asked.select("doc_id", "key", "same", *found))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "same")).alias("copy")
    answer = answer.select("doc_id", "key", *found, copies)
    return answer.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))


def exact_dedup(docs: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """The kept rows of ``docs`` with all their columns: of equal texts the row with the largest id."""
    key, goes_id, goes_key, columns = fresh(docs, "exact_key"), fresh(docs, "goes_id"), fresh(docs, "goes_key"), docs.columns
    answer = _lookup(docs.select("doc_id", "text"), capacity, 64)
    goes = answer.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        F.col("doc_id").alias(goes_id), F.col("key").alias(goes_key)
    )
    keyed = docs.withColumn(key, _key(docs["text"], 64))
    rest = keyed.join(goes, keyed["doc_id"].eqNullSafe(F.col(goes_id)) & (keyed[key] == F.col(goes_key)), "left_anti")
    if not answer.where("copy > 1").isEmpty():
        rest = rest.dropDuplicates(["doc_id", key])
    return rest.select(*columns)
