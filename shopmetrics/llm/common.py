"""Shared pieces of the corpus operators: fresh names, byte views of Arrow text, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.sources.staging import stage

#: Text that one vectorised step looks at, so that a task's memory doesn't follow the size of an Arrow batch.
PIECE_BYTES = 1 << 20

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2^64; with them, differences of prefix sums hash any stretch of bytes."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, U)
        known[0] = U(1)
        known = _powers[int(base)] = np.multiply.accumulate(known)
    return known[:n]



def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying the text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer text is a range of its own, whole."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def components(edges: DataFrame, a: str, b: str, label: str, staged: bool = False) -> DataFrame:
    """(node, component) for every node of ``edges``: the smallest node reachable.

    Alternates large-star and small-star steps, which keep the number of edges from growing and
    need a logarithmic number of rounds. Each round is a grouped minimum (combined before the
    shuffle) and a join in which Spark may split a hot node. Loops and null ends are ignored.
    ``staged`` edges are scans of written tables with few repetitions, which needn't be written again.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    pairs = pairs if staged else stage(pairs.distinct(), f"{label}-edges")
    while True:
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u > v"), f"{label}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        pairs = stage(small.where("u > v").distinct(), f"{label}-small")
        # Stars at last: every node points to one other, which points to none.
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
        ends = ends.union(pairs.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if ends.where("out > 1 or out = 1 and into = 1").isEmpty():
            break
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stage(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), f"{label}-components")
