"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors of one label are compared block by block: a block holds about ``BLOCK`` vectors, and every
pair of blocks is one tile, so that a hot label becomes many tasks. Vectors are scaled to unit
length and quantised to int8 with a scale and the exact error norm of each: for unit vectors u, v
with approximations u', v', |u.v - u'.v'| <= |u - u'| |v| + |u'| |v - v'|. The integer products of
a tile are exact (in float32 while they fit its mantissa, else in float64); only pairs whose product plus
bound reaches the threshold are computed again from the original components in double precision.

A tile returns no list of pairs: for each vector the weight of its partners, and the edges
of a spanning forest of the tile's links. Equal vectors of a label are one class and compared once.

Defined cases: vectors without label, null, empty or zero ones and those that hold a null or
non-finite component are linked with nothing and are their own component. Vectors of different
length are never linked. Rows that share an id are one node of the components; ``n_links`` counts
rows, those without an id too. A row without an id is no node: it has its copies' component, and connects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import components
from shopmetrics.sources.staging import stage

THRESHOLD = 0.98
BLOCK = 2048
_SLACK = 1e-9  # rounding of the double products and norms


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows, their scales and the norms of the errors, of vectors scaled to unit length."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127.0
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - small * scale[:, None], axis=1)
    return small, scale, error


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of the pairs whose cosine in double precision reaches the threshold (i < j if same)."""
    peaks = [np.abs(x).max(axis=1, keepdims=True) for x in (left, right)]
    left, right = left / peaks[0], right / peaks[1]  # keeps squares within the range of doubles
    (a, a_scale, a_error), (b, b_scale, b_error) = quantise(left), quantise(right)
    exact = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (a.astype(exact) @ b.astype(exact).T).astype(np.float64)
    product *= a_scale[:, None]
    product *= b_scale[None, :]
    bound = a_error[:, None] + (1.0 + a_error[:, None]) * b_error[None, :]
    product += bound
    i, j = np.nonzero(product >= threshold - _SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    norms = [np.linalg.norm(x, axis=1) for x in (left, right)]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        keep[at : at + (1 << 16)] = np.einsum("ij,ij->i", left[p], right[q]) / (norms[0][p] * norms[1][q]) >= threshold
    return i[keep], j[keep]


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component) that connect what the pairs of positions connect."""
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            return ids[root != ids], root[root != ids]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            sides = batch.column(0).slice(row, 1).flatten()
            blocks = []
            for k in range(len(sides)):
                members = sides.slice(k, 1).flatten()
                keys = members.field("key").to_numpy(zero_copy_only=False).astype(np.int64)
                named = members.field("rep").is_valid().to_numpy(zero_copy_only=False)
                ids = members.field("rep").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                weight = members.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                flat = members.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                blocks.append((keys, named, ids, weight, flat.reshape(len(ids), -1)))
            one, two = blocks[0], blocks[-1]
            same = len(blocks) == 1
            i, j = tile_links(one[4], two[4], same)
            keys, named, ids, weight = one[:4] if same else (np.concatenate(x) for x in zip(one[:4], two[:4], strict=True))
            j = j if same else j + len(one[0])
            partners = np.zeros(len(ids), np.int64)
            np.add.at(partners, i, weight[j])
            np.add.at(partners, j, weight[i])
            both = named[i] & named[j]
            a, b = forest(ids, i[both], j[both])
            linked = np.flatnonzero(partners)
            first = np.concatenate([keys[linked], a])
            other = pa.array(np.concatenate([np.zeros(len(linked), np.int64), b]), mask=np.arange(len(first)) < len(linked))
            count = np.concatenate([partners[linked], np.zeros(len(a), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(first), other, pa.array(count)], ["first", "other", "partners"])


def near_vectors(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = rows.where("label is not null and embedding is not null").where(finite)
    known = known.where(F.exists("embedding", lambda x: x != 0))
    classes = known.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # The written table pins the keys, which count the partners of classes with no id or a shared one.
    classes = stage(classes.withColumn("key", F.monotonically_increasing_id()), "vector-classes")
    size = F.size("embedding").alias("size")
    blocks = classes.groupBy("label", size).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    placed = classes.select("label", size, "key", "rep", "n", "embedding").join(blocks, ["label", "size"])
    placed = placed.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    packed = placed.groupBy("label", "size", "blocks", "own").agg(F.collect_list(F.struct("key", "rep", "n", "embedding")).alias("members"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = packed.select("label", "size", "own", "members", other)
    tiles = tiles.groupBy("label", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list("members").alias("sides")
    )
    # Beside a block without vectors there is nothing to compare.
    tiles = tiles.where("i = j or size(sides) = 2")
    found = stage(tiles.select("sides").mapInArrow(_tiles, "first long, other long, partners long"), "vector-links")
    # Rows of a class that carry different ids are linked, and so are classes that share an id.
    member = known.select("vec_id", "label", "embedding").where("vec_id is not null")
    shared = member.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    tied = member.join(shared, "vec_id").join(classes, ["label", "embedding"]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    edges = found.where("other is not null").select(F.col("first").alias("a"), F.col("other").alias("b")).union(tied)
    group = components(edges, "a", "b", "vector")
    partners = found.where("other is null").groupBy(F.col("first").alias("key")).agg(F.sum("partners").alias("partners"))
    named = classes.join(partners, "key", "left").join(group, F.col("rep") == F.col("node"), "left").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    out = rows.join(named, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").cast("long").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
