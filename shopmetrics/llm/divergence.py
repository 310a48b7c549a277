"""Source divergence audit: how far the word use of each source lies from that of the other sources of its language.

Tasks count terms in bounded tables before the one shuffle of counts. A term of a language is a row: its
nonzero counts, in the order of the sources. Rows that read alike are one row with a multiplicity; sorted,
they are the paths of a frequent-pattern tree, whose nodes are the prefixes of the rows. A task holds a range of
the sorted rows, and a node's multiplicity is the number of rows that pass through it. The sum of a pair of
sources (a, b) starts from the value that two missing counts would give, for every term; what a single
source's counts change comes from its counts with their multiplicities, and what two present counts
change beyond that is added once for each node of b and ancestor of a, times the node's multiplicity.

All numbers are integers: shares are scaled by 10^9 after smoothing by 2, so sums don't depend on the order.
f(p, q) is at most p + q, hence a sum over V terms is at most 4 * 10^9 + 4 * V and fits a bigint.

Defined cases: null text, lang and source count as ''; a group without terms, and one of a language
that keeps no term, has its ``pair`` rows (value from smoothing alone, 0 without kept terms) and no ``term``
rows; a language of one source has no ``pair`` rows; repeated rows count each time; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.llm.common import PIECE_BYTES, utf8
from shopmetrics.sources.staging import stage

#: Documents of a language that a kept term occurs in, at least.
MIN_DOCS = 10
#: Terms listed for each group.
TOP_TERMS = 10
SCALE, SMOOTHING = 10**9, 2

#: Entries of a task's count tables before they are emitted and begun anew.
TABLE_ENTRIES = 1 << 18
#: Combinations of a node and an ancestor that one vectorised step works on.
PAIR_BLOCK = 1 << 19

#: Letters in lower case, everything from 0x80 on as it is, all else a separator.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"
SUMS = "lang string, a string, b string, value long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each (lang, source), in tables of bounded size."""
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in tables.items():
            terms = list(occurrences)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(occurrences.values(), pa.int64()),
                    pa.array([documents[t] for t in terms], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        tables.clear()

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for k, group in enumerate(groups):
            occurrences, documents = tables.setdefault(group, (Counter(), Counter()))
            entries -= len(occurrences)
            text = data[offsets[k] : offsets[k + 1]].tobytes().translate(FOLD)
            distinct: set[bytes] = set()
            at = 0
            while at < len(text):
                # A long text goes in pieces that end at a separator.
                cut = text.find(b" ", at + PIECE_BYTES)
                words = text[at : cut if cut >= 0 else len(text)].split()
                occurrences.update(words)
                distinct.update(words)
                at = cut + 1 if cut >= 0 else len(text)
            documents.update(distinct)
            entries += len(occurrences)
            if entries > TABLE_ENTRIES:
                yield from flushed()
                entries = 0
    yield from flushed()


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a count in 10^-9, in exact decimals; null without kept terms."""
    part = (count.cast("decimal(20,0)") + SMOOTHING) * F.lit(SCALE).cast("decimal(11,0)")
    whole = total.cast("decimal(20,0)") + terms.cast("decimal(20,0)") * SMOOTHING
    return F.lit(1).cast("long") + F.call_function("div", part, F.nullif(whole, F.lit(0).cast("decimal(20,0)")))


def tree_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pair corrections over the tree of sorted rows (lang, path, times).

    A batch is a subtree of its own: the node at depth d of row i is new where the rows i - 1 and i differ
    within their first d + 1 elements, and its multiplicity is the number of rows up to the next new
    node of that depth or a lesser one.
    """
    sums: Counter = Counter()

    def flushed() -> Iterator[pa.RecordBatch]:
        if sums:
            keys = list(zip(*sums, strict=True))
            columns = [pa.array(k, pa.string()) for k in keys] + [pa.array(sums.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])
            sums.clear()

    for batch in batches:
        for first, last in _runs(batch.column("lang").to_pylist()):
            lang = batch.column("lang")[first].as_py()
            part = batch.slice(first, last - first)
            for a, b, value in _subtree(part.column("path"), part.column("times").to_numpy(zero_copy_only=False)):
                sums[lang, a, b] += value
            if len(sums) > TABLE_ENTRIES:
                yield from flushed()
    yield from flushed()


def _runs(values: list) -> Iterator[tuple[int, int]]:
    first = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[first]:
            yield first, k
            first = k


def _subtree(paths: pa.Array, times: np.ndarray) -> Iterator[tuple[str, str, int]]:
    """(a, b, sum of corrections) of one language's sorted rows."""
    flat = paths.flatten()
    sizes = paths.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    names = flat.field("source").dictionary_encode()
    source = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = names.dictionary.to_pylist()
    p = flat.field("p").to_numpy(zero_copy_only=False)
    p0 = flat.field("p0").to_numpy(zero_copy_only=False)

    # Nodes: elements of a row beyond what it shares with the row before. The stack holds the open path.
    node_at, node_depth = [], []
    multiplicity: list[int] = []
    stack: list[int] = []
    before: list[tuple[int, int]] = []
    for start, size, n in zip(starts.tolist(), sizes.tolist(), times.tolist(), strict=True):
        row = list(zip(source[start : start + size].tolist(), p[start : start + size].tolist(), strict=True))
        shared = 0
        while shared < min(len(row), len(before)) and row[shared] == before[shared]:
            shared += 1
        del stack[shared:]
        for depth in range(shared, size):
            stack.append(len(multiplicity))
            multiplicity.append(0)
            node_at.append(start)
            node_depth.append(depth)
        for node in stack:
            multiplicity[node] += n
        before = row

    at, depth, weight = (np.array(x, np.int64) for x in (node_at, node_depth, multiplicity))
    total: Counter = Counter()
    ends = np.cumsum(depth)
    first = 0
    while first < len(depth):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIR_BLOCK, side="right")))
        d = depth[first:last]
        owner = np.repeat(np.arange(first, last), d)
        above = at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(d) - d, d)
        own = at[owner] + depth[owner]
        pa_, pb, a0, b0 = p[above], p[own], p0[above], p0[own]
        value = weight[owner] * (distance(pa_, pb) - distance(pa_, b0) - distance(a0, pb) + distance(a0, b0))
        pair, inverse = np.unique(source[above] * len(names) + source[own], return_inverse=True)
        sums = np.zeros(len(pair), np.int64)
        np.add.at(sums, inverse, value)
        for key, s in zip(pair.tolist(), sums.tolist(), strict=True):
            total[key] += s
        first = last
    for key, s in total.items():
        yield names[key // len(names)], names[key % len(names)], s


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` against each other source, ``term`` against the language."""
    empty = F.lit("")
    docs = documents.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), "text")
    counted = docs.mapInArrow(count_terms, COUNTS).repartition("lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entry = F.struct("source", "n")
    rows = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(entry).alias("counts"))
    rows = stage(rows.where(F.col("docs") >= min_docs).drop("docs"), "divergence-rows")

    # One row per group: what its shares need.
    entries = rows.select("lang", "term", F.explode("counts").alias("c"), F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("in_lang"))
    entries = entries.select("lang", "term", "c.source", "c.n", "in_lang")
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms = rows.groupBy("lang").agg(F.count("*").alias("terms"))
    whole = sizes.groupBy("lang").agg(F.sum("size").alias("lang_size"))
    size, kept = F.coalesce("size", F.lit(0)), F.coalesce("terms", F.lit(0))
    groups = docs.select("lang", "source").distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(terms, "lang", "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", size.alias("size"), kept.alias("terms"), F.coalesce("lang_size", F.lit(0)).alias("lang_size"))
    groups = stage(groups.withColumn("p0", _share(F.lit(0), F.col("size"), F.col("terms"))), "divergence-groups")

    # Tree: rows of the nonzero shares in the order of the sources, equal ones once.
    shared = entries.join(groups, ["lang", "source"])
    p, q = _share(F.col("n"), F.col("size"), F.col("terms")), _share(F.col("in_lang"), F.col("lang_size"), F.col("terms"))
    shared = stage(shared.select("lang", "term", "source", "n", p.alias("p"), q.alias("q"), "p0"), "divergence-shares")
    path = F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("path")
    paths = shared.groupBy("lang", "term").agg(path).groupBy("lang", "path").agg(F.count("*").alias("times"))
    # Ranges by the beginning of the rows, so that the sampled bounds are small; a very common beginning is split by a hash.
    lead = [F.get("path", F.lit(0))["source"], *[F.get("path", F.lit(k))["p"] for k in range(3)], F.xxhash64("path")]
    paths = stage(paths, "divergence-paths").repartitionByRange("lang", *lead).sortWithinPartitions("lang", "path")
    both = paths.mapInArrow(tree_sums, SUMS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    # What one source's counts change against each other source, and the value of two missing counts.
    singles = shared.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q0"), "terms")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    single = singles.withColumnRenamed("source", "a").join(other, "lang").where("a <> b")
    single = single.groupBy("lang", "a", "b").agg(F.sum(F.col("times") * (_distance(p, q0) - _distance(p0, q0))).alias("value"))
    base = groups.select("lang", F.col("source").alias("a"), "p0").join(other, "lang").where("a <> b")
    base = base.select("lang", "a", "b", F.coalesce(F.col("terms") * _distance(p0, q0), F.lit(0)).alias("value"))
    swapped = [F.col("lang"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("value")]
    parts = base.union(single).union(single.select(*swapped)).union(both).union(both.select(*swapped))
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    telling = shared.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # The limit on the rank cuts each task's rows before the shuffle.
    telling = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(telling)
