"""Removal of repeated passages by a distributed sparse suffix array.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is removed.

Equal texts are counted first, before any shuffle of texts, and one of them goes on: a text of LENGTH bytes or more that
occurs twice goes whole, and the one that stays is the partner of all others. Texts are told apart by 96 bits made from
their SHA-256. They are written once in hash buckets of this key, so neither contexts nor cuts move texts again.

1. Anchors. In every stretch of LENGTH bytes the ``GRAM`` bytes with the smallest hash are an anchor
   (all of them where several are equal). Equal stretches have equal anchors at equal
   places, so a repeated string has an anchor whose hash occurs at least twice; others are dropped.
2. Suffixes. What follows such an anchor, up to LENGTH bytes, is a suffix, and what precedes it
   its left context. Spark sorts the suffixes by anchor and bytes; the lengths of common prefixes
   of neighbours make this an enhanced suffix array, each group of one anchor being a part of it.
3. Intervals. A scan with a stack visits the intervals of the common-prefix tree. Within an interval
   of r common bytes the left contexts, sorted backwards, tell how far each occurrence extends to the left
   alike with another one; those of at least LENGTH - r bytes are maximal repeats that
   cover r bytes to the right and the common ones to the left. All occurrences of the interval are
   looked at, not neighbours alone.
4. Hot anchors, with more than ``GROUP`` occurrences, never meet in one task. Their equal contexts are
   counted first, before the shuffle; a context that occurs twice covers itself. Then the places that
   the anchor may have in a string are halved again and again: a half fixes more common bytes, by
   which the contexts are grouped anew, and leaves less of each context; contexts that have become
   equal cover each other and one of them goes on. This ends with groups that are small enough for
   step 3, at the latest at a single place, where a group's strings are equal. Nothing is capped.

Defined cases: a null text counts as empty; texts shorter than LENGTH keep everything; rows that agree
in id and text are repeats of one another; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import BASE, BASE_INVERSE, U, mix, pieces, powers, utf8
from shopmetrics.sources.staging import stage, stage_buckets

LENGTH = 200
GRAM = 64
LEFT = LENGTH - GRAM
GROUP = 16_000  # some 5 MB of contexts; the scan of a row takes at most LEFT + 1 intervals, however many rows a group has
KEY = ["uid", "tag"]
_CHUNK = 4096


def _sliding(values: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """``best`` of every ``width`` neighbours, from running bests of blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, fill, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = best.accumulate(grid, axis=1).ravel()
    behind = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text."""
    n = len(text)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U)
    total = np.zeros(n + 1, U)
    np.cumsum((text.astype(U) + U(1)) * powers(BASE, n), out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * powers(BASE_INVERSE, n)[: n - GRAM + 1])
    width = LEFT + 1
    least = _sliding(grams, width, np.minimum, (1 << 64) - 1)
    padded = np.zeros(len(least) + 2 * (width - 1), U)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(grams == _sliding(padded, width, np.maximum, 0))
    return at, grams[at]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for a, b in pieces(offsets):
            found = [anchors(data[offsets[i] : offsets[i + 1]]) for i in range(a, b)]
            row = pa.array(np.repeat(np.arange(a, b), [len(x[0]) for x in found]))
            columns = [
                *(batch.column(k).take(row) for k in range(2)),
                pa.array(np.concatenate([x[0] for x in found]).astype(np.int32)),
                pa.array(np.concatenate([x[1] for x in found]).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "pos", "gram"])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, tag, gram, pos, left, right) of every listed place of a text."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for a, b in pieces(offsets, 1 << 18):
            row, gram, pos, left, right = [], [], [], [], []
            for i in range(a, b):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                places = batch.column(3)[i].values
                at = places.field("pos").to_pylist()
                pos += at
                gram += places.field("gram").to_pylist()
                row += [i] * len(at)
                left += [text[max(0, p - LEFT) : p] for p in at]
                right += [text[p : p + LENGTH] for p in at]
            columns = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(2)]
            columns += [pa.array(gram, pa.int64()), pa.array(pos, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "gram", "pos", "left", "right"])


def _matrix(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in texts])
    flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8)
    return flat.reshape(len(texts), width), size


def _common(one: np.ndarray, two: np.ndarray, one_size: np.ndarray, two_size: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows."""
    differ = one != two
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), one.shape[1])
    return np.minimum(first, np.minimum(one_size, two_size))


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, common bytes) of the tree's intervals of at least ``least`` common bytes.

    ``lcp[i]`` is the common prefix of suffixes i and i + 1.
    """
    stack: list[tuple[int, int]] = []  # first suffix, common bytes
    for i, value in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][1] > value:
            first, common = stack.pop()
            yield first, i, common
        if value >= least and (not stack or stack[-1][1] < value):
            stack.append((first, value))


def repeats(group: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bytes to the left, bytes to the right) that the maximal repeats of sorted suffixes cover.

    Rows are sorted by group and right side; repeats lie within a group. All repeats of a row hold its anchor,
    so the longest reach on either side tells their union.
    """
    suffix, size = _matrix(right, LENGTH)
    back, back_size = _matrix([x[::-1] for x in left], LEFT)
    lcp = _common(suffix[:-1], suffix[1:], size[:-1], size[1:])
    lcp[group[:-1] != group[1:]] = 0
    rank = np.empty(len(left), np.int64)
    rank[sorted(range(len(left)), key=lambda i: left[i][::-1])] = np.arange(len(left))
    lefts, rights = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for first, last, common in intervals(lcp, GRAM):
        members = first + np.argsort(rank[first : last + 1])
        near = _common(back[members[:-1]], back[members[1:]], back_size[members[:-1]], back_size[members[1:]])
        best = np.maximum(np.append(near, 0), np.append(0, near))
        keep = best >= LENGTH - common
        found = members[keep]
        lefts[found] = np.maximum(lefts[found], best[keep])
        rights[found] = np.maximum(rights[found], common)
    rows = np.flatnonzero(rights)
    return rows, lefts[rows], rights[rows]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of rows (key columns..., gram, left, right) sorted by gram and right: keys, l, r."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(table: pa.Table) -> pa.RecordBatch:
        keys = table.column_names[:-3]
        group, left, right = (table.column(c) for c in table.column_names[-3:])
        row, l_size, r_size = repeats(group.to_numpy(), left.to_pylist(), right.to_pylist())
        picked = [table.column(c).combine_chunks().take(pa.array(row)) for c in keys]
        return pa.RecordBatch.from_arrays(
            [*picked, pa.array(l_size.astype(np.int32)), pa.array(r_size.astype(np.int32))], [*keys, "l", "r"]
        )

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < _CHUNK:
            continue
        # Whole groups only; the last one may go on in the next batch.
        table = pa.Table.from_batches(held)
        group = table.column(table.column_names[-3]).to_numpy()
        cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
        done = 0
        while len(later := cuts[cuts > done]):
            cut = int(later[later <= done + _CHUNK][-1]) if (later <= done + _CHUNK).any() else int(later[0])
            yield flush(table.slice(done, cut - done))
            done = cut
        held = table.slice(done).to_batches()
        rows = len(table) - done
    if rows:
        yield flush(pa.Table.from_batches(held))


def _scanned(rows: DataFrame, keys: str) -> DataFrame:
    """``rows`` have the key columns named in the schema string ``keys``, then gram, left and right."""
    return rows.repartition("gram").sortWithinPartitions("gram", "right").mapInArrow(_scan, f"{keys}, l int, r int")


def _hot_covers(contexts: DataFrame, group: int) -> DataFrame:
    """(context, l, r) for distinct contexts (context, n, left, right) of hot anchors."""
    known = stage(contexts, "repeat-contexts")
    twice = known.where("n > 1").select("context", F.length("left").cast("int").alias("l"), F.length("right").cast("int").alias("r"))
    covers = twice.where(F.col("l") + F.col("r") >= LENGTH)
    rows = known.select("context", "left", "right", F.lit(0).alias("o1"), F.lit(LEFT).alias("o2"))
    level = 0
    while not rows.isEmpty():
        # Places o1 to o2 of the anchor in a string: all these strings have the bytes from o1 before it to LENGTH - o2
        # after it, and none has more than those from o2 before it to LENGTH - o1 after it.
        rows = rows.where(F.length("left") >= F.col("o1")).where(F.length("right") >= LENGTH - F.col("o2")).select(
            "context", "o1", "o2", F.expr("substring(left, greatest(length(left) - o2, 0) + 1, o2)").alias("left"),
            F.expr(f"substring(right, 1, {LENGTH} - o1)").alias("right"),
        )
        shared = [F.expr("substring(left, length(left) - o1 + 1, o1)"), F.expr(f"substring(right, 1, {LENGTH} - o2)")]
        part = F.unhex(F.md5(F.concat(F.col("left"), F.lit("|").cast("binary"), F.col("right"))))
        rows = rows.withColumns({"gram": F.xxhash64("o1", "o2", *shared), "part": part})
        # Equal parts cover each other; one of them goes on, as a partner of the rest.
        parts = rows.groupBy("gram", "part").agg(F.count(F.lit(1)).alias("same"), F.min("context").alias("first"))
        groups = parts.groupBy("gram").agg(F.sum("same").alias("n"), F.count(F.lit(1)).alias("size")).where("n > 1")
        parts = stage(parts.join(groups, "gram").select("gram", "part", "same", "first", "size"), f"repeat-parts-{level}")
        covers = covers.union(
            rows.select("context", "gram", "part", F.length("left").alias("l"), F.length("right").alias("r"))
            .join(parts.where("same > 1").select("gram", "part"), ["gram", "part"])
            .where(F.col("l") + F.col("r") >= LENGTH)
            .select("context", "l", "r")
        )
        open_parts = parts.where("size > 1").select("gram", "part", F.col("first").alias("context"), "size")
        rows = stage(rows.join(open_parts, ["gram", "part", "context"]), f"repeat-level-{level}")
        few = rows.where(F.col("size") <= group).select("context", "gram", "left", "right")
        found = stage(_scanned(few, "context binary"), f"repeat-covers-{level}")
        covers = covers.union(found.select("context", "l", "r"))
        middle = F.expr("(o1 + o2) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("o1"), middle.alias("o2")), F.struct((middle + 1).alias("o1"), F.col("o2")))).alias("half")
        rows = rows.where(F.col("size") > group).select("context", "left", "right", halves)
        rows = rows.select("context", "left", "right", "half.o1", "half.o2")
        level += 1
    return covers


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans and what stays of each text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in pieces(offsets):
            spans, kept = [], []
            for i in range(a, b):
                own = batch.column(2)[i]
                text = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(text) + 1, np.int32)
                if own.is_valid:
                    np.add.at(edge, own.values.field("start").to_numpy(), 1)
                    np.add.at(edge, own.values.field("end").to_numpy(), -1)
                gone = edge.cumsum()[:-1] > 0
                step = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                spans.append([{"start": s, "end": e} for s, e in step.reshape(-1, 2).tolist()])
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "spans", "kept"]
            )


def repeated_spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, text_sha256, spans, kept): kept is null where nothing is removed."""
    kind = "array<struct<start:int,end:int>>"
    text = F.coalesce("text", F.lit("")).alias("text")
    named = docs.select("doc_id", text).withColumn("text_sha256", F.sha2("text", 256))
    named = named.withColumns({"uid": F.xxhash64("text_sha256"), "tag": F.hash("text_sha256")})
    first = [F.first(c).alias(c) for c in ("doc_id", "text_sha256", "text")]
    texts = stage_buckets(named.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), *first), "repeat-texts", *KEY)

    places = texts.select(*KEY, "text").mapInArrow(_anchor_rows, "uid long, tag int, pos int, gram long")
    often = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = often.select("gram", (F.col("n") > group).alias("hot"))
    places = places.join(often, "gram").groupBy(*KEY).agg(F.collect_set(F.struct("pos", "gram", "hot")).alias("places"))
    some = texts.select(*KEY, "text").join(stage_buckets(places, "repeat-places", *KEY), KEY)

    schema = "uid long, tag int, gram long, pos int, left binary, right binary"
    few = some.select(*KEY, "text", F.filter("places", lambda p: ~p["hot"]).alias("places")).where(F.size("places") > 0)
    few = few.mapInArrow(_context_rows, schema).select(*KEY, "pos", "gram", "left", "right")
    spans = _scanned(few, "uid long, tag int, pos int")
    hot = some.select(*KEY, "text", F.filter("places", lambda p: p["hot"]).alias("places")).where(F.size("places") > 0)
    if not hot.isEmpty():
        context = F.unhex(F.md5(F.concat(F.col("left"), F.lit("|").cast("binary"), F.col("right")))).alias("context")
        hot = hot.mapInArrow(_context_rows, schema).select(*KEY, "pos", context, "left", "right")
        distinct = hot.groupBy("context", "left", "right").agg(F.count(F.lit(1)).alias("n"))
        covers = _hot_covers(distinct.select("context", "n", "left", "right"), group).distinct()
        spans = spans.union(hot.select(*KEY, "pos", "context").join(covers, "context").select(*KEY, "pos", "l", "r"))
    span = F.struct((F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end"))
    spans = spans.groupBy(*KEY).agg(F.collect_set(span).alias("spans"))

    size = F.octet_length("text").cast("long").alias("n_bytes")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    # Copies, however many: a text that occurs twice goes whole or, being short, stays whole.
    again = texts.where("copies > 1").select(*KEY, "text_sha256", size, "copies")
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    copies = named.select("doc_id", *KEY).join(again, KEY).select(
        "doc_id", "n_bytes", "text_sha256", F.when(whole, all_of_it).otherwise(F.array().cast(kind)).alias("spans"),
        F.when(whole, F.lit("").cast("binary")).alias("kept"),
    )
    key = F.struct("doc_id", size, "text_sha256").alias("row")
    covered = texts.where("copies = 1").join(spans, KEY, "left").select(key, F.when(F.col("spans").isNotNull(), F.col("text")).alias("text"), "spans")
    row = covered.schema["row"].dataType.simpleString()
    cut = covered.mapInArrow(_cut, f"row {row}, spans {kind}, kept binary")
    kept = F.when(F.size("spans") > 0, F.col("kept")).alias("kept")
    return cut.select("row.doc_id", "row.n_bytes", "row.text_sha256", "spans", kept).union(copies)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    digest = F.when(F.col("kept").isNull(), F.col("text_sha256")).otherwise(F.sha2("kept", 256))
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), digest.alias("kept_sha256")
    )
