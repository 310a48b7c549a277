"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle is hashed to a bin and leaves the pair (i, hash) there, the
smallest pair of a bin being its coordinate; rounds go on until every bin is filled. After as
many rounds as bins, round i fills bin i - COORDINATES with every shingle, so twice as many
rounds always suffice, also for a single shingle. Coordinates of two sets agree with a probability
of their similarity and concentrate as those of as many independent hashes.

Candidates share all coordinates of a band. ``BANDS`` bands of ``ROWS`` miss a pair at similarity
0.8 with probability (1 - 0.8^ROWS)^BANDS = 3e-7. Equal sets are one class from the start and
only its smallest document is compared. In each bucket all classes are first compared with the
smallest. Members that this left in different components of a bucket meet through the rarest shingles
that they share (see ``_by_rare_shingles``), an exact bound, also if they never met in a bucket. Where many are listed
under a shingle, all are first compared with one of them, and what links is one component from then on; so a
group of copies falls into few components before all pairs across these are made. A pair is
linked only if its full shingle sets, made anew from both texts, have 100 * intersection >= 80 * union.
So no bucket emits all its pairs, and none is capped. Components follow from the links.

Defined cases: texts are lower-cased in A-Z only; words are split at blank, tab and the four line
and page breaks; a text of fewer words than a shingle is one shingle; one without words, or a
null one, has none, is linked with nothing and is its own component. Rows that share an id are
one node with the links of all of them. A row without an id is not linked and has no component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import BASE, BASE_INVERSE, U, components, fresh, mix, pieces, powers, utf8
from shopmetrics.sources.staging import stage

#: Words of a shingle in op5_minhash; the pipeline's stage passes its own number.
SHINGLE_WORDS = 4
PERCENT = 80
COORDINATES = 64
ROWS = 3
BANDS = COORDINATES // ROWS
MAP_WORDS = 16
AHEAD = 128
CROWD = 8

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U) * BASE)
_BAND_SEEDS = mix(np.arange(301, 301 + BANDS, dtype=U))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in ``data`` and the number of words of each text."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(bounds) - 1, np.int64)
    low = _FOLD[data]
    solid = low != 32
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[1:-1][bounds[1:-1] < len(data)]
    begins[inner] |= solid[inner]
    starts = np.flatnonzero(begins)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    before = inner[inner > 0] - 1
    ends[before] |= solid[before]
    stops = np.flatnonzero(ends) + 1
    total = np.zeros(len(data) + 1, U)
    np.cumsum((low.astype(U) + U(1)) * powers(BASE, len(data)), out=total[1:])
    words = (total[stops] - total[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts]
    per_text = np.diff(np.searchsorted(starts, bounds))
    return mix(words + (stops - starts).astype(U)), per_text


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of ``width`` words of each text."""
    words, per_text = word_hashes(data, bounds)
    places = mix(np.arange(101, 101 + width, dtype=U)) | U(1)
    n = max(0, len(words) - width + 1)
    joined = np.zeros(n, U)
    for k in range(width):
        joined += words[k : k + n] * places[k]
    joined = mix(joined)
    sets, first = [], 0
    for count in per_text.tolist():
        if count >= width:
            sets.append(np.unique(joined[first : first + count - width + 1]))
        elif count:
            part = (words[first : first + count] * places[:count]).sum(dtype=U) + U(count)
            sets.append(mix(np.array([part], U)))
        else:
            sets.append(np.zeros(0, U))
        first += count
    return sets


def sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """``t`` values of a non-empty set of shingle hashes."""
    round_bits = (2 * t).bit_length()
    place, rest = U(64 - round_bits), U(round_bits)
    out = np.full(t, ~U(0), U)
    step = max(1, 8 * t // len(shingles))
    for first in range(0, t, step):
        rounds = np.arange(first, min(t, first + step))
        hashes = mix(shingles[None, :] ^ _SEEDS[rounds, None])
        values = (rounds.astype(U)[:, None] << place) | (hashes >> rest)
        np.minimum.at(out, (hashes % U(t)).astype(np.int64).ravel(), values.ravel())
        if out.max() != ~U(0):
            return out
    for bin_ in np.flatnonzero(out == ~U(0)):
        i = t + int(bin_)
        out[bin_] = (U(i) << place) | (mix(shingles ^ _SEEDS[i]).min() >> rest)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = _BAND_SEEDS.copy()
    for k in range(ROWS):
        key = mix(key ^ rows[:, k]) * BASE
    return mix(key)


_SKETCHED = "n_shingles long, class binary, bands array<long>"


def sketches(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, class, bands); class is a digest of the set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                known = [sketch(x) if len(x) else None for x in sets]
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                    pa.array([None if x is None else band_keys(x).view(np.int64) for x in known], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SKETCHED}")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts' full sets are similar enough."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out: list[bool] = []
        sides = [utf8(left), utf8(right)]
        for a, b in pieces(np.maximum.accumulate(sides[0][1] - sides[0][1][0] + sides[1][1] - sides[1][1][0])):
            x, y = (shingle_sets(d[o[a] : o[b]], o[a : b + 1] - o[a], width) for d, o in sides)
            for p, q in zip(x, y, strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    return pairs.join(right, "b").join(left, "a").where(similar("left", "right")).select("a", "b")


def _mixed(members: DataFrame, group: DataFrame, label: str) -> DataFrame:
    """``members`` (key, rep and more) with their component, of the keys whose members aren't all in one component yet."""
    component = F.coalesce("component", "rep").alias("component")
    placed = members.join(group, members["rep"] == group["node"], "left").select(*members.columns, component)
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return stage(placed.join(mixed.where("low <> high").select("key"), "key"), label)


_WORDS = [f"w{k}" for k in range(MAP_WORDS)]


def _listed(rest: DataFrame, texts: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """A row for each member of ``rest`` and each shingle that it is listed under, see ``_by_rare_shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                ids = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), [len(x) for x in sets])))
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids, flat], ["rep", "shingle"])

    wanted = rest.select(F.col("rep").alias("doc_id")).distinct()
    kind = texts.schema["doc_id"].dataType.simpleString()
    texts = texts.join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    shingles = stage(texts.mapInArrow(run, f"rep {kind}, shingle long"), "near-shingles")
    shared = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    order = F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("order")
    word = F.col("shingle").bitwiseAND(F.lit(MAP_WORDS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("shingle", 8).bitwiseAND(F.lit(63)).cast("int"))
    maps = [F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(_WORDS)]
    orders = shingles.join(shared, "shingle").groupBy("rep").agg(order, *maps)
    sizes = reps.select("rep", F.col("n_shingles").alias("n"))
    head = F.slice(F.col("order.shingle"), 1, AHEAD).alias("head")
    listed = orders.join(sizes, "rep").select("rep", "n", *_WORDS, F.size("order").alias("many"), head, F.posexplode("order").alias("k", "e"))
    # Shingles that no other member has come first.
    left = F.col("many") - F.col("k")
    most = F.call_function("div", left * (100 + PERCENT), F.lit(PERCENT)) - F.col("n")
    ahead = F.slice("head", F.lit(1), F.least("k", F.lit(AHEAD))).alias("ahead")
    listed = listed.select("rep", "n", "many", *_WORDS, F.col("e.shingle").alias("shingle"), most.alias("most"), ahead)
    return stage(listed.where(F.col("most") * 100 >= F.col("n") * PERCENT), "near-listed")


def _enough(one: str, two: str) -> Column:
    """Whether the map of ``one`` leaves enough shingles that ``two`` may share."""
    lacking = [F.bit_count(F.col(one + w).bitwiseAND(F.bitwise_not(F.col(two + w)))) for w in _WORDS]
    return (F.col(one + "many") - reduce(Column.__add__, lacking)) * (100 + PERCENT) >= (F.col(one + "n") + F.col(two + "n")) * PERCENT


def _with_leads(shared: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs (a, b) of members and the one that has most room under a shingle that many are listed under.

    The bounds are those of ``_by_rare_shingles``. Who has much room has few rare shingles, so it is near the middle of its group.
    """
    lead = F.max(F.struct("most", "rep", "n", "component")).alias("lead")
    leads = shared.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"), lead).where(F.col("crowd") > CROWD).select("key", "lead")
    met = shared.join(leads, "key").where("component <> lead.component and n <= lead.most and lead.n <= most")
    pairs = _ordered(met.select("rep", F.col("lead.rep").alias("lead")), "rep", "lead")
    maps = listed.select("rep", "n", "many", *_WORDS).distinct()
    for side in "ab":
        pairs = pairs.join(maps.toDF(side, *[f"{side}_{c}" for c in maps.columns[1:]]), side)
    return pairs.where(_enough("a_", "b_")).where(_enough("b_", "a_")).select("a", "b")


def _merged(group: DataFrame, more: DataFrame, placed: DataFrame) -> DataFrame:
    """``group`` after further links (a, b), whose ends ``placed`` (rep, component) has; only components have to follow them."""
    placed = placed.select("rep", "component").distinct()
    one, two = (placed.toDF(side, f"{side}_component") for side in "ab")
    joined = components(more.join(one, "a").join(two, "b"), "a_component", "b_component", "near")
    moved = group.join(joined.toDF("component", "higher"), "component", "left")
    moved = moved.select("node", F.coalesce("higher", "component").alias("component"))
    return stage(moved.union(joined.join(group, "node", "left_anti")), "near-merged")


def _by_rare_shingles(rest: DataFrame, texts: DataFrame, reps: DataFrame, width: int, listed: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b) of members in different components that can be similar, by their first shared shingle.

    Each set is put in one order of all shingles, the rarest first. If the first one that a pair shares is at place i of
    n shingles (from 0), the pair shares at most n - i; 80 % of the union need 4/9 of the sum of both sizes, so
    the other set has at most 9/4 (n - i) - n shingles. A set is listed under its shingles up to the place
    where that falls below 4/5 n, less than any partner has. Copies with many changes of their own are
    listed under those alone, where they meet few others. Each set also has a map of ``64 * MAP_WORDS`` bits, one for each
    shingle that it shares with any member; a bit that only one of two sets has stands for a shingle that the
    other lacks, which bounds what they share from above. Both bounds are exact: no similar pair is left out.
    A pair that shares many listed shingles is made at the first of them: each row has up to ``AHEAD`` shingles that
    come before its own, and where two rows have one of these in common the pair has been made there.
    ``listed`` has the rows of ``_listed`` if they are at hand.
    """
    if listed is None:
        listed = _listed(rest, texts, reps, width)
    placed = rest.select("rep", "component").distinct()
    # A pair across components has one side at least outside any one of them, such as the most frequent under a shingle.
    component = F.col("component")
    main = listed.select("rep", "shingle").join(placed, "rep").groupBy("shingle")
    main = main.agg(F.mode(component).alias("main"), F.min(component).alias("low"), F.max(component).alias("high"))
    main = main.where("low <> high").select("shingle", "main")
    listed = stage(listed.join(placed, "rep").join(main, "shingle"), "near-across")
    other = listed.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("rep", "component", "n", "many", *_WORDS, "most", "ahead")])
    met = listed.where("component <> main").join(other, "shingle")
    met = met.where("(other_component = main or component < other_component) and n <= other_most and other_n <= most")
    met = met.where(_enough("", "other_")).where(_enough("other_", "")).where(~F.arrays_overlap("ahead", "other_ahead"))
    return _ordered(met, "rep", "other_rep")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def links(docs: DataFrame, sketched: DataFrame, width: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(class, rep) of the classes and (node, component) of the representatives that links join."""
    known = sketched.where("class is not null and doc_id is not null")
    # Equal sets have equal sizes and bands, so any of a class will do.
    any_of = [F.any_value(c).alias(c) for c in ("n_shingles", "bands")]
    reps = stage(known.groupBy("class").agg(F.min("doc_id").alias("rep"), *any_of), "near-reps")
    classes = reps.select("class", "rep")
    bands = reps.select("rep", F.explode("bands").alias("key"))
    met = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lead")).where("n > 1").select("key", "lead")
    members = stage(bands.join(met, "key"), "near-members")  # key, rep, lead
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = stage(texts.join(wanted, "doc_id", "left_semi"), "near-texts")

    # All against the smallest of their bucket.
    tried = stage(_ordered(members.where("lead <> rep"), "lead", "rep"), "near-pairs")
    found = stage(_confirmed(tried, texts, width), "near-links")
    group = components(found, "a", "b", "near", staged=True)
    rest = _mixed(members.select("key", "rep"), group, "near-rest")
    if rest.isEmpty():
        return classes, group

    # Those who share a rare shingle with many, against one of them.
    listed = _listed(rest, texts, reps, width)
    by_shingle = listed.select(F.col("shingle").alias("key"), "rep", "n", "most")
    shared = _mixed(by_shingle, group, "near-shared")
    first = stage(_with_leads(shared, listed).join(tried, ["a", "b"], "left_anti"), "near-pairs")
    more = stage(_confirmed(first, texts, width), "near-links")
    if not more.isEmpty():
        group = _merged(group, more, shared)
        shared = _mixed(by_shingle, group, "near-shared")

    # All that may be linked and is not in one component yet.
    pairs = _by_rare_shingles(shared, texts, reps, width, listed).join(tried.union(first), ["a", "b"], "left_anti")
    more = stage(_confirmed(stage(pairs, "near-pairs"), texts, width), "near-links")
    return classes, group if more.isEmpty() else _merged(group, more, shared)


def near_groups(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, by shingles of ``width`` words."""
    docs = docs.select("doc_id", "text")
    sketched = stage(sketches(docs, width), "near-sketches")
    classes, group = links(docs, sketched, width)
    # Rows that share an id tie their classes together.
    nodes = sketched.select("doc_id", "class").where("class is not null and doc_id is not null")
    shared = nodes.groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    tied = nodes.join(shared.select("doc_id"), "doc_id").join(classes, "class")
    tied = stage(tied.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "near-tied")
    if not tied.isEmpty():
        group = components(group.union(tied), "node", "component", "near", staged=True)
    named = classes.join(group, classes["rep"] == group["node"], "left")
    named = named.select("class", F.coalesce("component", "rep").alias("component"))
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    out = out.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, width: int) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns."""
    gone = fresh(docs, "goes_id")
    goes = near_groups(docs, width).where("not kept").select(F.col("doc_id").alias(gone))
    return docs.join(goes, docs["doc_id"] == F.col(gone), "left_anti").select(*docs.columns)
