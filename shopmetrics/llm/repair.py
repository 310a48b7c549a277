"""Conversation structure repair: the cheapest edits after which the roles read system?, (user, assistant)+ or nothing.

An automaton of four states reads the roles. From the back, a vector holds for each state the least cost of
what is left; it is stored only at checkpoints, one for every block of about sqrt(n) turns of a conversation of n,
and the vectors in between are computed again, block by block, while the edits are read forward. Costs
add and take minima, so a block is a 4 x 4 table that tasks compute by themselves: the checkpoints of
a conversation come from its sqrt(n) tables, and each block then knows the cost behind it. For each state
that a block may be entered with it notes its edits and the state it ends with; a walk over those ends picks the
entry of each block. No task needs a whole conversation, whose turns are numbered by a distributed sort.

An edit string is the letters D (delete), I (insert an empty turn), K (keep) and R (set the role). Of all cheapest
ones the ASCII-least is taken: from each state, a letter leads to one state only, so the least letter
of least cost is right at every step.

Defined cases: a null conv_id is a conversation of its own; turns are taken in order of turn (nulls first), role,
text, so equal turns are neighbours; null role and text count as one space; an initial other than s, u or a
never fits and is deleted or gets a role; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from shopmetrics.operators.distributed import assign_row_numbers
from shopmetrics.sources.staging import stage

KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

# States: nothing read, system read, user read, assistant read.
STATES = 4
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The only role that a set or inserted turn can have in each state.
WANTED = ("u", "u", "a", "u")
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 60

BLANK = "[^\\x20\\x09-\\x0D]"
LAST = "(?s)^.*([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults dealt by crc32(``conv_id:turn``) modulo 20; nulls are one space."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("int")))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _relaxed(least: list[int]) -> list[int]:
    """Costs once turns may be inserted before the next one."""
    user, assistant = min(least[2], INSERT + least[3]), min(least[3], INSERT + least[2])
    return [min(least[0], INSERT + user), min(least[1], INSERT + user), user, assistant]


def _step(kind: str, after: list[int]) -> tuple[list[int], list[dict[str, tuple[int, int]]]]:
    """Cost vector before a turn from the one after it, and the choices letter -> (cost, state) of each state.

    ``kind`` is the role's initial, upper case if the turn is truncated, ``x`` for other initials and ``d`` if it must go.
    """
    extra = TRUNCATED if kind.isupper() else 0
    initial = kind.lower()
    choices = []
    for state in range(STATES):
        ways = {"D": (DELETE + after[state], state)}
        if initial != "d":
            onward = NEXT.get(initial, (None,) * STATES)[state]
            if onward is not None:
                ways["K"] = (KEEP + extra + after[onward], onward)
            onward = NEXT[WANTED[state]][state]
            ways["R"] = (RENAME + extra + after[onward], onward)
        choices.append(ways)
    vector = _relaxed([min(cost for cost, _ in ways.values()) for ways in choices])
    for state, ways in enumerate(choices):
        onward = NEXT[WANTED[state]][state]
        ways["I"] = (INSERT + vector[onward], onward)
    return vector, choices


def block_table(kinds: str) -> list[int]:
    """Least cost of a block's turns from each state to each state, row by row; no insertion after its last turn."""
    columns = []
    for end in range(STATES):
        vector = [0 if state == end else NEVER for state in range(STATES)]
        for kind in reversed(kinds):
            vector = [min(v, NEVER) for v in _step(kind, vector)[0]]
        columns.append(vector)
    return [columns[end][state] for state in range(STATES) for end in range(STATES)]


def final_vector() -> list[int]:
    """Cost behind the last turn: missing turns are inserted there."""
    return _relaxed([0 if state in ACCEPTING else NEVER for state in range(STATES)])


def checkpoints(tables: list[list[int]]) -> list[list[int]]:
    """Cost vectors at the start of every block and behind the last one, from the tables of all blocks."""
    vectors = [final_vector()]
    for table in reversed(tables):
        after = vectors[-1]
        vectors.append([min(table[STATES * s + e] + after[e] for e in range(STATES)) for s in range(STATES)])
    return vectors[::-1]


def block_edits(kinds: str, after: list[int], last: bool) -> list[tuple[str, str, list[int], int]]:
    """For each state of entry: edits of a block, initials of set and inserted turns (else ``-``), turns done before each edit, last state."""
    steps, vector = [], after
    for kind in reversed(kinds):
        vector, choices = _step(kind, vector)
        steps.append((vector, choices))
    steps.reverse()
    out = []
    for state in range(STATES):
        letters, roles = [], []
        for vector, choices in steps:
            while True:
                ways = choices[state]
                letter = min(c for c, (cost, _) in ways.items() if cost == vector[state])
                onward = ways[letter][1]
                letters.append(letter)
                roles.append(WANTED[state] if letter in "IR" else "-")
                state = onward
                if letter != "I":
                    break
        while last and state not in ACCEPTING:
            letters.append("I")
            roles.append(WANTED[state])
            state = NEXT[WANTED[state]][state]
        done = accumulate((letter != "I" for letter in letters[:-1]), initial=0) if letters else ()
        out.append(("".join(letters), "".join(roles), list(done), state))
    return out


@F.pandas_udf(ArrayType(LongType()))
def _tables(kinds: pd.Series) -> pd.Series:
    known: dict[str, list[int]] = {}
    return kinds.map(lambda k: known[k] if k in known else known.setdefault(k, block_table(k)))


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _checkpoints(tables: pd.Series) -> pd.Series:
    return tables.map(lambda t: checkpoints([list(x) for x in t]))


_EDITS = (
    StructType()
    .add("edits", ArrayType(StringType()))
    .add("roles", ArrayType(StringType()))
    .add("done", ArrayType(ArrayType(LongType())))
    .add("ends", ArrayType(LongType()))
)


@F.pandas_udf(_EDITS)
def _edits(kinds: pd.Series, after: pd.Series, last: pd.Series) -> pd.DataFrame:
    found = [block_edits(k, list(a), z) for k, a, z in zip(kinds, after, last, strict=True)]
    return pd.DataFrame([[list(x) for x in zip(*f, strict=True)] for f in found], columns=["edits", "roles", "done", "ends"])


@F.pandas_udf(ArrayType(LongType()))
def _entries(ends: pd.Series) -> pd.Series:
    """State at the start of each block, from the states that the blocks before it end in."""

    def walk(blocks: list) -> list[int]:
        states = [0]
        for block in blocks[:-1]:
            states.append(int(block[states[-1]]))
        return states

    return ends.map(walk)


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with ``pos`` from 0 within the conversation, ``n``, their block and the code ``kind`` of role and first fault."""
    rows = turns.select("conv_id", "turn", "role", "text")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.monotonically_increasing_id()]
    rows = assign_row_numbers(rows, [F.col(c) if isinstance(c, str) else c for c in order], "place", "repair-turns")
    rows = rows.withColumn("same", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    convs = rows.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    conv = convs.select(F.col("conv_id").alias("of"), "first", "n")
    repeats = rows.groupBy("conv_id", "same").agg(F.min("place").alias("seen"), F.count("*").alias("times")).where("times > 1")
    repeats = repeats.select(F.col("conv_id").alias("in"), F.col("same").alias("again"), "seen")
    rows = rows.join(conv, F.col("conv_id").eqNullSafe(F.col("of")))
    rows = rows.join(repeats, F.col("conv_id").eqNullSafe(F.col("in")) & (F.col("same") == F.col("again")), "left")
    blank = ~F.col("text").rlike(BLANK)
    repeated = F.coalesce(F.col("place") > F.col("seen"), F.lit(False))
    cut = ~F.regexp_extract("text", LAST, 1).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(repeated, "duplicate").when(cut, "truncated")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    kind = F.when(blank | repeated, "d").when(cut, F.upper(initial)).otherwise(initial)
    pos = F.col("place") - F.col("first")
    return rows.select(
        "conv_id", pos.alias("pos"), "n", F.call_function("div", pos, F.ceil(F.sqrt("n"))).alias("block"),
        "turn", "role", "text", initial.alias("initial"), fault.alias("fault"), kind.alias("kind"),
    )


def edits(rows: DataFrame) -> DataFrame:
    """Blocks (conv_id, block, first, cost, edits, roles, done) of ``numbered`` turns; cost is the conversation's."""
    start, codes = F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "kind")))
    kinds = F.array_join(F.transform(codes, lambda x: x["kind"]), "").alias("kinds")
    last = (F.max("pos") + 1 == F.first("n")).alias("last")
    blocks = rows.groupBy("conv_id", "block").agg(start, kinds, last)
    blocks = stage(blocks.withColumn("table", _tables("kinds")), "repair-blocks")

    # One row per conversation with the tables of its blocks, and back: block k has the vector at the start of k + 1 behind it.
    ordered = F.array_sort(F.collect_list(F.struct("block", "table")))
    per = blocks.groupBy("conv_id").agg(ordered.alias("t"))
    per = per.select("conv_id", _checkpoints(F.transform("t", lambda x: x["table"])).alias("v"))
    cost = F.element_at(F.element_at("v", 1), 1).alias("cost")
    behind = per.select(F.col("conv_id").alias("of"), cost, F.posexplode(F.slice("v", F.lit(2), F.size("v"))).alias("k", "after"))
    blocks = blocks.join(behind, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("k")))
    blocks = blocks.withColumn("found", _edits("kinds", "after", "last"))
    blocks = stage(blocks.select("conv_id", "block", "first", "cost", "found.*"), "repair-edits")

    ordered = F.array_sort(F.collect_list(F.struct("block", "ends")))
    entry = blocks.groupBy("conv_id").agg(ordered.alias("e"))
    entry = entry.select(F.col("conv_id").alias("of"), F.posexplode(_entries(F.transform("e", lambda x: x["ends"]))).alias("k", "entry"))
    blocks = blocks.join(entry, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("k")))
    chosen = (F.col("entry") + 1).cast("int")
    return blocks.select("conv_id", "block", "first", "cost", *[F.element_at(c, chosen).alias(c) for c in ("edits", "roles", "done")])


def outline(blocks: DataFrame) -> DataFrame:
    """Edits as rows (conv_id, pos, seq, edit, set_role): ``seq`` orders the turns inserted before a turn and the turn itself."""
    zipped = F.arrays_zip(F.split("edits", "").alias("edit"), F.split("roles", "").alias("role"), F.col("done").alias("done"))
    steps = blocks.select("conv_id", "first", F.posexplode(zipped).alias("seq", "step")).where("step.done is not null")
    names = F.when(F.col("step.role") == "u", ROLES["u"]).when(F.col("step.role") == "a", ROLES["a"])
    return steps.select(
        "conv_id", (F.col("first") + F.col("step.done")).alias("pos"), "seq", "step.edit", names.alias("set_role")
    )


def repaired(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, seq, edit, role, text) of the repaired conversations, inserted ones with an empty text."""
    steps = outline(blocks).where("edit <> 'D'").select(F.col("conv_id").alias("of"), F.col("pos").alias("at"), "seq", "edit", "set_role")
    inserted = steps.where("edit = 'I'").select(
        F.col("of").alias("conv_id"), F.col("at").alias("pos"), "seq", "edit", F.col("set_role").alias("role"), F.lit("").alias("text")
    )
    kept = steps.where("edit <> 'I'").join(rows, F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("at") == F.col("pos")))
    kept = kept.select("conv_id", "pos", "seq", "edit", F.coalesce("set_role", "role").alias("role"), "text")
    return kept.union(inserted)


def joined_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ``role:text`` lines of each conversation from sorted turns, which are read as a stream."""
    here, digest, started = None, hashlib.sha256(), False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), pa.array([digest.hexdigest()])], names=["of", "sha"])

    for batch in batches:
        columns = [batch.column(c) for c in ("conv_id", "role", "text")]
        for conv, role, text in zip(*columns, strict=True):
            conv = conv.as_py()
            if started and conv != here:
                yield row()
                digest, started = hashlib.sha256(), False
            digest.update(("\n" if started else "").encode() + f"{role.as_py()}:{text.as_py()}".encode())
            here, started = conv, True
    if started:
        yield row()


def report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` for its damaged ``turns``: faults, cost, edit string and hash of the repair."""
    rows = stage(numbered(turns), "repair-rows")
    blocks = stage(edits(rows), "repair-chosen")

    # The role before each turn: within a block by a window, at its start from the block before.
    within = Window.partitionBy("conv_id", "block").orderBy("pos")
    ends = rows.groupBy("conv_id", "block").agg(F.max_by("initial", "pos").alias("end"))
    ends = ends.select(F.col("conv_id").alias("of"), (F.col("block") + 1).alias("k"), "end")
    narrow = rows.select("conv_id", "block", "pos", "turn", "initial", "fault").withColumn("before", F.lag("initial").over(within))
    narrow = narrow.join(ends, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("k")), "left")
    before = F.coalesce("before", "end")
    illegal = before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au")
    counts = narrow.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("width"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if(illegal).alias("illegal"),
    )
    distinct = narrow.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("*").alias("turns"))

    parts = F.array_sort(F.collect_list(F.struct("block", "edits")))
    audit = blocks.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["edits"]), "").alias("audit"), F.first("cost").alias("cost"))
    lines = repaired(rows, blocks).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "seq")
    hashes = lines.mapInArrow(joined_hashes, "of long, sha string")

    out = conversations.select("conv_id").distinct()
    for df in (counts, distinct, audit, hashes):
        key = df.columns[0]
        df = df.withColumnRenamed(key, "of")
        out = out.join(df, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "conv_id",
        (count("width") - count("turns")).alias("gaps"),
        *[count(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
