"""Preference formatting: the common beginning of a chosen and a rejected conversation is the prompt.

Turns are put in order of (turn, role, text) and compared from the first on; the longest common
prefix is rendered once. What follows on either side is its completion, rendered in the same way, with
a mask: the character spans, relative to the completion, of the assistant's words. Only they
count for the loss; the headers and the other roles' turns don't. Everything runs in DataFrame functions;
a conversation is a training record, and its turns meet in the row that holds it, nowhere else.

Defined cases: a null role or text counts as empty; repeated turns stay, next to each other; a
conversation without its other side, or one that ends where the other goes on, gives an
empty completion with an empty mask for the side that has no turns left; an empty turn of the
assistant has no span; turns without a pair id are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    """Text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit("\n"))), "")


def mask(turns: Column, role: str = TRAINED_ROLE) -> Column:
    """Spans (start, end) of the trained turns' words in the rendered text, ends exclusive."""
    span = "struct<start:bigint,end:bigint>"
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_header(t))
        end = start + F.length(t["text"])
        own = F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        trained = (t["role"] == role) & (F.length(t["text"]) > 0)
        spans = F.when(trained, F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct((end + 1).cast("bigint").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair from rows (pair_id, chosen boolean, turn, role, text).

    Columns: pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("pair_id is not null and chosen is not null")
    sides = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), turn))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("chosen"), turn))).alias("r"),
    )
    differs = F.transform(
        F.arrays_zip("c", "r"),
        lambda p: ~(p["c"]["role"].eqNullSafe(p["r"]["role"]) & p["c"]["text"].eqNullSafe(p["r"]["text"])),
    )
    first = F.array_position(differs, True)
    shared = F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int")
    cut = sides.withColumn("shared", shared)

    def rest(side: str) -> Column:
        return F.slice(side, F.col("shared") + 1, F.greatest(F.size(side) - F.col("shared"), F.lit(0)))

    cut = cut.select(
        "pair_id", "shared", F.slice("c", F.lit(1), F.col("shared")).alias("prompt"), rest("c").alias("c"), rest("r").alias("r")
    )
    return cut.select(
        "pair_id",
        F.col("shared").cast("long").alias("n_prompt_turns"),
        render(F.col("prompt")).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        mask(F.col("c")).alias("chosen_mask"),
        render(F.col("r")).alias("rejected"),
        mask(F.col("r")).alias("rejected_mask"),
    )


def replies(conversations: DataFrame) -> DataFrame:
    """Pairs with a common beginning, one for each conversation that has a turn of the trained role.

    Chosen is the conversation; rejected are its turns before the last one of the trained role and then, in place
    of that turn, the text of the next id's last one ('' if there is none).
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").alias("pair_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    place = F.struct("turn", "role", "text")
    last = turns.where(F.col("role") == TRAINED_ROLE).groupBy("pair_id").agg(F.max(place).alias("last"))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last.text").alias("other"))
    last = last.join(other, "pair_id", "left")
    paired = turns.join(last, "pair_id")
    columns = ["pair_id", "chosen", "turn", "role", "text"]
    chosen = paired.withColumn("chosen", F.lit(True)).select(columns)
    shared = paired.where(place < F.col("last")).withColumn("chosen", F.lit(False)).select(columns)
    reply = last.select(
        "pair_id", F.lit(False).alias("chosen"), "last.turn", F.lit(TRAINED_ROLE).alias("role"), F.coalesce("other", F.lit("")).alias("text")
    )
    return chosen.union(shared).union(reply)


def joined(spans: str) -> Column:
    """start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
