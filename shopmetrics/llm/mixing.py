"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source_size times. The whole part is taken
outright; the fractional part is a probability, and probability times words is the document's
mass. Two fractional documents are paired: mass moves from one to the other, in a random
direction that leaves both expectations unchanged, until one of them is taken or left
altogether; the other one carries the rest on. The words of a source are thereby conserved.
Groups of about ``GROUP`` documents are rounded side by side, and the one document that stays
fractional in each group goes to the next level, a reduction tree of few levels for any size of
source. The last residual of a source is taken in part, so that the source meets its target to
half a word per repeated row, or is rounded to whole copies at random.

Everything runs in DataFrame functions. Randomness is a hash of seed and documents, so reruns
agree. The targets are found by sharing the total by weight and resharing what exceeds a
source's limit until nothing does.

Defined cases: a null text has no words and takes none; rows that agree in id, source and size
are rounded as one document whose words are counted for each of them; null sources form the
last source; a null id is an id like any other; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import fresh
from shopmetrics.operators.distributed import assign_row_numbers
from shopmetrics.sources.staging import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
GROUP = 128
SEED = 20260

WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Adds rank, weight and target to rows of (source, n_items, source_size), one per source."""
    order = [F.col("source").asc_nulls_last()]
    ranked = assign_row_numbers(sizes, order, out="rank", label="mix-ranked")
    at = ((F.col("rank") - 1) % len(weights)).cast("int")
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), at))
    ranked = stage(ranked.withColumn("limit", (most * F.col("source_size")).cast("double")), "mix-sources")
    words, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * (words or 0)
    level, capped = total / weight if weight else 0.0, -1
    while weight:
        above = F.col("limit") <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if row[0] == capped or not row[2]:
            break
        capped = row[0]
        level = (total - (row[1] or 0.0)) / row[2]
    return ranked.withColumn("target", F.least("limit", F.lit(level) * F.col("weight")))


def _uniform(*cols: Column) -> Column:
    """A draw from [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_ITEM = "struct<draw:bigint,doc_id:{id},size:bigint,same:bigint,base:bigint,mass:double>"
_DONE = "array<struct<doc_id:{id},size:bigint,same:bigint,base:bigint,extra:double>>"


def _pivot(items: Column, seed: int, kind: str) -> Column:
    """Rounds an array of items pair by pair: (rest: the fractional item or null, done: the others)."""
    item, done = _ITEM.format(id=kind), _DONE.format(id=kind)
    state = f"struct<rest:{item},done:{done}>"

    def settled(x: Column, extra: Column) -> Column:
        return F.array(F.struct(x.doc_id, x.size, x.same, x.base, extra.alias("extra")))

    def with_mass(x: Column, mass: Column) -> Column:
        return x.withField("mass", mass)

    def pair(acc: Column, y: Column) -> Column:
        x = acc.rest
        x_full, y_full = (x.size * x.same).cast("double"), (y.size * y.same).cast("double")

        def moved(d: Column) -> Column:
            # forth: from x to y until x is empty or y is full; back: from y to x likewise
            down = d.draw * (d.forth + d.back) < d.back
            x_ends, y_ends = d.forth == x.mass, d.back == y.mass
            one, none = F.lit(1.0), F.lit(0.0)
            nobody = F.lit(None).cast(item)

            def result(rest: Column, settled_now: Column) -> Column:
                return F.struct(rest.alias("rest"), F.concat(acc.done, settled_now).alias("done"))

            forth = F.when(
                x_ends & (y.mass + d.forth >= y_full), result(nobody, F.concat(settled(x, none), settled(y, y_full)))
            ).when(x_ends, result(with_mass(y, y.mass + d.forth), settled(x, none))).otherwise(
                result(with_mass(x, x.mass - d.forth), settled(y, y_full))
            )
            back = F.when(
                y_ends & (x.mass + d.back >= x_full), result(nobody, F.concat(settled(y, none), settled(x, x_full)))
            ).when(y_ends, result(with_mass(x, x.mass + d.back), settled(y, none))).otherwise(
                result(with_mass(y, y.mass - d.back), settled(x, x_full))
            )
            del one
            return F.when(down, forth).otherwise(back).cast(state)

        moves = F.struct(
            F.least(x.mass, y_full - y.mass).alias("forth"),
            F.least(y.mass, x_full - x.mass).alias("back"),
            _uniform(F.lit(seed), x.draw, x.size, y.draw, y.size).alias("draw"),
        )
        first = F.struct(y.alias("rest"), acc.done.alias("done")).cast(state)
        return F.when(x.isNull(), first).otherwise(_let(moves, moved))

    empty = F.struct(F.lit(None).cast(item).alias("rest"), F.array().cast(done).alias("done")).cast(state)
    return F.aggregate(items, empty, pair)


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, group: int = GROUP,
    seed: int = SEED, residual: str = "partial",
) -> DataFrame:
    """One row per (doc_id, source, size): same (rows), source_size, target, taken (words of each such row).

    ``residual``: "partial" takes the last document of a source in part, "whole" rounds it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    items = stage(items.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("same")), "mix-items")
    words = F.sum(F.col("size") * F.col("same")).alias("source_size")
    sources = source_targets(items.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), words), weights, share, most)
    sources = stage(sources.select("source", "n_items", "source_size", "target"), "mix-targets")
    by_source = sources.withColumnRenamed("source", "s")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = items.join(by_source, items["source"].eqNullSafe(by_source["s"])).drop("s")
    known = known.withColumn("base", F.least(F.floor(copies), F.lit(most)).cast("long"))
    full = F.col("size") * F.col("same")
    known = known.withColumn("mass", (copies - F.col("base")) * full)
    columns = ["source", "doc_id", "size", "same", "base"]
    whole = known.where("mass <= 0").select(*columns, F.lit(0.0).alias("extra"))
    open_items = known.where("mass > 0").select("source", "n_items", *columns[1:], "mass")
    open_items = stage(open_items, "mix-open")
    left = open_items.agg(F.max("n_items")).first()[0] or 0
    level, settled = 0, whole
    while left:
        draw = F.xxhash64(F.lit(seed + level), "doc_id", "size")
        groups = F.ceil(F.col("n_items") / F.lit(group))
        item = F.struct(draw.alias("draw"), "doc_id", "size", "same", "base", "mass")
        rounded = open_items.groupBy("source", groups.alias("groups"), F.pmod(F.xxhash64(draw), groups).alias("part")).agg(
            _pivot(F.array_sort(F.collect_list(item.cast(_ITEM.format(id=kind)))), seed + level, kind).alias("out")
        )
        rounded = stage(rounded.select("source", "groups", "out"), "mix-level")
        done = rounded.select("source", F.explode("out.done").alias("d")).select("source", "d.*")
        settled = settled.union(done.select(*columns, "extra"))
        rest = rounded.where("out.rest is not null").select("source", "groups", "out.rest.*")
        if math.ceil(left / group) <= 1:
            amount = F.col("mass")
            if residual == "whole":
                lucky = _uniform(F.lit(seed), "doc_id", "size", F.lit("last")) * full < F.col("mass")
                amount = F.when(lucky, full).otherwise(0).cast("double")
            settled = settled.union(rest.select(*columns, amount.alias("extra")))
            break
        # A source with one group only has nothing left to pair: it goes up as it is until the others end.
        open_items = rest.select("source", F.col("groups").alias("n_items"), *columns[1:], "mass")
        left, level = math.ceil(left / group), level + 1
    taken = F.col("base") * F.col("size") + F.round(F.col("extra") / F.col("same")).cast("long")
    settled = settled.withColumn("taken", taken)
    out = settled.join(by_source, settled["source"].eqNullSafe(by_source["s"]))
    return out.select("doc_id", "source", "size", "same", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (never, once or twice), with their columns."""
    size, copy = fresh(docs, "mix_size"), fresh(docs, "mix_copy")
    decided = mix(docs.select("doc_id", "source", "text"), seed=seed, residual="whole").where("taken > 0")
    decided = decided.select(
        F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("n"), F.expr("taken div size").alias(copy)
    )
    sized = docs.withColumn(size, word_count(docs["text"]))
    same = sized["doc_id"].eqNullSafe(decided["d"]) & sized["source"].eqNullSafe(decided["s"]) & (sized[size] == decided["n"])
    out = sized.join(decided, same)
    return out.select(*[sized[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), copy)).alias(copy)).drop(copy)
