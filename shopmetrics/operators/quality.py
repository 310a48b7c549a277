"""Data-quality checks. Each returns violations; an empty result means clean."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from shopmetrics.operators.annotations import CATEGORIES
from shopmetrics.sources.schema import DDL, KEYS, REFERENCES, table_schema


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def check_references(
    child: DataFrame, parent: DataFrame, keys: list[str], parent_keys: list[str] | None = None
) -> DataFrame:
    """Child key values without a parent, with their row counts; NULL keys reference nothing.

    Children are counted per key first, so a repeated missing key is one row.
    """
    used = child.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))
    known = parent.select(*[F.col(p).alias(k) for p, k in zip(parent_keys or keys, keys, strict=True)])
    return used.join(known, keys, "left_anti")


def check_domains(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule, counted in one pass; a NULL outcome passes, as in SQL CHECK."""
    counts = df.agg(*[F.count(F.when(~ok, 1)).alias(name) for name, ok in rules.items()])
    long = F.explode(F.create_map(*[x for name in rules for x in (F.lit(name), F.col(f"`{name}`"))]))
    return counts.select(long.alias("rule", "violations")).filter(F.col("violations") > 0)


def declared_rules(name: str) -> dict[str, Column]:
    """NOT NULL columns and value checks declared for a table."""
    rules = {f"{f.name} not null": F.col(f.name).isNotNull() for f in table_schema(name).fields if not f.nullable}
    if name == "order_discounts":
        rules["kind known"] = F.col("kind").isin("CODE", "AUTOMATIC", "MANUAL")
        rules["amount or percentage"] = F.col("value_amount").isNotNull() | F.col("value_percentage").isNotNull()
    if name == "annotations":
        rules["category known"] = F.col("category").isin(CATEGORIES)
    return rules


def key_report(tables: Mapping[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """Duplicate keys per table and key."""
    parts = []
    for name in names or list(KEYS):
        for keys in KEYS[name]:
            dup = check_keys(tables[name], keys).agg(
                F.count("*").alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
            )
            parts.append(dup.select(F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key"), "*"))
    return _union(parts)


def reference_report(
    tables: Mapping[str, DataFrame], references: list[tuple[str, str, list[str], list[str]]] = REFERENCES
) -> DataFrame:
    """Orphans per declared reference.

    Each table is read once: a row gives a tagged key for every parent key that it is and for every reference
    that it holds. The tags of a key are counted before and after one shuffle, so a key that very many rows miss
    is one row per task; all references of a parent are answered from its keys. NULL keys reference nothing.
    Keys of whole numbers travel as numbers, others as text, and a row has a counter for each
    reference of the parent with the most of them, not for each of all references.
    """
    parents = list(dict.fromkeys((parent, tuple(pk)) for _, parent, _, pk in references))
    group = [parents.index((parent, tuple(pk))) for _, parent, _, pk in references]
    slot = [group[:i].count(g) for i, g in enumerate(group)]
    is_parent = max(slot) + 1

    def whole(g: int) -> bool:
        sides = [(parents[g][0], list(parents[g][1]))] + [(c, keys) for (c, _, keys, _), of in zip(references, group, strict=True) if of == g]
        return all(isinstance(tables[t].schema[k].dataType, IntegralType) for t, keys in sides for k in keys)

    numbers = [whole(g) for g in range(len(parents))]
    nums = [f"num{j}" for j in range(max([len(pk) for (_, pk), n in zip(parents, numbers, strict=True) if n], default=0))]

    def tag(g: int, keys: list[str], value: int) -> Column:
        """A tagged key, null if any part of it is."""
        num = dict(zip(nums, keys, strict=False)) if numbers[g] else {}
        text = F.lit(None).cast("array<string>") if numbers[g] else F.array(*[F.col(k).cast("string") for k in keys])
        parts = [(F.col(num[n]) if n in num else F.lit(None)).cast("bigint").alias(n) for n in nums]
        known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
        return F.when(known, F.struct(F.lit(g).alias("g"), *parts, text.alias("key"), F.lit(value).alias("tag")))

    rows = []
    for name in dict.fromkeys(t for child, parent, _, _ in references for t in (child, parent)):
        roles = [(g, pk, is_parent) for g, (parent, pk) in enumerate(parents) if parent == name]
        roles += [(group[i], keys, slot[i]) for i, (child, _, keys, _) in enumerate(references) if child == name]
        tagged = [tag(g, list(keys), value) for g, keys, value in roles]
        rows.append(tables[name].select(F.inline(F.array_compact(F.array(*tagged)))))
    counts = [F.count_if(F.col("tag") == i).alias(f"n{i}") for i in range(is_parent)]
    keys = reduce(DataFrame.union, rows).groupBy("g", *nums, "key").agg(F.max(F.col("tag") == is_parent).alias("known"), *counts)
    missing = keys.where("not known")
    sums = missing.agg(
        *[F.count_if((F.col("g") == g) & (F.col(f"n{s}") > 0)).alias(f"k{i}") for i, (g, s) in enumerate(zip(group, slot, strict=True))],
        *[F.coalesce(F.sum(F.when(F.col("g") == g, F.col(f"n{s}"))), F.lit(0)).alias(f"r{i}") for i, (g, s) in enumerate(zip(group, slot, strict=True))],
    )
    report = [
        F.struct(
            F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.lit(",".join(keys)).alias("key"),
            F.col(f"k{i}").alias("orphan_keys"), F.col(f"r{i}").alias("rows"),
        )
        for i, (child, parent, keys, _) in enumerate(references)
    ]
    return sums.select(F.inline(F.array(*report)))


def domain_report(tables: Mapping[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """Broken declared rules per table."""
    return _union(
        [
            check_domains(tables[n], declared_rules(n)).select(F.lit(n).alias("table_name"), "*")
            for n in names or list(DDL)
        ]
    )


def check_metric_bounds(result: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Columns of a report that leave their contract, with the number of rows and the extremes.

    A report that breaks its contract is returned whole and flagged here.
    """
    outside = {}
    for name, (low, high) in bounds.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(name) < low)
        if high is not None:
            bad = bad | (F.col(name) > high)
        outside[name] = bad
    aggs = []
    for name, bad in outside.items():
        value = F.when(bad, F.col(name).cast("double"))
        aggs.append(
            F.struct(
                F.lit(name).alias("metric"),
                F.count(value).alias("violations"),
                F.min(value).alias("lowest"),
                F.max(value).alias("highest"),
            )
        )
    return result.agg(F.array(*aggs).alias("m")).select(F.inline("m")).filter(F.col("violations") > 0)


def term_scan(tables: Mapping[str, DataFrame], regex: str) -> DataFrame:
    """Rows per text column in which a term still occurs, upper or lower case.

    One pass per table over all its string columns.
    """
    pattern = f"(?i){regex}"
    parts = []
    for name, df in tables.items():
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
        if not cols:
            continue
        hits = df.agg(*[F.count(F.when(F.col(c).rlike(pattern), 1)).alias(c) for c in cols])
        entries = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c))])
        parts.append(
            hits.select(F.explode(entries).alias("column_name", "hits"))
            .filter(F.col("hits") > 0)
            .select(F.lit(name).alias("table_name"), "column_name", "hits")
        )
    return _union(parts)
