"""Global numbering, quantile buckets and shares without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row to one
task. Here the rows are range-partitioned and sorted in parallel, written once
with their position inside the partition, and numbered by adding the sizes of
the partitions before them. Buckets of equal size need no order of all rows, only
the few rows at their edges, which counting passes find.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.functions.money import percent_of
from shopmetrics.sources.staging import stage

_POSITION_BITS = 33  # layout of monotonically_increasing_id: partition id above, row position below


def _numbered(df: DataFrame, order_cols: list[Column], out: str, total: str, label: str) -> DataFrame:
    staged = stage(
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_pos", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("_pos", _POSITION_BITS)
    # One row per range partition, so both the window and the broadcast are
    # bounded by the number of shuffle partitions.
    counts = staged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy()).alias("_total"),
    )
    local = F.col("_pos").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        staged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumns({out: F.col("_offset") + local + 1, total: F.col("_total")})
        .drop("_part", "_pos", "_offset", "_total")
    )


def assign_row_numbers(
    df: DataFrame, order_cols: list[Column], out: str = "row_number", label: str = "numbered"
) -> DataFrame:
    """Add the 1-based global rank of each row.

    ``order_cols`` should end with a unique column: the order is then total, the
    numbers repeatable, and a heavily repeated leading value is still split over
    range partitions.
    """
    return _numbered(df, order_cols, out, "_total_rows", label).drop("_total_rows")


@dataclass(frozen=True)
class Key:
    """A column of a total order: a number, date, timestamp or boolean."""

    name: str
    descending: bool = False
    nulls_last: bool = False


#: Sub-intervals that one pass counts for each open edge, and rows that a narrowed interval may bring to the driver.
BINS, FEW_ROWS = 2048, 4096

_INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def _levels(df: DataFrame, order: list[Key]) -> tuple[list[Column], list[Column]]:
    """Whole numbers that sort ascending as the keys do: per key whether it is null, then its value."""
    flags, values = [], []
    for key in order:
        kind, col = df.schema[key.name].dataType.simpleString(), F.col(key.name)
        if kind.startswith("decimal"):
            scale = int(kind.rstrip(")").split(",")[1])
            col = (col * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("decimal(38,0)")
        elif kind == "date":
            col = F.unix_date(col)
        elif kind == "timestamp_ntz":
            of_day = F.hour(col) * 3600 + F.minute(col) * 60 + F.extract(F.lit("SECOND"), col)
            col = (F.unix_date(F.to_date(col)).cast("decimal(12,0)") * 86400 + of_day) * 1000000
        elif kind == "timestamp":
            col = F.unix_micros(col)
        elif kind == "boolean":
            col = col.cast("int")
        elif kind not in _INTEGERS:
            raise TypeError(f"{key.name} of type {kind} can't be split into intervals")
        col = col.cast("decimal(38,0)")
        flags.append(F.when(F.col(key.name).isNull(), 1 if key.nulls_last else -1).otherwise(0).cast("decimal(38,0)"))
        values.append(F.coalesce(-col if key.descending else col, F.lit(0).cast("decimal(38,0)")))
    return flags, values


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


@dataclass(frozen=True)
class _Interval:
    """Rows whose first levels are ``fixed`` and whose next one lies in [low, high]."""

    fixed: tuple[int, ...]
    low: int
    high: int

    def holds(self, names: list[str]) -> Column:
        same = [F.col(c) == _number(v) for c, v in zip(names, self.fixed, strict=False)]
        return reduce(Column.__and__, [*same, F.col(names[len(self.fixed)]).between(_number(self.low), _number(self.high))])

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // BINS)


def _edges(levels: DataFrame, names: list[str], ranks: list[int], bounds: list[tuple[int, int]]) -> list[tuple[int, ...]]:
    """The rows (as tuples of levels) at the given ranks, from 1, of the sorted table ``levels``.

    Each pass counts the rows of every open interval in BINS parts and goes on with the part that holds the
    rank; a level whose part is one value is settled, the next level then splits its ties. Rows reach the driver when an interval
    holds FEW_ROWS at most. Passes read the levels alone and combine their counts before a small shuffle.
    """
    found: dict[int, tuple[int, ...]] = {}
    open_ = {r: (_Interval((), *bounds[0]), r, None) for r in ranks}
    while open_:
        small = {i for i, _, n in open_.values() if n is not None and n <= FEW_ROWS}
        if small:
            tagged = [F.when(i.holds(names), F.lit(k)) for k, i in enumerate(small)]
            rows = levels.select(F.coalesce(*tagged).alias("i"), *names).where("i is not null").collect()
            sorted_rows = {i: sorted(tuple(int(v) for v in r[1:]) for r in rows if r[0] == k) for k, i in enumerate(small)}
            for r, (i, rest, _) in list(open_.items()):
                if i in small:
                    found[r] = sorted_rows[i][rest - 1]
                    del open_[r]
            continue
        intervals = list({i for i, _, _ in open_.values()})
        place = [
            F.when(i.holds(names), F.struct(F.lit(k).alias("i"), F.call_function("div", F.col(names[len(i.fixed)]) - _number(i.low), _number(i.width)).alias("bin")))
            for k, i in enumerate(intervals)
        ]
        counts = levels.select(F.coalesce(*place).alias("p")).where("p is not null").groupBy("p").agg(F.count("*").alias("n")).collect()
        bins: dict[int, list[tuple[int, int]]] = {}
        for row in counts:
            bins.setdefault(row["p"]["i"], []).append((row["p"]["bin"], row["n"]))
        for r, (i, rest, _) in list(open_.items()):
            for part, n in sorted(bins[intervals.index(i)]):
                if rest <= n:
                    break
                rest -= n
            low = i.low + part * i.width
            high = min(i.high, low + i.width - 1)
            if low < high:
                open_[r] = (_Interval(i.fixed, low, high), rest, n)
            elif len(i.fixed) + 1 < len(names):
                open_[r] = (_Interval((*i.fixed, low), *bounds[len(i.fixed) + 1]), rest, n)
            else:
                found[r] = (*i.fixed, low)
                del open_[r]
    return [found[r] for r in ranks]


def ntile_global(df: DataFrame, order: list[Key], k: int, out: str = "ntile") -> DataFrame:
    """``NTILE(k) OVER (ORDER BY ...)`` over the whole table, by selection of the k - 1 rows that end a bucket.

    The rows are neither sorted nor moved: their keys are written once, read by a few counting passes, and each
    row is compared with the edges. ``order`` must end with a unique key.
    """
    flags, values = _levels(df, order)
    columns = [c for pair in zip(flags, values, strict=True) for c in pair]
    names = [f"_l{j}" for j in range(len(columns))]
    levels = stage(df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)]), "ntile-keys")
    stats = levels.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{t}") for c in names for t, f in (("a", F.min), ("z", F.max))]).first()
    n = stats["n"]
    size, extra = divmod(n, k)
    ends = [size * b + min(b, extra) for b in range(1, k)]
    ranks = sorted({e for e in ends if 0 < e < n})
    edges = _edges(levels, names, ranks, [(int(stats[f"{c}a"]), int(stats[f"{c}z"])) for c in names]) if ranks else []

    def after(edge: tuple[int, ...]) -> Column:
        later = F.lit(False)
        for c, v in reversed(list(zip(columns, edge, strict=True))):
            later = (c > _number(v)) | ((c == _number(v)) & later)
        return F.when(later, 1).otherwise(0)

    return df.withColumn(out, reduce(Column.__add__, [after(e) for e in edges], F.lit(1)))


def rank_top(df: DataFrame, measure: str, tie_cols: list[str], out: str = "rank") -> DataFrame:
    """Rank of an aggregate of any size: measure descending, NULLs last, ties by ``tie_cols``."""
    order = [F.col(measure).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_cols]]
    return assign_row_numbers(df, order, out, label="rank")


def share_of_total(df: DataFrame, col: str, out: str, digits: int = 2) -> DataFrame:
    """Percent of the column total, which a scalar subquery computes without moving the rows."""
    return df.withColumn(out, percent_of(F.col(col), df.agg(F.sum(col)).scalar(), digits))


def top_with_rest(df: DataFrame, label: str, rank_by: str, measures: list[str], k: int, rest: str) -> DataFrame:
    """Keep the ``k`` labels with the largest measure and fold all others into ``rest``.

    The top is a TakeOrdered of k rows, so the number of labels may be large. A
    label that is itself called ``rest`` merges with the fold.
    """
    order = [F.col(rank_by).desc_nulls_last(), F.col(label).asc()]
    top = df.orderBy(*order).limit(k)
    # The top carries its measures along so that both sides of the join need the
    # same columns of ``df`` and Spark computes that aggregate once.
    kept = top.select(label, F.lit(True).alias("_kept"), *[F.col(m).alias(f"_{m}") for m in measures])
    marked = df.join(F.broadcast(kept), label, "left")
    name = F.when(F.col("_kept"), F.col(label)).otherwise(F.lit(rest))
    return (
        marked.select(name.alias(label), *[F.coalesce(f"_{m}", m).alias(m) for m in measures])
        .groupBy(label)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
