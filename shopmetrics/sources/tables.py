"""Typed scans and bulk copies of the canonical tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from shopmetrics.functions.dates import instant_to_utc
from shopmetrics.functions.money import UNIT
from shopmetrics.sources.schema import DDL, GENERATED, table_schema


def derive_line_columns(lines: DataFrame) -> DataFrame:
    """Add the generated columns: ``is_returned`` and ``net_sales``."""
    return lines.selectExpr(
        *[c for c in lines.columns if c not in GENERATED["order_line_items"]],
        "returned_quantity > 0 AS is_returned",
        f"CAST(discounted_unit_price * current_quantity AS {UNIT}) AS net_sales",
    )


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select the declared columns, in order and in their declared types."""
    cols = []
    for field in table_schema(name).fields:
        col = F.col(field.name)
        if isinstance(df.schema[field.name].dataType, TimestampType):
            col = instant_to_utc(col)
        cols.append(col.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def load_tables(
    spark: SparkSession, path: str, names: Iterable[str] | None = None, fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """Lazy scans of ``<path>/<table>`` with declared schemas; generated columns are added."""
    out = {}
    for name in names or DDL:
        df = spark.read.schema(table_schema(name)).format(fmt).load(f"{path}/{name}")
        out[name] = derive_line_columns(df) if name in GENERATED else df
    return out


def write_table(df: DataFrame, name: str, path: str, fmt: str = "parquet") -> None:
    """Write one canonical table without its generated columns."""
    df.drop(*GENERATED.get(name, [])).write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def bounds_query(table: str, column: str) -> str:
    """Query for the least and largest value of a whole-number column and the number of rows."""
    return f"SELECT min({column}) AS low, max({column}) AS high, count(*) AS n FROM {table}"


def histogram_query(table: str, column: str, low: int, width: int) -> str:
    """Query for the rows in each ``width`` values of a column from ``low`` on; rows without a value aren't counted."""
    part = f"floor(({column} - ({low})) / {width}.0)"
    return f"SELECT {part} AS part, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY {part}"


def histogram_width(low: int, high: int, rows: int, rows_per_task: int, fineness: int = 8) -> int:
    """Values per part, so that there are about ``fineness`` parts for each task of evenly spread rows."""
    parts = max(1, fineness * -(-rows // rows_per_task))
    return max(1, -(-(high - low + 1) // parts))


def even_predicates(column: str, low: int, width: int, counts: Mapping[int, int], rows_per_task: int) -> list[str]:
    """Ranges of a column that each hold about ``rows_per_task`` rows and together every row once.

    Neighbouring parts are joined until the next one would exceed the number; a part that exceeds it alone is a range of
    its own. The first range is open below and takes the rows without a value, the last is open above, so rows that
    arrive after the counting are read too.
    """
    cuts, held = [], 0
    for part in sorted(counts):
        if held and held + counts[part] > rows_per_task:
            cuts.append(low + part * width)
            held = 0
        held += counts[part]
    edges = [None, *cuts, None]
    ranges = []
    for a, b in zip(edges, edges[1:], strict=False):
        inside = " AND ".join([f"{column} >= {a}"] * (a is not None) + [f"{column} < {b}"] * (b is not None)) or "1 = 1"
        ranges.append(f"({inside}) OR {column} IS NULL" if a is None and b is not None else inside)
    return ranges


def jdbc_predicates(spark: SparkSession, options: Mapping[str, str], table: str, column: str, rows_per_task: int) -> list[str]:
    """Plan the parallel read of a database table: two small queries, whose results are one row and one row per part."""
    reader = spark.read.format("jdbc").options(**dict(options))
    low, high, rows = reader.option("query", bounds_query(table, column)).load().first()
    if low is None:
        return ["1 = 1"]
    width = histogram_width(int(low), int(high), int(rows), rows_per_task)
    counts = reader.option("query", histogram_query(table, column, int(low), width)).load().collect()
    return even_predicates(column, int(low), width, {int(part): int(n) for part, n in counts}, rows_per_task)


def copy_tables(
    spark: SparkSession,
    src: str,
    dst: str,
    names: Iterable[str] | None = None,
    src_format: str = "parquet",
    dst_format: str = "parquet",
    src_options: Mapping[str, str] | None = None,
    split_columns: Mapping[str, str] | None = None,
    rows_per_task: int = 1_000_000,
) -> list[str]:
    """Copy base tables between locations, leaving generated columns out.

    The order of the tables does not matter; ``src_format="jdbc"`` reads each table by name with the given
    options, in ranges of about ``rows_per_task`` rows where ``split_columns`` names a whole-number column of it.
    """
    if src.rstrip("/") == dst.rstrip("/"):
        raise ValueError("source and target are the same location")
    options, split = dict(src_options or {}), split_columns or {}
    reader = spark.read.format(src_format).options(**options)
    copied = []
    for name in names or DDL:
        if src_format != "jdbc":
            df = reader.load(f"{src}/{name}")
        elif name in split:
            ranges = jdbc_predicates(spark, options, name, split[name], rows_per_task)
            df = spark.read.jdbc(options["url"], name, predicates=ranges, properties={k: v for k, v in options.items() if k != "url"})
        else:
            df = reader.option("dbtable", name).load()
        write_table(conform(df, name), name, dst, dst_format)
        copied.append(name)
    return copied
