"""Deterministic salted draws and the pseudonyms derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First and last names of generated people.
FIRST_NAMES = [
    "Ava", "Liam", "Noah", "Emma", "Olivia", "Lucas", "Mia", "Ethan", "Sofia", "Mason",
    "Isla", "Logan", "Zoe", "Owen", "Nora", "Caleb", "Layla", "Wyatt", "Chloe", "Julian",
]
LAST_NAMES = [
    "Carter", "Bennett", "Hayes", "Morgan", "Reed", "Sullivan", "Brooks", "Foster", "Ellis", "Parker",
    "Sawyer", "Coleman", "Harper", "Griffin", "Nash", "Dawson", "Quinn", "Tucker", "Vance", "Whitman",
]


def salted_hash(text: Column, salt: str) -> Column:
    """Non-negative 31-bit integer drawn from the text and the salt."""
    head = F.substring(F.md5(F.concat(text, F.lit(salt))), 1, 8)
    return F.conv(head, 16, 10).cast("bigint").bitwiseAND(F.lit(2**31 - 1).cast("bigint"))


def salted_uniform(text: Column, salt: str) -> Column:
    """Draw in [0, 1) in steps of 1/10000, as decimal(5,4)."""
    return ((salted_hash(text, salt) % 10000).cast("decimal(5,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast(
        "decimal(5,4)"
    )


def pick(words: list[str], index: Column) -> Column:
    """Word at a 0-based index, wrapping around the list."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words)).cast("int") + 1)


def fake_name(text: Column, salt: str) -> Column:
    """Two-word personal name drawn from the text."""
    h = salted_hash(text, salt)
    return F.concat_ws(" ", pick(FIRST_NAMES, h), pick(LAST_NAMES, F.floor(h / 97)))


def anonymize_path(url: Column, salt: str) -> Column:
    """Path of a URL without host, query or fragment; product and collection slugs become opaque."""
    path = F.regexp_replace(F.regexp_replace(url, r"^https?://[^/]+", ""), r"(?s)[?#].*$", "")
    h = salted_hash(path, salt)

    def numbered(prefix: str, modulus: int, width: int) -> Column:
        return F.concat(F.lit(prefix), F.lpad((h % modulus).cast("string"), width, "0"))

    return (
        F.when(path.startswith("/products/"), numbered("/products/item-", 100000, 5))
        .when(path.startswith("/collections/"), numbered("/collections/collection-", 1000, 3))
        .when(path == "", "/")
        .otherwise(path)
    )
