"""Text predicates and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_product_sku(sku: Column) -> Column:
    """False for package-protection lines; a NULL SKU is a product."""
    code = F.coalesce(sku, F.lit(""))
    return (code != "x-redo") & ~code.startswith("ROUTEINS")


def strip(col: Column) -> Column:
    """Remove all leading and trailing whitespace, not only spaces."""
    return F.regexp_replace(F.regexp_replace(col, r"^\s+", ""), r"\s+$", "")


def mask_email(email: Column) -> Column:
    """``ja***@example.com``: two characters of the local part and the domain stay."""
    clean = F.lower(strip(email))
    at = F.instr(clean, "@")
    domain = clean.substr(at + 1, F.length(clean))
    shown = F.when(at > 3, clean.substr(F.lit(1), F.lit(2))).otherwise("")
    return (
        F.when(email.isNull() | (email == ""), "(no email)")
        .when(at == 0, "***")
        .otherwise(F.concat(shown, F.lit("***@"), domain))
    )
