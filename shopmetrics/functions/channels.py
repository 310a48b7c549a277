"""Traffic channel vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order attribution labels and sources behind each reporting channel.
PAID_SEARCH_LABELS = ["Paid Search", "Paid Other", "Paid"]
SMS_LABELS = ["SMS", "Text"]
SEARCH_SOURCES = ["google", "bing", "yahoo", "duckduckgo"]
SOCIAL_SOURCES = ["facebook", "instagram"]
# Traffic channel groups that order tracking cannot tell from paid search.
FOLDED_GROUPS = ["Paid Shopping", "Cross-network"]


def normalize_channel(
    channel: Column,
    source: Column,
    missing: Column | None = None,
    missing_label: str = "Unassigned",
) -> Column:
    """Reporting channel of an order.

    ``missing`` marks orders without an attribution row; they get
    ``missing_label`` ("Unassigned" in traffic reports, "Unknown" in customer
    acquisition).
    """
    src = F.lower(source)
    label = (
        F.when(channel == "Paid Social", "Paid Social")
        .when(channel.isin(PAID_SEARCH_LABELS), "Paid Search")
        .when(channel == "Email", "Email")
        .when(channel.isin(SMS_LABELS), "SMS")
        .when((channel == "Seo") | src.isin(SEARCH_SOURCES), "Organic Search")
        .when(src == "direct", "Direct")
        .when(src.isin(SOCIAL_SOURCES), "Organic Social")
    )
    if missing is not None:
        label = label.when(missing, missing_label)
    return label.otherwise("Unassigned")


def fold_channel_group(group: Column) -> Column:
    """Traffic channel group in the vocabulary of the orders."""
    return F.when(group.isin(FOLDED_GROUPS), "Paid Search").otherwise(group)
