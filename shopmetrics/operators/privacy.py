"""Whole-dataset anonymisation with consistent pseudonyms and self-verification."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.draws import anonymize_path, fake_name, pick, salted_hash
from shopmetrics.functions.money import TOTAL, UNIT
from shopmetrics.functions.text import is_product_sku
from shopmetrics.operators.distributed import assign_row_numbers
from shopmetrics.operators.totals import measures, sales_totals, unpivoted
from shopmetrics.sources.lazy import LazyTables, Tables
from shopmetrics.sources.staging import stage
from shopmetrics.sources.tables import derive_line_columns

# Words of generated product titles.
ADJECTIVES = [
    "Classic", "Everyday", "Heritage", "Coastal", "Urban", "Alpine", "Cedar", "Ember", "Willow", "Harbor",
    "Summit", "Meadow", "Ridge", "Sterling", "Maple", "Slate", "Juniper", "Aurora", "Copper", "Fable",
]
NOUNS = [
    "Tote", "Jacket", "Hoodie", "Scarf", "Beanie", "Sneaker", "Backpack", "Crewneck", "Cardigan", "Parka",
    "Tee", "Joggers", "Boots", "Vest", "Blanket", "Cap", "Pouch", "Sandal", "Overshirt", "Duffel",
    "Shorts", "Wallet", "Mittens", "Robe", "Slipper",
]
# Generated campaign names and review texts.
CAMPAIGN_NAMES = ["Prospecting", "Retargeting", "Catalog Sales", "Brand Awareness", "Seasonal Promo"]
GOOD_TITLES = ["Love it", "Great quality", "Exactly what I wanted", "Highly recommend"]
FAIR_TITLES = ["It is okay", "Decent for the price", "Average"]
POOR_TITLES = ["Not what I expected", "Disappointed", "Would not buy again"]
GOOD_TEXTS = [
    "Great quality and fits perfectly. Would buy again.",
    "Very comfortable and well made, arrived quickly.",
    "Looks even better in person. Happy with this purchase.",
]
FAIR_TEXTS = [
    "Nice enough, though sizing runs a bit small.",
    "Does the job. Material could be a little better.",
    "Average quality for the price.",
]
POOR_TEXTS = [
    "Quality was lower than I hoped for.",
    "Did not fit well and the material feels thin.",
    "Arrived with a defect, disappointed overall.",
]


def _padded(n: Column, width: int) -> Column:
    """Number padded with zeros; longer numbers keep all their digits, so names stay unique."""
    return F.format_string(f"%0{width}d", n)


def _distinct(*cols: tuple[DataFrame, str]) -> DataFrame:
    """Distinct non-NULL values of several columns; each side is deduplicated before the union."""
    parts = [df.select(F.col(c).alias("orig")).dropna().distinct() for df, c in cols]
    return parts[0] if len(parts) == 1 else reduce(DataFrame.union, parts).distinct()


def _drawn_order(df: DataFrame, salt: str, label: str) -> DataFrame:
    """Number the distinct values in the order of their salted hash."""
    drawn = df.withColumn("_h", salted_hash(F.col("orig"), salt))
    return assign_row_numbers(drawn, [F.col("_h").asc(), F.col("orig").asc()], "n", label).drop("_h")


def discount_key(code: Column) -> Column:
    """Discount codes compare without case and surrounding spaces; blank is none."""
    return F.nullif(F.lower(F.trim(code)), F.lit(""))


def product_mapping(tables: Tables, salt: str) -> DataFrame:
    sold = tables["order_line_items"].filter(is_product_sku(F.col("sku")))
    titles = _distinct((sold, "title"), (tables["reviews"], "product_title"))
    i = F.col("n") - 1
    cycle = len(ADJECTIVES) * len(NOUNS)
    round_no = F.floor(i / cycle) + 1
    name = F.concat_ws(
        " ",
        pick(ADJECTIVES, i),
        pick(NOUNS, F.floor(i / len(ADJECTIVES))),
        F.when(round_no > 1, round_no.cast("string")),
    )
    handle = F.lower(F.regexp_replace("new_title", "[^a-zA-Z0-9]+", "-"))
    return _drawn_order(titles, salt, "product").withColumn("new_title", name).withColumn("new_handle", handle)


def season_mapping(tables: Tables) -> DataFrame:
    seasons = _distinct((tables["order_line_items"], "season_code"))
    numbered = assign_row_numbers(seasons, [F.col("orig").asc()], "n", "season")
    return numbered.select("orig", F.concat(F.lit("S"), _padded(F.col("n"), 2)).alias("alias"))


def sku_mapping(tables: Tables, seasons: DataFrame, salt: str) -> DataFrame:
    skus = (
        tables["order_line_items"]
        .filter(is_product_sku(F.col("sku")) & (F.col("sku") != ""))
        .groupBy(F.col("sku").alias("orig"))
        .agg(F.max("season_code").alias("season"))
    )
    alias = seasons.select(F.col("orig").alias("season"), "alias")
    return (
        _drawn_order(skus, salt, "sku")
        .join(alias, "season", "left")
        .select(
            "orig", F.concat_ws("-", F.coalesce("alias", F.lit("GEN")), _padded(F.col("n"), 5)).alias("new_sku")
        )
    )


def discount_mapping(tables: Tables, salt: str) -> DataFrame:
    used = tables["orders"].select(discount_key(F.col("discount_code")).alias("code"))
    named = tables["order_discounts"].select(discount_key(F.col("code_or_title")).alias("code"))
    numbered = _drawn_order(_distinct((used, "code"), (named, "code")), salt, "discount")
    return numbered.select("orig", F.concat(F.lit("PROMO"), _padded(F.col("n"), 3)).alias("new_code"))


def utm_mapping(tables: Tables, salt: str) -> DataFrame:
    numbered = _drawn_order(_distinct((tables["order_attribution"], "utm_campaign")), salt, "utm")
    return numbered.select("orig", F.concat(F.lit("campaign-"), _padded(F.col("n"), 3)).alias("new_val"))


def campaign_mapping(tables: Tables, salt: str) -> DataFrame:
    ids = _distinct(*[(tables[t], "campaign_id") for t in ("campaign_daily", "adset_daily", "ad_daily")])
    n = F.col("n")
    return _drawn_order(ids, salt, "campaign").select(
        "orig",
        F.concat(F.lit("cmp_"), _padded(n, 4)).alias("new_id"),
        F.concat_ws(" ", pick(CAMPAIGN_NAMES, n - 1), _padded(n, 2)).alias("new_name"),
    )


def adset_mapping(tables: Tables, salt: str) -> DataFrame:
    ids = _distinct(*[(tables[t], "adset_id") for t in ("adset_daily", "ad_daily", "adset_meta")])
    return _drawn_order(ids, salt, "adset").select(
        "orig",
        F.concat(F.lit("as_"), _padded(F.col("n"), 5)).alias("new_id"),
        F.concat(F.lit("Ad Set "), _padded(F.col("n"), 3)).alias("new_name"),
    )


def ad_mapping(tables: Tables, salt: str) -> DataFrame:
    ids = _distinct(*[(tables[t], "ad_id") for t in ("ad_daily", "ad_meta")])
    return _drawn_order(ids, salt, "ad").select(
        "orig",
        F.concat(F.lit("ad_"), _padded(F.col("n"), 5)).alias("new_id"),
        F.concat(F.lit("Creative "), _padded(F.col("n"), 4)).alias("new_name"),
    )


LINE_VALUES = ["title", "sku", "season_code"]


def mapping_source(tables: Tables) -> Tables:
    """The tables with the order lines cut down to their distinct titles, SKUs and seasons, written once.

    The catalogue bounds them; three mappings and the rewriting of the lines read them instead of the lines.
    """
    return LazyTables(
        {"order_line_items": lambda: stage(tables["order_line_items"].select(*LINE_VALUES).distinct(), "line-values")}, tables
    )


def build_mappings(tables: Tables, salt: str, source: Tables | None = None) -> Tables:
    """Real value to pseudonym, one table per kind, the same in every place of use."""
    tables = mapping_source(tables) if source is None else source
    maps = LazyTables(
        {
            "product": lambda: product_mapping(tables, salt),
            "season": lambda: season_mapping(tables),
            "sku": lambda: sku_mapping(tables, maps["season"], salt),
            "discount": lambda: discount_mapping(tables, salt),
            "utm": lambda: utm_mapping(tables, salt),
            "campaign": lambda: campaign_mapping(tables, salt),
            "adset": lambda: adset_mapping(tables, salt),
            "ad": lambda: ad_mapping(tables, salt),
        }
    )
    return maps


def _scaled(col: str, k: Decimal, kind: str = UNIT) -> Column:
    return F.round(F.col(col) * F.lit(k).cast("decimal(8,4)"), 2).cast(kind)


def _mapped(df: DataFrame, mapping: DataFrame, key: Column, tag: str) -> DataFrame:
    """Left join to a mapping; its columns come back prefixed with ``tag``."""
    renamed = mapping.select(*[F.col(c).alias(f"{tag}_{c}") for c in mapping.columns])
    return df.join(renamed, key == F.col(f"{tag}_orig"), "left")


def _if_set(col: str, value: Column) -> Column:
    return F.when(F.col(col).isNotNull(), value)


def anonymize_customers(customers: DataFrame, k: Decimal, salt: str) -> DataFrame:
    cid = F.col("customer_id").cast("string")
    mail = F.concat(F.lit("customer"), F.substring(F.md5(F.concat(cid, F.lit(salt))), 1, 12), F.lit("@example.com"))
    return customers.withColumns(
        {
            "email": _if_set("email", mail),
            "display_name": _if_set("display_name", fake_name(cid, salt)),
            "amount_spent": _scaled("amount_spent", k, TOTAL),
            "zip": F.concat(F.substring("zip", 1, 3), F.lit("00")),
            "tags": F.lit(None).cast("string"),
        }
    )


def renumber_orders(orders: DataFrame) -> DataFrame:
    """Contiguous order names, oldest first."""
    numbered = assign_row_numbers(orders, [F.col("created_at").asc(), F.col("order_id").asc()], "_n", "orders")
    name = F.concat(F.lit("#"), (F.col("_n") + 10000).cast("string"))
    return numbered.withColumn("order_name", name).drop("_n")


def anonymize_orders(orders: DataFrame, discounts: DataFrame, k: Decimal, renumber: bool = True) -> DataFrame:
    """Scaled money, new names and pseudonymous discount codes; without ``renumber`` the names stay."""
    money = ["total_amount", "current_total", "total_paid", "total_refunded", "net_payment"]
    out = _mapped(renumber_orders(orders) if renumber else orders, discounts, discount_key(F.col("discount_code")), "d")
    return out.withColumns(
        {**{m: _scaled(m, k, TOTAL) for m in money}, "discount_code": F.col("d_new_code")}
    ).select(*orders.columns)


def anonymize_attribution(attribution: DataFrame, utm: DataFrame, salt: str, brand: str | None) -> DataFrame:
    url = F.col("referrer_url")
    host = F.nullif(F.regexp_extract(url, "^https?://[^/?#]+", 0), F.lit(""))
    if brand:
        host = F.when(~url.rlike(f"(?i){brand}"), host)
    nothing = F.lit(None).cast("string")
    return (
        _mapped(attribution, utm, F.col("utm_campaign"), "u")
        .withColumns(
            {
                "user_agent": nothing,
                "referrer_url": host,
                "landing_page": anonymize_path(F.col("landing_page"), salt),
                "utm_campaign": F.col("u_new_val"),
                "utm_content": nothing,
                "utm_term": nothing,
            }
        )
        .select(*attribution.columns)
    )


def anonymize_discounts(discounts: DataFrame, codes: DataFrame, k: Decimal) -> DataFrame:
    return (
        _mapped(discounts, codes, discount_key(F.col("code_or_title")), "d")
        .withColumns(
            {
                "value_amount": _scaled("value_amount", k),
                "description": _if_set("description", F.lit("Manual discount")),
                "code_or_title": F.coalesce("d_new_code", "code_or_title"),
            }
        )
        .select(*discounts.columns)
    )


def anonymize_lines(
    lines: DataFrame, values: DataFrame, products: DataFrame, skus: DataFrame, seasons: DataFrame, k: Decimal
) -> DataFrame:
    """Scaled prices and pseudonymous titles, SKUs and seasons; protection lines keep title and SKU.

    The mappings are applied to ``values``, the distinct (title, sku, season_code) of the lines, which the lines join once.
    """
    product = is_product_sku(F.col("sku"))
    out = _mapped(values, products.select("orig", "new_title"), F.col("title"), "p")
    out = _mapped(_mapped(out, skus, F.col("sku"), "s"), seasons, F.col("season_code"), "c")
    new = out.select(
        *[F.col(c).alias(f"v_{c}") for c in LINE_VALUES],
        F.when(product, F.col("p_new_title")).otherwise(F.col("title")).alias("n_title"),
        F.when(product, F.col("s_new_sku")).otherwise(F.col("sku")).alias("n_sku"),
        F.col("c_alias").alias("n_season_code"),
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"v_{c}")) for c in LINE_VALUES])
    changed = lines.join(new, same, "left").withColumns(
        {
            "original_unit_price": _scaled("original_unit_price", k),
            "discounted_unit_price": _scaled("discounted_unit_price", k),
            **{c: F.col(f"n_{c}") for c in LINE_VALUES},
        }
    )
    return derive_line_columns(changed).select(*lines.columns)


def anonymize_refunds(refunds: DataFrame, k: Decimal) -> DataFrame:
    note = F.when(F.col("note").rlike("(?i)redo"), "Return via app").otherwise("Refund")
    return refunds.withColumns({"total_refunded": _scaled("total_refunded", k), "note": _if_set("note", note)})


def anonymize_landing_pages(pages: DataFrame, salt: str) -> DataFrame:
    """Cleaned paths can merge, so the days are summed again."""
    return pages.groupBy("session_date", anonymize_path(F.col("landing_page"), salt).alias("landing_page")).agg(
        F.sum("sessions").cast("bigint").alias("sessions"),
        F.sum("engaged_sessions").cast("bigint").alias("engaged_sessions"),
        F.max("updated_at").alias("updated_at"),
    )


def anonymize_ads(daily: DataFrame, maps: Mapping[str, DataFrame], k: Decimal, *grains: str) -> DataFrame:
    """Ads facts with pseudonymous ids and names at the given grains and scaled money."""
    out = daily
    for g in grains:
        out = _mapped(out, maps[g], F.col(f"{g}_id"), g)
    changes = {"spend": _scaled("spend", k, TOTAL), "purchase_value": _scaled("purchase_value", k, TOTAL)}
    for g in grains:
        changes[f"{g}_id"] = F.coalesce(f"{g}_new_id", f"{g}_id")
        changes[f"{g}_name"] = F.coalesce(f"{g}_new_name", f"{g}_name")
    return out.withColumns(changes).select(*daily.columns)


def anonymize_adset_meta(meta: DataFrame, adsets: DataFrame) -> DataFrame:
    return (
        _mapped(meta, adsets, F.col("adset_id"), "m")
        .withColumns(
            {
                "adset_id": F.coalesce("m_new_id", "adset_id"),
                "lookalike_source": _if_set("lookalike_source", F.lit("Source audience")),
                "audiences": _if_set("audiences", F.lit("Custom audience")),
                "targeting_raw": F.lit(None).cast("string"),
            }
        )
        .select(*meta.columns)
    )


def anonymize_ad_meta(meta: DataFrame, ads: DataFrame, salt: str) -> DataFrame:
    creative = F.concat(F.lit("crv_"), salted_hash(F.col("creative_id"), salt).cast("string"))
    return (
        _mapped(meta, ads, F.col("ad_id"), "m")
        .withColumns(
            {
                "ad_id": F.coalesce("m_new_id", "ad_id"),
                "creative_id": creative,
                "landing_url": anonymize_path(F.col("landing_url"), salt),
            }
        )
        .select(*meta.columns)
    )


def anonymize_reviews(reviews: DataFrame, products: DataFrame, salt: str) -> DataFrame:
    """Free text replaced according to the rating, reviewer identity by draws."""
    rid = F.col("id").cast("string")
    h = salted_hash(rid, salt)
    rating = F.coalesce("rating", F.lit(3))

    def by_rating(good: list[str], fair: list[str], poor: list[str]) -> Column:
        return F.when(rating >= 4, pick(good, h)).when(rating == 3, pick(fair, h)).otherwise(pick(poor, h))

    def drawn_id(prefix: str, col: str) -> Column:
        return salted_hash(F.concat(F.lit(prefix), F.col(col).cast("string")), salt)

    name = F.regexp_replace(fake_name(F.concat(F.lit("r"), rid), salt), r" (.)\S*$", " $1.")
    mail = F.concat(F.lit("reviewer"), F.substring(F.md5(F.concat(rid, F.lit(salt))), 1, 12), F.lit("@example.com"))
    nothing = F.lit(None).cast("string")
    return (
        _mapped(reviews, products, F.col("product_title"), "p")
        .withColumns(
            {
                "title": by_rating(GOOD_TITLES, FAIR_TITLES, POOR_TITLES),
                "body": by_rating(GOOD_TEXTS, FAIR_TEXTS, POOR_TEXTS),
                "product_external_id": (F.col("p_n") + 9000000000).cast("bigint"),
                "product_handle": F.col("p_new_handle"),
                "product_title": F.col("p_new_title"),
                "ip_address": nothing,
                "reviewer_id": drawn_id("rv", "reviewer_id"),
                "reviewer_external_id": drawn_id("rx", "reviewer_external_id"),
                "reviewer_name": _if_set("reviewer_name", name),
                "reviewer_email": _if_set("reviewer_email", mail),
                "has_pictures": F.lit(False),
                "has_videos": F.lit(False),
                "pictures": nothing,
            }
        )
        .select(*reviews.columns)
    )


def anonymize(tables: Tables, k: Decimal, salt: str, brand: str | None = None, renumber: bool = True) -> Tables:
    """All tables of an anonymised copy: one projection job per table over shared mappings.

    Without ``renumber`` the orders keep their names, which no check reads: for checks alone, not for publication.
    """
    if not Decimal("0.1") <= k <= 5:
        raise ValueError("k must be between 0.1 and 5")
    t, source = tables, mapping_source(tables)
    m = build_mappings(tables, salt, source)
    return LazyTables(
        {
            "customers": lambda: anonymize_customers(t["customers"], k, salt),
            "orders": lambda: anonymize_orders(t["orders"], m["discount"], k, renumber),
            "order_attribution": lambda: anonymize_attribution(t["order_attribution"], m["utm"], salt, brand),
            "order_discounts": lambda: anonymize_discounts(t["order_discounts"], m["discount"], k),
            "order_line_items": lambda: anonymize_lines(
                t["order_line_items"], source["order_line_items"], m["product"], m["sku"], m["season"], k
            ),
            "line_item_discount_allocations": lambda: t["line_item_discount_allocations"].withColumn(
                "allocated_amount", _scaled("allocated_amount", k)
            ),
            "refund_line_items": lambda: t["refund_line_items"].withColumn("subtotal", _scaled("subtotal", k)),
            "refunds": lambda: anonymize_refunds(t["refunds"], k),
            "landing_pages_daily": lambda: anonymize_landing_pages(t["landing_pages_daily"], salt),
            "campaign_daily": lambda: anonymize_ads(t["campaign_daily"], m, k, "campaign"),
            "adset_daily": lambda: anonymize_ads(t["adset_daily"], m, k, "campaign", "adset"),
            "ad_daily": lambda: anonymize_ads(t["ad_daily"], m, k, "campaign", "adset", "ad"),
            "adset_meta": lambda: anonymize_adset_meta(t["adset_meta"], m["adset"]),
            "ad_meta": lambda: anonymize_ad_meta(t["ad_meta"], m["ad"], salt),
            "reviews": lambda: anonymize_reviews(t["reviews"], m["product"], salt),
        },
        tables,
    )


def _foreign_mails(col: str) -> Column:
    return F.count(F.when(~F.col(col).endswith("@example.com"), 1))


def _totals() -> dict[str, dict[str, Column]]:
    """Named aggregates per table, besides those of orders, lines and refunded lines."""
    return {
        "refunds": {"refunds": F.sum("total_refunded")},
        "campaign_daily": {"ad_spend": F.sum("spend"), "ad_revenue": F.sum("purchase_value")},
        "reviews": {"reviews": F.count("*"), "reviewer_emails": _foreign_mails("reviewer_email")},
        "customers": {"customer_emails": _foreign_mails("email")},
    }


SALES_TOTALS = ["net_sales", "net_payment", "orders", "line_items"]
MAIL_CHECKS = ["customer_emails", "reviewer_emails"]
MONEY_CHECKS = ["net_sales", "net_payment", "refunds", "ad_spend", "ad_revenue"]


def _measured(t: Tables, value: str) -> DataFrame:
    rows = unpivoted(sales_totals(t, SALES_TOTALS)).unionByName(measures(t, _totals()))
    return rows.select(F.col("measure").alias("check_name"), F.col("value").cast(TOTAL).alias(value))


def anonymize_checks(before: Tables, after: Tables, k: Decimal) -> DataFrame:
    """Each check with its values before and after and whether it holds.

    Money totals must scale by ``k`` within 0.5 %, row counts must not change
    and no e-mail address may lie outside example.com. Each table is read once per side.
    """
    b, a, factor = F.col("before_value"), F.col("after_value"), F.lit(k).cast("decimal(8,4)")
    ratio = a / F.nullif(b, F.lit(0))
    money, mail = F.col("check_name").isin(MONEY_CHECKS), F.col("check_name").isin(MAIL_CHECKS)
    scaled = b.isNull() | (b == 0) | (F.abs(ratio - factor) / factor <= F.lit("0.005").cast("decimal(4,3)"))
    both = _measured(before, "before_value").join(_measured(after, "after_value"), "check_name")
    both = both.withColumn("before_value", F.when(mail, F.lit(0).cast(TOTAL)).otherwise(b))
    return both.select("check_name", "before_value", "after_value", F.when(money, scaled).otherwise(a == b).alias("ok"))
