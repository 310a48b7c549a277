"""Canonical tables derived from a TPC-H-like star schema plus event, page and document tables.

Every table is a lazy projection, so a metric query over it still prunes
columns and pushes filters down to the star's Parquet files.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.operators.ingest import resolve_discount_allocations
from shopmetrics.sources.lazy import LazyTables
from shopmetrics.sources.schema import DDL
from shopmetrics.sources.tables import derive_line_columns


@cache
def _columns(name: str) -> list[tuple[str, str]]:
    """Declared (column, type) pairs of a canonical table."""
    fields = DDL[name].replace(" not null", "").split(", ")
    return [tuple(f.split(" ", 1)) for f in fields]


def _declared(df: DataFrame, name: str, exprs: Mapping[str, str]) -> DataFrame:
    """Project ``df`` to the declared columns and types of a table; columns not given are NULL."""
    return df.selectExpr(*[f"CAST({exprs.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _columns(name)])


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def _aggs(*exprs: str) -> list[Column]:
    return [F.expr(e) for e in exprs]


def _case(key: str, cases: Mapping[str, str | None], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN " + ("NULL" if v is None else f"'{v}'") for k, v in cases.items())
    return f"CASE {key} {whens} ELSE {default} END"


# The star stores money as doubles with two decimals; whole cents are exact.
_CENTS = "CAST(l_extendedprice * 100 + 0.5D AS BIGINT)"
_PAID_CENTS = f"(({_CENTS} * (100 - CAST(round(l_discount * 100) AS INT)) + 50) div 100)"


def _per_unit(cents: str) -> str:
    """Price per unit: the line amount divided by the quantity, rounded down to whole cents."""
    return f"CAST(CAST({cents} div CAST(l_quantity AS INT) AS DECIMAL(12,0)) * 0.01BD AS DECIMAL(12,2))"


# The star has no line key. The id is a 60-bit digest of the columns that tell
# lines apart: it needs no window over an order, so an order of any size stays
# spread over tasks. Joins use it together with the order id.
_LINE_ID = (
    "CAST(conv(left(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    f"unix_date(CAST(l_shipdate AS DATE)), {_CENTS})), 15), 16, 10) AS BIGINT)"
)

_DISCOUNT_NAME = (
    "CASE o_orderstatus WHEN 'F' THEN concat('code-', o_custkey % 97) "
    "WHEN 'O' THEN concat('Auto ', o_orderkey % 7) ELSE 'Manual' END"
)
_SOURCE = _case(
    "concat(left(o_orderpriority, 1), o_orderstatus)",
    {
        "1F": "facebook", "1O": "google", "1P": "bing", "2F": "klaviyo", "2O": "attentive", "2P": "attentive",
        "3F": "google", "3O": "Yahoo", "3P": "Direct", "5F": "Instagram", "5O": "facebook", "5P": "partner",
    },
)
_CHANNEL = _case(
    "concat(left(o_orderpriority, 1), o_orderstatus)",
    {
        "1F": "Paid Social", "1O": "Paid Search", "1P": "Paid", "2F": "Email", "2O": "SMS", "2P": "Text",
        "3F": "Seo", "3O": None, "3P": "Referral", "5F": None, "5O": "Other", "5P": "Affiliate",
    },
)


class StarTables(LazyTables):
    """The canonical tables of one star directory."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__({name: getattr(self, f"_{name}") for name in DDL})
        self.spark = spark
        self.path = path
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
            self._raw[name] = df
        return self._raw[name]

    # --- orders and lines ----------------------------------------------------

    def _star_lines(self) -> DataFrame:
        """Line items with an id and exact prices."""
        if "_lines" not in self._raw:
            self._raw["_lines"] = self.raw("lineitem").selectExpr(
                "l_orderkey AS order_id",
                f"{_LINE_ID} AS line_item_id",
                "l_partkey AS part_id",
                "l_linenumber AS line_no",
                "CAST(l_quantity AS INT) AS quantity",
                f"{_per_unit(_CENTS)} AS original_unit_price",
                f"{_per_unit(_PAID_CENTS)} AS discounted_unit_price",
                "l_discount > 0 AS has_discount",
                "l_returnflag AS return_flag",
                "l_linestatus AS status",
                "l_shipdate AS shipped_at",
            )
        return self._raw["_lines"]

    def _star_parts(self) -> DataFrame:
        """One row per part, visibly so: what reads no column of the parts drops the join with them."""
        part = self.raw("part").selectExpr("p_partkey AS part_id", "p_name", "p_brand", "p_type")
        return part.groupBy("part_id").agg(*[F.any_value(c).alias(c) for c in ("p_name", "p_brand", "p_type")])

    def _order_line_items(self) -> DataFrame:
        lines = self._star_lines().join(self._star_parts(), "part_id", "left")
        returned = "IF(return_flag = 'R', quantity, 0)"
        exprs = {
            **_same("line_item_id", "order_id", "quantity", "original_unit_price", "discounted_unit_price"),
            "sku": "CASE p_brand WHEN 'Brand#1' THEN 'x-redo' WHEN 'Brand#2' THEN concat('ROUTEINS-', part_id) "
            "ELSE concat('SKU-', part_id) END",
            "title": "p_name",
            "current_quantity": f"quantity - {returned}",
            "unfulfilled_quantity": "IF(status = 'F', 0, quantity)",
            "non_fulfillable_quantity": "0",
            "line_status": "IF(status = 'F', 'FULFILLED', 'UNFULFILLED')",
            "currency": "'USD'",
            "season_code": "p_type",
            "returned_quantity": returned,
        }
        return derive_line_columns(_declared(lines, "order_line_items", exprs))

    def _refund_line_items(self) -> DataFrame:
        exprs = {
            **_same("order_id", "line_item_id", "quantity"),
            "id": "line_item_id",
            "refund_id": "line_item_id",
            "processed_at": "shipped_at",
            "subtotal": "discounted_unit_price * quantity",
            "restock_type": "'RETURN'",
        }
        return _declared(self._star_lines().filter("return_flag = 'R'"), "refund_line_items", exprs)

    def _refunds(self) -> DataFrame:
        """Refund headers: one per returned line, and one without a line for some accepted lines."""
        rows = self._star_lines().filter("return_flag = 'R' OR (return_flag = 'A' AND line_no = 1)")
        exprs = {
            "refund_id": "line_item_id",
            "order_id": "order_id",
            "processed_at": "shipped_at",
            "total_refunded": "CASE WHEN return_flag = 'A' THEN discounted_unit_price WHEN line_no = 2 THEN 0 "
            "ELSE discounted_unit_price * quantity END",
            "currency": "'USD'",
            "note": "CASE WHEN return_flag = 'A' THEN NULL WHEN line_no % 2 = 0 THEN 'Redo return' "
            "ELSE 'Damaged item' END",
        }
        return _declared(rows, "refunds", exprs)

    def _orders(self) -> DataFrame:
        returned = self._star_lines().filter("return_flag = 'R'")
        refunded = returned.selectExpr(
            "order_id AS o_orderkey", "discounted_unit_price * quantity AS subtotal"
        ).groupBy("o_orderkey").agg(*_aggs("sum(subtotal) AS refunded"))
        total, back = "CAST(o_totalprice AS DECIMAL(12,2))", "coalesce(refunded, 0)"
        exprs = {
            "order_id": "o_orderkey",
            "order_name": "concat('#', o_orderkey)",
            "created_at": "o_orderdate",
            "financial_status": "IF(refunded IS NULL, 'PAID', 'PARTIALLY_REFUNDED')",
            "fulfillment_status": "IF(o_orderstatus = 'F', 'FULFILLED', 'UNFULFILLED')",
            "total_amount": total,
            "current_total": f"{total} - {back}",
            "total_paid": total,
            "total_refunded": back,
            "net_payment": f"{total} - {back}",
            "currency": "'USD'",
            "discount_code": "IF(o_orderstatus = 'F', concat(' Code-', o_custkey % 97), NULL)",
            "customer_id": "o_custkey",
            "synced_at": "o_orderdate",
        }
        return _declared(self.raw("orders").join(refunded, "o_orderkey", "left"), "orders", exprs)

    def _order_attribution(self) -> DataFrame:
        exprs = {
            "order_id": "o_orderkey",
            "traffic_source": _SOURCE,
            "traffic_channel": _CHANNEL,
            "device_type": _case("o_orderstatus", {"F": "mobile", "O": "desktop"}, "'tablet'"),
            "user_agent": "concat('agent/', o_custkey % 5)",
            "referrer_url": f"concat('https://', lower({_SOURCE}), '.example.com/search?q=', o_orderkey)",
            "landing_page": "concat('https://shop.example.com/products/p', o_orderkey % 500, '?ref=mail#top')",
            "utm_campaign": "IF(o_custkey % 3 > 0, concat('utm-', o_custkey % 40), NULL)",
            "utm_content": "concat('content-', o_orderkey % 9)",
            "days_to_conversion": "o_orderkey % 30",
            "journey_ready": "o_orderstatus != 'P'",
            "updated_at": "o_orderdate",
        }
        attributed = self.raw("orders").filter("o_orderpriority != '4-NOT SPECIFIED'")
        return _declared(attributed, "order_attribution", exprs)

    def _order_discounts(self) -> DataFrame:
        positions = "explode(IF(o_orderpriority = '2-HIGH', array(0, 1), array(0))) AS position"
        rows = self.raw("orders").selectExpr("*", positions)
        exprs = {
            "id": "o_orderkey * 2 + position",
            "order_id": "o_orderkey",
            "position": "position",
            "kind": f"IF(position = 1, 'CODE', {_case('o_orderstatus', {'F': 'CODE', 'O': 'AUTOMATIC'}, "'MANUAL'")})",
            "code_or_title": f"IF(position = 1, concat('vip-', o_orderkey % 13), {_DISCOUNT_NAME})",
            "description": "IF(position = 0 AND o_orderstatus = 'P', concat('note ', o_orderkey), NULL)",
            "value_amount": "IF(position = 0 AND o_orderstatus != 'O', o_orderkey % 50 + 1, NULL)",
            "value_percentage": "CASE WHEN position = 1 THEN 15 WHEN o_orderstatus = 'O' THEN 10 END",
            "currency": "'USD'",
            "allocation_method": "'ACROSS'",
            "target_selection": "'ALL'",
            "target_type": "'LINE_ITEM'",
        }
        return _declared(rows, "order_discounts", exprs)

    def named_allocations(self) -> DataFrame:
        """Discount allocations as delivered: they name the discount by code or title."""
        names = self.raw("orders").selectExpr("o_orderkey AS order_id", f"{_DISCOUNT_NAME} AS code_or_title")
        return self._star_lines().filter("has_discount").join(names, "order_id").selectExpr(
            "line_item_id AS id",
            "order_id",
            "line_item_id",
            "code_or_title",
            "CAST((original_unit_price - discounted_unit_price) * quantity AS DECIMAL(12,2)) AS allocated_amount",
            "'USD' AS currency",
        )

    def _line_item_discount_allocations(self) -> DataFrame:
        return resolve_discount_allocations(
            self.named_allocations(), self["order_line_items"], self["order_discounts"]
        )

    def _customers(self) -> DataFrame:
        home = (
            self.raw("customer")
            .join(self.raw("nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left")
            .join(self.raw("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left")
        )
        exprs = {
            "customer_id": "c_custkey",
            "email": "concat(lower(replace(c_name, '#', '.')), '@mail.test')",
            "display_name": "c_name",
            "customer_since": "first_at",
            "first_purchase_at": "first_at",
            "first_order_id": "first_key.order_id",
            "last_order_at": "last_at",
            "last_order_id": "last_key.order_id",
            "number_of_orders": "coalesce(n, 0)",
            "amount_spent": "spent",
            "currency": "'USD'",
            "province": "r_name",
            "country": "n_name",
            "zip": "lpad(CAST(c_custkey % 100000 AS STRING), 5, '0')",
            "tags": "c_mktsegment",
            "updated_at": "TIMESTAMP_NTZ '2001-08-01 00:00:00'",
        }
        return _declared(home.join(self._order_stats(), "c_custkey", "left"), "customers", exprs)

    def _order_stats(self) -> DataFrame:
        """Lifetime statistics per customer; columns nobody reads are pruned from the aggregate."""
        return (
            self["orders"]
            .selectExpr("customer_id AS c_custkey", "net_payment", "created_at", "struct(created_at, order_id) AS key")
            .groupBy("c_custkey")
            .agg(
                *_aggs(
                    "count(*) AS n",
                    "sum(net_payment) AS spent",
                    "min(created_at) AS first_at",
                    "max(created_at) AS last_at",
                    "min(key) AS first_key",
                    "max(key) AS last_key",
                )
            )
        )

    # --- traffic and ads -----------------------------------------------------

    def _star_events(self) -> DataFrame:
        """Events moved back 28 years, into the range of the orders."""
        keyed = self.raw("events").selectExpr("*", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")
        return keyed.selectExpr(
            "add_months(CAST(ts AS DATE), -336) AS session_date",
            "user_id",
            "event_type",
            "CAST(value AS DECIMAL(12,2)) AS value",
            "IF(k % 2 = 0, 'meta', 'pinterest') AS platform",
            "CAST(k AS STRING) AS campaign_id",
            "concat('Campaign ', k, IF(dayofmonth(ts) <= 15, ' a', ' b')) AS campaign_name",
            "concat('as', k, '-', user_id % 3) AS adset_id",
            "concat('as', k, '-', user_id % 3, '-', user_id % 2) AS ad_id",
        )

    def _traffic(self, name: str, keys: Mapping[str, str]) -> DataFrame:
        daily = (
            self._star_events()
            .selectExpr("*", *[f"{e} AS {k}" for k, e in keys.items()])
            .groupBy("session_date", *keys)
            .agg(*_aggs("count(*) AS sessions", "count(DISTINCT user_id) AS total_users"))
        )
        exprs = {**_same("session_date", *keys, "sessions", "total_users"), "updated_at": "CAST(session_date AS TIMESTAMP_NTZ)"}
        if name == "visitors_daily":
            exprs["new_users"] = "IF(new_vs_returning = 'new', total_users, 0)"
        return _declared(daily, name, exprs)

    def _sessions_daily(self) -> DataFrame:
        names = {"view": "search", "click": "social", "purchase": "direct", "signup": "email"}
        return self._traffic("sessions_daily", {"referrer_source": _case("event_type", names, "'unknown'")})

    def _visitors_daily(self) -> DataFrame:
        names = {"signup": "new", "error": "unknown"}
        return self._traffic("visitors_daily", {"new_vs_returning": _case("event_type", names, "'returning'")})

    def _channel_daily(self) -> DataFrame:
        groups = {"view": "Organic Search", "purchase": "Paid Social", "signup": "Email"}
        sources = {"view": "google", "click": "google", "purchase": "facebook", "signup": "klaviyo"}
        clicked = "IF(user_id % 2 = 0, 'Cross-network', 'Paid Shopping')"
        return self._traffic(
            "channel_daily",
            {
                "channel_group": f"IF(event_type = 'click', {clicked}, {_case('event_type', groups, "'Direct'")})",
                "source": _case("event_type", sources, "'direct'"),
                "medium": "IF(user_id % 2 = 0, 'cpc', 'organic')",
            },
        )

    def _device_daily(self) -> DataFrame:
        names = {"view": "mobile", "click": "desktop"}
        return self._traffic("device_daily", {"device_category": _case("event_type", names, "'tablet'")})

    def _region_daily(self) -> DataFrame:
        return self._traffic(
            "region_daily",
            {
                "country": "IF(user_id % 3 = 0, 'Canada', 'United States')",
                "region": "concat('State ', user_id % 50)",
            },
        )

    def _landing_pages_daily(self) -> DataFrame:
        pages = (
            self.raw("pages")
            .selectExpr(
                "date_add(DATE '1996-01-01', CAST(page_id % 30 AS INT)) AS session_date",
                "replace(replace(url, '/en/', '/products/'), '/fr/', '/collections/') AS landing_page",
                "page_id",
            )
            .groupBy("session_date", "landing_page")
            .agg(*_aggs("sum(page_id % 7 + 1) AS sessions", "sum(page_id % 3) AS engaged_sessions"))
        )
        exprs = {
            **_same("session_date", "landing_page", "sessions", "engaged_sessions"),
            "updated_at": "CAST(session_date AS TIMESTAMP_NTZ)",
        }
        return _declared(pages, "landing_pages_daily", exprs)

    def _ads(self, name: str, *extra: str) -> DataFrame:
        daily = (
            self._star_events()
            .groupBy("session_date", "platform", "campaign_id", "campaign_name", *extra)
            .agg(
                *_aggs(
                    "coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) AS spend",
                    "count_if(event_type = 'view') AS impressions",
                    "count_if(event_type = 'click') AS clicks",
                    "count_if(event_type = 'purchase') AS purchases",
                    "coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0) AS purchase_value",
                )
            )
        )
        exprs = {
            **_same("platform", "campaign_id", "campaign_name", *extra),
            **_same("spend", "impressions", "clicks", "purchases", "purchase_value"),
            "date": "session_date",
            "adset_name": "concat('Set ', adset_id)",
            "ad_name": "concat('Ad ', ad_id)",
            "status": "'ACTIVE'",
            "currency": "'USD'",
            "updated_at": "CAST(session_date AS TIMESTAMP_NTZ)",
        }
        return _declared(daily, name, exprs)

    def _campaign_daily(self) -> DataFrame:
        return self._ads("campaign_daily")

    def _adset_daily(self) -> DataFrame:
        return self._ads("adset_daily", "adset_id")

    def _ad_daily(self) -> DataFrame:
        return self._ads("ad_daily", "adset_id", "ad_id")

    def _adset_meta(self) -> DataFrame:
        sets = self._star_events().select("platform", "adset_id").distinct()
        kind = "substring_index(adset_id, '-', -1)"
        exprs = {
            **_same("platform", "adset_id"),
            "status": "'ACTIVE'",
            "targeting_type": _case(kind, {"0": "lookalike", "1": "interest"}, "'broad'"),
            "lookalike_source": f"IF({kind} = '0', concat('Buyers of ', adset_id), NULL)",
            "audiences": f"IF({kind} != '2', concat('Audience ', adset_id), NULL)",
            "geo": "'US'",
            "targeting_raw": "to_json(named_struct('set', adset_id))",
            "updated_at": "TIMESTAMP_NTZ '2001-08-01 00:00:00'",
        }
        return _declared(sets, "adset_meta", exprs)

    def _ad_meta(self) -> DataFrame:
        ads = self._star_events().select("platform", "ad_id").distinct()
        odd = "substring_index(ad_id, '-', -1) = '1'"
        exprs = {
            **_same("platform", "ad_id"),
            "status": "'ACTIVE'",
            "creative_id": "concat('c-', ad_id)",
            "creative_format": f"IF({odd}, 'video', 'image')",
            "landing_url": f"IF({odd}, concat('https://shop.example.com/collections/', ad_id, '?x=1'), NULL)",
            "is_dynamic": f"NOT ({odd})",
            "updated_at": "TIMESTAMP_NTZ '2001-08-01 00:00:00'",
        }
        return _declared(ads, "ad_meta", exprs)

    # --- reviews and notes ---------------------------------------------------

    def _reviews(self) -> DataFrame:
        part = self.raw("part").selectExpr("p_partkey AS doc_id", "p_partkey", "p_name")
        rows = self.raw("documents").join(self.raw("labels"), "doc_id", "left").join(part, "doc_id", "left")
        made = "CAST(date_add(DATE '1999-01-01', CAST(doc_id % 900 AS INT)) AS TIMESTAMP_NTZ)"
        exprs = {
            "id": "doc_id",
            "rating": "CASE WHEN quality = 1 THEN 5 WHEN toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 2 + doc_id % 2 END",
            "title": "concat(lang, ' ', source)",
            "body": "text",
            "created_at": made,
            "updated_at": made,
            "verified": "'verified-purchase'",
            "published": "true",
            "curated": "'ok'",
            "hidden": "false",
            "featured": "false",
            "source": "source",
            "product_external_id": "p_partkey",
            "product_handle": "replace(p_name, ' ', '-')",
            "product_title": "p_name",
            "ip_address": "concat('10.0.0.', doc_id % 256)",
            "reviewer_id": "doc_id * 7",
            "reviewer_external_id": "IF(doc_id % 4 > 0, doc_id * 11, NULL)",
            "reviewer_name": "concat('Reviewer ', doc_id)",
            "reviewer_email": "concat('reviewer', doc_id, '@mail.test')",
            "has_pictures": "doc_id % 10 = 0",
            "has_videos": "false",
            "pictures": """IF(doc_id % 10 = 0, '["p.jpg"]', NULL)""",
            "synced_at": made,
        }
        return _declared(rows, "reviews", exprs)

    def _annotations(self) -> DataFrame:
        """Notes taken from the events of all types."""
        exprs = {
            "id": "event_id",
            "date": "add_months(CAST(ts AS DATE), -336)",
            "title": "concat(event_type, ' by user ', user_id)",
            "description": "IF(value > 100, props, NULL)",
            "category": _case(
                "event_type", {"error": "incident", "signup": "campaign", "view": "product", "click": "other"}, "'promotion'"
            ),
            "created_at": "ts",
            "created_by": "concat('user ', user_id)",
            "updated_at": "ts",
        }
        return _declared(self.raw("events"), "annotations", exprs)

    def annotation_requests(self) -> DataFrame:
        """Unvalidated notes: some miss a date or a title, are too long or name an unknown category."""
        return self.raw("events").selectExpr(
            "IF(event_id % 11 > 0, add_months(CAST(ts AS DATE), -336), NULL) AS date",
            "CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN repeat(event_type, 40) "
            "ELSE concat(event_type, ' ', event_id) END AS title",
            "IF(event_id % 19 = 0, repeat(props, 30), NULL) AS description",
            _case("event_type", {"error": "incident", "signup": "campaign", "click": "party"}) + " AS category",
            "concat('user ', user_id) AS created_by",
        )
