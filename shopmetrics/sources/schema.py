"""Declared schemas and keys of the canonical tables.

DDL strings, one per table. Instants are TIMESTAMP_NTZ in UTC; unit prices are
decimal(12,2) and accumulated amounts decimal(22,2), so that a hot order or
customer cannot overflow its total; daily counts are bigint for the same reason.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_MEASURES = (
    "spend decimal(22,2) not null, impressions bigint not null, clicks bigint not null, "
    "purchases bigint not null, purchase_value decimal(22,2) not null, currency string not null, "
    "updated_at timestamp_ntz not null"
)

DDL: dict[str, str] = {
    "customers": (
        "customer_id bigint not null, email string, display_name string, customer_since timestamp_ntz, "
        "first_purchase_at timestamp_ntz, first_order_id bigint, last_order_at timestamp_ntz, "
        "last_order_id bigint, last_visit_at timestamp_ntz, last_visit_source string, "
        "number_of_orders int not null, amount_spent decimal(22,2), currency string, city string, "
        "province string, province_code string, country string, country_code string, zip string, "
        "tags string, updated_at timestamp_ntz not null"
    ),
    "orders": (
        "order_id bigint not null, order_name string not null, created_at timestamp_ntz not null, "
        "financial_status string, fulfillment_status string, cancelled_at timestamp_ntz, "
        "cancel_reason string, total_amount decimal(22,2), current_total decimal(22,2), "
        "total_paid decimal(22,2), total_refunded decimal(22,2), net_payment decimal(22,2), "
        "currency string, discount_code string, customer_id bigint, synced_at timestamp_ntz not null"
    ),
    "order_attribution": (
        "order_id bigint not null, traffic_source string, traffic_channel string, source_type string, "
        "device_type string, device_model string, user_agent string, referrer_url string, "
        "landing_page string, utm_source string, utm_medium string, utm_campaign string, "
        "utm_content string, utm_term string, days_to_conversion int, journey_ready boolean not null, "
        "updated_at timestamp_ntz not null"
    ),
    "order_discounts": (
        "id bigint not null, order_id bigint not null, position smallint not null, kind string not null, "
        "code_or_title string, description string, value_amount decimal(12,2), "
        "value_percentage decimal(6,2), currency string, allocation_method string, "
        "target_selection string, target_type string"
    ),
    "order_line_items": (
        "line_item_id bigint not null, order_id bigint not null, sku string, title string, "
        "quantity int not null, current_quantity int, unfulfilled_quantity int, "
        "non_fulfillable_quantity int, line_status string, original_unit_price decimal(12,2), "
        "discounted_unit_price decimal(12,2), currency string, season_code string, "
        "returned_quantity int not null"
    ),
    "refund_line_items": (
        "id bigint not null, refund_id bigint not null, order_id bigint not null, "
        "line_item_id bigint not null, processed_at timestamp_ntz not null, quantity int not null, "
        "subtotal decimal(12,2) not null, restock_type string"
    ),
    "refunds": (
        "refund_id bigint not null, order_id bigint not null, processed_at timestamp_ntz not null, "
        "total_refunded decimal(12,2) not null, currency string, note string"
    ),
    "line_item_discount_allocations": (
        "id bigint not null, line_item_id bigint not null, order_discount_id bigint not null, "
        "allocated_amount decimal(12,2) not null, currency string"
    ),
    "sessions_daily": (
        "session_date date not null, referrer_source string not null, sessions bigint not null, "
        "updated_at timestamp_ntz not null"
    ),
    "visitors_daily": (
        "session_date date not null, new_vs_returning string not null, sessions bigint not null, "
        "total_users bigint not null, new_users bigint not null, updated_at timestamp_ntz not null"
    ),
    "channel_daily": (
        "session_date date not null, channel_group string not null, source string not null, "
        "medium string not null, sessions bigint not null, total_users bigint not null, "
        "updated_at timestamp_ntz not null"
    ),
    "device_daily": (
        "session_date date not null, device_category string not null, sessions bigint not null, "
        "total_users bigint not null, updated_at timestamp_ntz not null"
    ),
    "region_daily": (
        "session_date date not null, country string not null, region string not null, "
        "sessions bigint not null, total_users bigint not null, updated_at timestamp_ntz not null"
    ),
    "landing_pages_daily": (
        "session_date date not null, landing_page string not null, sessions bigint not null, "
        "engaged_sessions bigint not null, updated_at timestamp_ntz not null"
    ),
    "reviews": (
        "id bigint not null, rating smallint, title string, body string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz, verified string, published boolean, curated string, hidden boolean, "
        "featured boolean, source string, product_external_id bigint, product_handle string, "
        "product_title string, ip_address string, reviewer_id bigint, reviewer_external_id bigint, "
        "reviewer_name string, reviewer_email string, has_pictures boolean, has_videos boolean, "
        "pictures string, synced_at timestamp_ntz"
    ),
    "campaign_daily": (
        "date date not null, platform string not null, campaign_id string not null, "
        "campaign_name string not null, status string, " + _MEASURES
    ),
    "adset_daily": (
        "date date not null, platform string not null, adset_id string not null, "
        "adset_name string not null, campaign_id string not null, campaign_name string not null, " + _MEASURES
    ),
    "ad_daily": (
        "date date not null, platform string not null, ad_id string not null, ad_name string not null, "
        "adset_id string not null, adset_name string not null, campaign_id string not null, "
        "campaign_name string not null, " + _MEASURES
    ),
    "adset_meta": (
        "platform string not null, adset_id string not null, status string, targeting_type string, "
        "lookalike_source string, audiences string, geo string, targeting_raw string, "
        "updated_at timestamp_ntz not null"
    ),
    "ad_meta": (
        "platform string not null, ad_id string not null, status string, creative_id string, "
        "creative_format string, landing_url string, is_dynamic boolean not null, "
        "updated_at timestamp_ntz not null"
    ),
    "annotations": (
        "id bigint not null, date date not null, title string not null, description string, "
        "category string not null, created_at timestamp_ntz not null, created_by string, "
        "updated_at timestamp_ntz not null"
    ),
}

# Columns computed on load, never stored or copied.
GENERATED: dict[str, list[str]] = {"order_line_items": ["is_returned", "net_sales"]}

# Primary and unique keys.
KEYS: dict[str, list[list[str]]] = {
    "customers": [["customer_id"]],
    "orders": [["order_id"]],
    "order_attribution": [["order_id"]],
    "order_discounts": [["id"], ["order_id", "position"]],
    "order_line_items": [["line_item_id"]],
    "refund_line_items": [["id"]],
    "refunds": [["refund_id"]],
    "line_item_discount_allocations": [["id"]],
    "sessions_daily": [["session_date", "referrer_source"]],
    "visitors_daily": [["session_date", "new_vs_returning"]],
    "channel_daily": [["session_date", "channel_group", "source", "medium"]],
    "device_daily": [["session_date", "device_category"]],
    "region_daily": [["session_date", "country", "region"]],
    "landing_pages_daily": [["session_date", "landing_page"]],
    "reviews": [["id"]],
    "campaign_daily": [["date", "platform", "campaign_id"]],
    "adset_daily": [["date", "platform", "adset_id"]],
    "ad_daily": [["date", "platform", "ad_id"]],
    "adset_meta": [["platform", "adset_id"]],
    "ad_meta": [["platform", "ad_id"]],
    "annotations": [["id"]],
}

# (child table, parent table, child columns, parent columns)
REFERENCES: list[tuple[str, str, list[str], list[str]]] = [
    ("orders", "customers", ["customer_id"], ["customer_id"]),
    ("order_attribution", "orders", ["order_id"], ["order_id"]),
    ("order_discounts", "orders", ["order_id"], ["order_id"]),
    ("order_line_items", "orders", ["order_id"], ["order_id"]),
    ("refund_line_items", "orders", ["order_id"], ["order_id"]),
    ("refund_line_items", "order_line_items", ["order_id", "line_item_id"], ["order_id", "line_item_id"]),
    ("refunds", "orders", ["order_id"], ["order_id"]),
    ("line_item_discount_allocations", "order_line_items", ["line_item_id"], ["line_item_id"]),
    ("line_item_discount_allocations", "order_discounts", ["order_discount_id"], ["id"]),
]


def table_schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
