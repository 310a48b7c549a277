"""Independent SQL (DuckDB) for the registered queries, over the same star tables.

Each statement is the shared table definitions it needs followed by a body.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

from shopmetrics.functions.dates import month_window, previous_period, previous_year
from shopmetrics.functions.draws import FIRST_NAMES, LAST_NAMES
from shopmetrics.operators import privacy as words
from shopmetrics.plans import params as p
from shopmetrics.sources.schema import KEYS, REFERENCES

NY = "America/New_York"

ORACLES: dict[str, str] = {}

# --- SQL fragments -----------------------------------------------------------


def day(ts: str) -> str:
    """Local business date of a UTC timestamp."""
    return f"CAST(({ts}) AT TIME ZONE 'UTC' AT TIME ZONE '{NY}' AS DATE)"


def month(ts: str) -> str:
    return f"CAST(date_trunc('month', {day(ts)}) AS DATE)"


def between(d: str, span: tuple[date, date]) -> str:
    return f"({d} BETWEEN DATE '{span[0]}' AND DATE '{span[1]}')"


def money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(22,2))"


def unit(x: str) -> str:
    return f"CAST({x} AS DECIMAL(12,2))"


def pct(x: str) -> str:
    return f"CAST({x} AS DECIMAL(20,2))"


def _whole(num: str, den: str, digits: int, times: int) -> tuple[str, str]:
    """Numerator and denominator of a ratio as whole numbers, so rounding can be exact."""
    n = f"(CAST(({num}) * 100 AS HUGEINT) * {times * 10**digits})"
    return n, f"nullif(CAST(({den}) * 100 AS HUGEINT), 0)"


def up(num: str, den: str, digits: int = 2, times: int = 100) -> str:
    """Exact ratio rounded half away from zero, NULL on a zero denominator."""
    n, d = _whole(num, den, digits, times)
    q = f"sign({n}) * sign({d}) * ((2 * abs({n}) + abs({d})) // (2 * abs({d})))"
    return pct(f"CAST({q} AS DECIMAL(28,0)) * {10**-digits:.{digits}f}" if digits else q)


def even(num: str, den: str, digits: int = 2, times: int = 100) -> str:
    """Exact ratio rounded half-even, NULL on a zero denominator."""
    n, d = _whole(num, den, digits, times)
    q = f"((2 * abs({n}) + abs({d})) // (2 * abs({d})))"
    tie = f"(2 * abs({n}) + abs({d})) % (2 * abs({d})) = 0"
    q = f"sign({n}) * sign({d}) * ({q} - CASE WHEN {tie} THEN {q} % 2 ELSE 0 END)"
    return pct(f"CAST({q} AS DECIMAL(28,0)) * {10**-digits:.{digits}f}" if digits else q)


def growth(cur: str, prev: str) -> str:
    return f"CASE WHEN {prev} <> 0 THEN {even(f'({cur}) - ({prev})', prev)} END"


def growth_pos(cur: str, prev: str) -> str:
    return f"CASE WHEN {prev} > 0 THEN {even(f'({cur}) - ({prev})', prev)} END"


def h(x: str, salt: str) -> str:
    return f"(('0x' || substr(md5({x} || '{salt}'), 1, 8))::BIGINT & 2147483647)"


def u(x: str, salt: str) -> str:
    return f"CAST(({h(x, salt)} % 10000) * 0.0001 AS DECIMAL(5,4))"


def words_at(items: list[str], index: str) -> str:
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in items)
    return f"([{quoted}])[CAST(({index}) % {len(items)} AS INTEGER) + 1]"


def name_of(x: str, salt: str) -> str:
    return f"{words_at(FIRST_NAMES, h(x, salt))} || ' ' || {words_at(LAST_NAMES, h(x, salt) + ' // 97')}"


def path_of(url: str, salt: str) -> str:
    bare = f"regexp_replace(regexp_replace({url}, '^https?://[^/]+', ''), '[?#].*$', '', 's')"
    return (
        f"CASE WHEN {url} IS NULL THEN NULL "
        f"WHEN {bare} LIKE '/products/%' THEN '/products/item-' || printf('%05d', {h(bare, salt)} % 100000) "
        f"WHEN {bare} LIKE '/collections/%' THEN '/collections/collection-' || printf('%03d', {h(bare, salt)} % 1000) "
        f"WHEN {bare} = '' THEN '/' ELSE {bare} END"
    )


PRODUCT = "(coalesce(sku, '') <> 'x-redo' AND coalesce(sku, '') NOT LIKE 'ROUTEINS%')"


def channel_of(missing: str) -> str:
    return f"""CASE
        WHEN traffic_channel = 'Paid Social' THEN 'Paid Social'
        WHEN traffic_channel IN ('Paid Search', 'Paid Other', 'Paid') THEN 'Paid Search'
        WHEN traffic_channel = 'Email' THEN 'Email'
        WHEN traffic_channel IN ('SMS', 'Text') THEN 'SMS'
        WHEN traffic_channel = 'Seo' OR lower(traffic_source) IN ('google', 'bing', 'yahoo', 'duckduckgo')
            THEN 'Organic Search'
        WHEN lower(traffic_source) = 'direct' THEN 'Direct'
        WHEN lower(traffic_source) IN ('facebook', 'instagram') THEN 'Organic Social'
        {missing} ELSE 'Unassigned' END"""


# --- table definitions -------------------------------------------------------

_EXT = "CAST(l_extendedprice AS DECIMAL(12,2))"
_PAID = f"round({_EXT} * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)"
_KIND = "event_type"

TABLES: dict[str, str] = {
    "base_lines": f"""
        SELECT l_orderkey AS order_id,
            ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                CAST(l_shipdate AS DATE) - DATE '1970-01-01', CAST({_EXT} * 100 AS BIGINT))), 1, 15))::BIGINT AS line_item_id,
            l_partkey AS part_id, l_linenumber AS line_no, CAST(l_quantity AS INTEGER) AS quantity,
            {unit(f"(CAST({_EXT} * 100 AS BIGINT) // CAST(l_quantity AS INTEGER)) * 0.01")} AS original_unit_price,
            {unit(f"(CAST({_PAID} * 100 AS BIGINT) // CAST(l_quantity AS INTEGER)) * 0.01")} AS discounted_unit_price,
            l_discount, l_returnflag, l_linestatus, l_shipdate
        FROM lineitem""",
    "m_lines": """
        SELECT b.order_id, b.line_item_id,
            CASE p_brand WHEN 'Brand#1' THEN 'x-redo' WHEN 'Brand#2' THEN 'ROUTEINS-' || part_id
                ELSE 'SKU-' || part_id END AS sku,
            p_name AS title, b.quantity,
            CASE WHEN l_returnflag = 'R' THEN 0 ELSE b.quantity END AS current_quantity,
            CASE WHEN l_linestatus = 'F' THEN 0 ELSE b.quantity END AS unfulfilled_quantity,
            0 AS non_fulfillable_quantity,
            CASE WHEN l_linestatus = 'F' THEN 'FULFILLED' ELSE 'UNFULFILLED' END AS line_status,
            b.original_unit_price, b.discounted_unit_price, p_type AS season_code,
            CASE WHEN l_returnflag = 'R' THEN b.quantity ELSE 0 END AS returned_quantity
        FROM base_lines b LEFT JOIN part ON p_partkey = b.part_id""",
    "m_refund_lines": f"""
        SELECT line_item_id AS id, line_item_id AS refund_id, order_id, line_item_id,
            l_shipdate AS processed_at, quantity, {unit("discounted_unit_price * quantity")} AS subtotal,
            'RETURN' AS restock_type
        FROM base_lines WHERE l_returnflag = 'R'""",
    "m_refunds": f"""
        SELECT line_item_id AS refund_id, order_id, l_shipdate AS processed_at,
            {unit("CASE WHEN l_returnflag = 'A' THEN discounted_unit_price WHEN line_no = 2 THEN 0 ELSE discounted_unit_price * quantity END")}
                AS total_refunded,
            CASE WHEN l_returnflag = 'A' THEN NULL WHEN line_no % 2 = 0 THEN 'Redo return'
                ELSE 'Damaged item' END AS note
        FROM base_lines WHERE l_returnflag = 'R' OR (l_returnflag = 'A' AND line_no = 1)""",
    "m_orders": f"""
        SELECT o_orderkey AS order_id, '#' || o_orderkey AS order_name, o_orderdate AS created_at,
            {money("o_totalprice")} AS total_amount, {money("coalesce(back, 0)")} AS total_refunded,
            {money("o_totalprice")} AS total_paid,
            {money(money("o_totalprice") + " - coalesce(back, 0)")} AS current_total,
            {money(money("o_totalprice") + " - coalesce(back, 0)")} AS net_payment,
            CASE WHEN o_orderstatus = 'F' THEN ' Code-' || (o_custkey % 97) END AS discount_code,
            o_custkey AS customer_id
        FROM orders LEFT JOIN (SELECT order_id, sum(subtotal) AS back FROM m_refund_lines GROUP BY 1) r
            ON r.order_id = o_orderkey""",
    "m_attribution": """
        SELECT o_orderkey AS order_id,
            CASE left(o_orderpriority, 1) || o_orderstatus
                WHEN '1F' THEN 'facebook' WHEN '1O' THEN 'google' WHEN '1P' THEN 'bing'
                WHEN '2F' THEN 'klaviyo' WHEN '2O' THEN 'attentive' WHEN '2P' THEN 'attentive'
                WHEN '3F' THEN 'google' WHEN '3O' THEN 'Yahoo' WHEN '3P' THEN 'Direct'
                WHEN '5F' THEN 'Instagram' WHEN '5O' THEN 'facebook' WHEN '5P' THEN 'partner' END AS traffic_source,
            CASE left(o_orderpriority, 1) || o_orderstatus
                WHEN '1F' THEN 'Paid Social' WHEN '1O' THEN 'Paid Search' WHEN '1P' THEN 'Paid'
                WHEN '2F' THEN 'Email' WHEN '2O' THEN 'SMS' WHEN '2P' THEN 'Text'
                WHEN '3F' THEN 'Seo' WHEN '3P' THEN 'Referral'
                WHEN '5O' THEN 'Other' WHEN '5P' THEN 'Affiliate' END AS traffic_channel,
            CASE o_orderstatus WHEN 'F' THEN 'mobile' WHEN 'O' THEN 'desktop' ELSE 'tablet' END AS device_type,
            o_orderkey % 500 AS page_no,
            CASE WHEN o_custkey % 3 > 0 THEN 'utm-' || (o_custkey % 40) END AS utm_campaign,
            o_orderstatus <> 'P' AS journey_ready, o_orderdate AS updated_at
        FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
    "discount_names": """
        SELECT o_orderkey AS order_id, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS created_at,
            CASE o_orderstatus WHEN 'F' THEN 'code-' || (o_custkey % 97) WHEN 'O' THEN 'Auto ' || (o_orderkey % 7)
                ELSE 'Manual' END AS discount_name
        FROM orders""",
    "m_discounts": """
        SELECT order_id * 2 AS id, order_id, 0 AS position, discount_name AS code_or_title,
            CASE status WHEN 'F' THEN 'CODE' WHEN 'O' THEN 'AUTOMATIC' ELSE 'MANUAL' END AS kind,
            CASE WHEN status = 'P' THEN 'note ' || order_id END AS description,
            CAST(CASE WHEN status <> 'O' THEN order_id % 50 + 1 END AS DECIMAL(12,2)) AS value_amount,
            CAST(CASE WHEN status = 'O' THEN 10 END AS DECIMAL(6,2)) AS value_percentage
        FROM discount_names
        UNION ALL
        SELECT order_id * 2 + 1, order_id, 1, 'vip-' || (order_id % 13), 'CODE', NULL, NULL, CAST(15 AS DECIMAL(6,2))
        FROM discount_names WHERE priority = '2-HIGH'""",
    "m_allocations": f"""
        SELECT b.line_item_id AS id, b.line_item_id, d.id AS order_discount_id,
            {unit("(original_unit_price - discounted_unit_price) * quantity")} AS allocated_amount, 'USD' AS currency
        FROM base_lines b JOIN discount_names n USING (order_id)
            JOIN m_discounts d ON d.order_id = b.order_id AND d.code_or_title = n.discount_name
        WHERE l_discount > 0""",
    "m_customers": f"""
        SELECT c_custkey AS customer_id, lower(replace(c_name, '#', '.')) || '@mail.test' AS email,
            c_name AS display_name, first_at AS customer_since, first_at AS first_purchase_at, last_at AS last_order_at,
            (SELECT min(o2.order_id) FROM m_orders o2 WHERE o2.customer_id = c_custkey AND o2.created_at = first_at)
                AS first_order_id,
            (SELECT max(o2.order_id) FROM m_orders o2 WHERE o2.customer_id = c_custkey AND o2.created_at = last_at)
                AS last_order_id,
            CAST(coalesce(n, 0) AS INTEGER) AS number_of_orders, {money("spent")} AS amount_spent,
            r_name AS province, n_name AS country, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip
        FROM customer
            LEFT JOIN (SELECT customer_id, count(*) AS n, sum(net_payment) AS spent, min(created_at) AS first_at,
                max(created_at) AS last_at FROM m_orders GROUP BY 1) s ON s.customer_id = c_custkey
            LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
    "m_ledger": f"""
        SELECT 'SALE' AS row_type, {day("created_at")} AS date_key, order_id, order_name, line_item_id, sku, title,
            season_code, line_status, quantity, CAST(discounted_unit_price * quantity AS DECIMAL(18,2)) AS amount,
            CAST(NULL AS VARCHAR) AS restock_type
        FROM m_lines JOIN m_orders USING (order_id) WHERE {PRODUCT}
        UNION ALL
        SELECT 'RETURN', {day("r.processed_at")}, o.order_id, o.order_name, l.line_item_id, l.sku, l.title,
            l.season_code, l.line_status, -r.quantity, CAST(-r.subtotal AS DECIMAL(18,2)), r.restock_type
        FROM m_refund_lines r
            JOIN m_lines l ON l.order_id = r.order_id AND l.line_item_id = r.line_item_id
            JOIN m_orders o ON o.order_id = r.order_id
        WHERE {PRODUCT.replace("sku", "l.sku")}""",
    "ev": """
        SELECT CAST(CAST(ts AS DATE) - INTERVAL 28 YEAR AS DATE) AS d, day(ts) AS dom, user_id, event_type, event_id, ts,
            CAST(value AS DECIMAL(12,2)) AS val, value, props,
            CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k
        FROM events""",
    "m_sessions": f"""
        SELECT d AS session_date, CASE {_KIND} WHEN 'view' THEN 'search' WHEN 'click' THEN 'social'
            WHEN 'purchase' THEN 'direct' WHEN 'signup' THEN 'email' ELSE 'unknown' END AS referrer_source,
            count(*) AS sessions, CAST(d AS TIMESTAMP) AS updated_at
        FROM ev GROUP BY ALL""",
    "m_visitors": f"""
        SELECT d AS session_date, CASE {_KIND} WHEN 'signup' THEN 'new' WHEN 'error' THEN 'unknown'
            ELSE 'returning' END AS new_vs_returning, count(*) AS sessions, count(DISTINCT user_id) AS total_users
        FROM ev GROUP BY ALL""",
    "m_channels": f"""
        SELECT d AS session_date, CASE {_KIND}
            WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'Cross-network' ELSE 'Paid Shopping' END
            WHEN 'view' THEN 'Organic Search' WHEN 'purchase' THEN 'Paid Social' WHEN 'signup' THEN 'Email'
            ELSE 'Direct' END AS channel_group,
            CASE {_KIND} WHEN 'view' THEN 'google' WHEN 'click' THEN 'google' WHEN 'purchase' THEN 'facebook'
                WHEN 'signup' THEN 'klaviyo' ELSE 'direct' END AS source,
            CASE WHEN user_id % 2 = 0 THEN 'cpc' ELSE 'organic' END AS medium,
            count(*) AS sessions, count(DISTINCT user_id) AS total_users
        FROM ev GROUP BY ALL""",
    "m_regions": """
        SELECT d AS session_date, CASE WHEN user_id % 3 = 0 THEN 'Canada' ELSE 'United States' END AS country,
            'State ' || (user_id % 50) AS region, count(*) AS sessions, count(DISTINCT user_id) AS total_users
        FROM ev GROUP BY ALL""",
    "m_pages": """
        SELECT DATE '1996-01-01' + CAST(page_id % 30 AS INTEGER) AS session_date,
            replace(replace(url, '/en/', '/products/'), '/fr/', '/collections/') AS landing_page,
            sum(page_id % 7 + 1) AS sessions, sum(page_id % 3) AS engaged_sessions
        FROM pages GROUP BY ALL""",
    "m_ads": f"""
        SELECT d AS date, CASE WHEN k % 2 = 0 THEN 'meta' ELSE 'pinterest' END AS platform,
            CAST(k AS VARCHAR) AS campaign_id, 'Campaign ' || k || CASE WHEN dom <= 15 THEN ' a' ELSE ' b' END
                AS campaign_name,
            'as' || k || '-' || (user_id % 3) AS adset_id,
            'as' || k || '-' || (user_id % 3) || '-' || (user_id % 2) AS ad_id,
            coalesce(sum(val) FILTER ({_KIND} = 'click'), 0) AS spend, count(*) FILTER ({_KIND} = 'view') AS impressions,
            count(*) FILTER ({_KIND} = 'click') AS clicks, count(*) FILTER ({_KIND} = 'purchase') AS purchases,
            coalesce(sum(val) FILTER ({_KIND} = 'purchase'), 0) AS purchase_value
        FROM ev GROUP BY ALL""",
    "m_reviews": """
        SELECT doc_id AS id, CASE WHEN quality = 1 THEN 5 WHEN toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 2 + doc_id % 2 END AS rating,
            lang || ' ' || source AS title, text AS body, source, p_name AS product_title,
            replace(p_name, ' ', '-') AS product_handle, 'Reviewer ' || doc_id AS reviewer_name,
            'reviewer' || doc_id || '@mail.test' AS reviewer_email, '10.0.0.' || (doc_id % 256) AS ip_address
        FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN part ON p_partkey = doc_id""",
    "m_notes": """
        SELECT event_id AS id, d AS date, event_type || ' by user ' || user_id AS title,
            CASE WHEN value > 100 THEN props END AS description,
            CASE event_type WHEN 'error' THEN 'incident' WHEN 'signup' THEN 'campaign' WHEN 'view' THEN 'product'
                WHEN 'click' THEN 'other' ELSE 'promotion' END AS category,
            ts AS created_at, 'user ' || user_id AS created_by, ts AS updated_at
        FROM ev""",
    "note_requests": """
        SELECT CASE WHEN event_id % 11 > 0 THEN d END AS date,
            CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN repeat(event_type, 40)
                ELSE event_type || ' ' || event_id END AS title,
            CASE WHEN event_id % 19 = 0 THEN repeat(props, 30) END AS description,
            coalesce(CASE event_type WHEN 'error' THEN 'incident' WHEN 'signup' THEN 'campaign'
                WHEN 'click' THEN 'party' END, 'other') AS category,
            'user ' || user_id AS created_by
        FROM ev""",
    "checked_notes": """
        SELECT *, CASE WHEN date IS NULL THEN 'date is required' WHEN title = '' THEN 'title is required'
            WHEN length(title) > 200 THEN 'title is too long' WHEN length(description) > 200 THEN 'description is too long'
            WHEN category = 'party' THEN 'category is unknown' END AS reason
        FROM note_requests""",
    "rfm": f"""
        SELECT *, CASE
            WHEN r_score = 5 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
            WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 3 THEN 'Loyal'
            WHEN r_score <= 2 AND f_score = 5 THEN 'Cant Lose Them'
            WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 3 THEN 'At Risk'
            WHEN r_score = 5 AND f_score = 1 THEN 'New Customers'
            WHEN r_score >= 4 AND f_score IN (2, 3) AND m_score >= 3 THEN 'Potential Loyalists'
            WHEN r_score >= 4 AND f_score = 1 AND m_score >= 3 THEN 'Promising'
            WHEN r_score = 3 THEN 'About to Sleep' WHEN r_score = 2 THEN 'Hibernating' WHEN r_score = 1 THEN 'Lost'
            ELSE 'Others' END AS segment
        FROM (SELECT *,
                CASE WHEN recency_days <= 90 THEN 5 WHEN recency_days <= 180 THEN 4 WHEN recency_days <= 365 THEN 3
                    WHEN recency_days <= 730 THEN 2 ELSE 1 END AS r_score,
                CASE WHEN frequency >= 11 THEN 5 WHEN frequency >= 4 THEN 4 WHEN frequency = 3 THEN 3
                    WHEN frequency = 2 THEN 2 ELSE 1 END AS f_score,
                CAST(ntile(5) OVER (ORDER BY monetary ASC NULLS LAST, customer_id) AS INTEGER) AS m_score
            FROM (SELECT customer_id, number_of_orders AS frequency, amount_spent AS monetary,
                    CAST(DATE '{p.AS_OF}' - {day("last_order_at")} AS INTEGER) AS recency_days
                FROM m_customers WHERE number_of_orders > 0 AND last_order_at IS NOT NULL))""",
    "active": f"SELECT DISTINCT customer_id FROM m_orders WHERE {between(day('created_at'), p.ACTIVE)}",
    "segments": f"""
        SELECT segment, count(*) AS customer_count, {up("sum(monetary)", "count(monetary)", 2, 1)} AS avg_lifetime_value,
            {money("sum(monetary)")} AS total_lifetime_value, {up("sum(frequency)", "count(*)", 1, 1)} AS avg_orders,
            CAST({up("sum(recency_days)", "count(*)", 0, 1)} AS INTEGER) AS avg_days_since_order,
            {up("count(*)", "sum(count(*)) OVER ()")} AS percentage
        FROM rfm WHERE customer_id IN (SELECT customer_id FROM active) GROUP BY segment""",
    "top_customers": f"""
        SELECT customer_id, display_name, left(email, 2) || '***@mail.test' AS email_masked,
            amount_spent AS lifetime_value, number_of_orders AS orders_count,
            {day("first_purchase_at")} AS first_purchase_at, {day("last_order_at")} AS last_order_at,
            CAST(DATE '{p.AS_OF}' - {day("last_order_at")} AS INTEGER) AS days_since_last_order, country, province,
            coalesce(segment, 'Others') AS rfm_segment
        FROM m_customers c LEFT JOIN (SELECT customer_id, segment FROM rfm) s USING (customer_id)
        WHERE number_of_orders > 0 AND amount_spent > 0
        ORDER BY amount_spent DESC, customer_id LIMIT {p.TOP_N}""",
}


def trend_sql(span: tuple[date, date], grain: str) -> str:
    side = """SELECT CAST(date_trunc('{g}', date_key) AS DATE) AS b, sum(amount) AS net,
        count(DISTINCT CASE WHEN row_type = 'SALE' THEN order_id END) AS orders
        FROM m_ledger WHERE {w} GROUP BY 1"""
    cur = side.format(g=grain, w=between("date_key", span))
    prev = side.format(g=grain, w=between("date_key", previous_year(*span)))
    return f"""
        SELECT c.b AS date, {money("c.net")} AS current_net_sales, c.orders AS current_orders,
            {money("coalesce(q.net, 0)")} AS previous_net_sales, coalesce(q.orders, 0) AS previous_orders,
            {growth("c.net", "q.net")} AS net_sales_change_percent,
            {growth("c.orders", "q.orders")} AS orders_change_percent
        FROM ({cur}) c LEFT JOIN (
            SELECT * FROM ({prev}) QUALIFY row_number() OVER (PARTITION BY month(b), day(b) ORDER BY b DESC) = 1) q
        ON month(q.b) = month(c.b) AND day(q.b) = day(c.b)"""


_W0, _W1 = month_window(p.TREND_END_MONTH, p.TREND_LENGTH)
_C0, _C1 = month_window(p.COHORT_END_MONTH, p.COHORTS)
_Q0 = p.CHANNEL_REF - timedelta(days=180)
_Q1 = p.CHANNEL_REF - timedelta(days=90)

TABLES.update(
    {
        "trend": trend_sql(p.TREND_DAYS, "day"),
        "trend_monthly": trend_sql(p.TREND_MONTHS, "month"),
        "notes_trend": trend_sql(p.NOTES, "day"),
        "months": f"""
            SELECT strftime(m.b, '%Y-%m') AS month, coalesce(n, 0) AS new_customers, coalesce(r, 0) AS returning_customers,
                coalesce(n, 0) + coalesce(r, 0) AS total_active,
                CASE WHEN coalesce(n, 0) + coalesce(r, 0) > 0
                    THEN {even("coalesce(r, 0)", "coalesce(n, 0) + coalesce(r, 0)")} ELSE 0 END AS repeat_rate_percent
            FROM (SELECT CAST(unnest(generate_series(DATE '{_W0}', DATE '{_W1}', INTERVAL 1 MONTH)) AS DATE) AS b) m
            LEFT JOIN (SELECT {month("first_purchase_at")} AS b, count(DISTINCT customer_id) AS n FROM m_customers
                GROUP BY 1) f USING (b)
            LEFT JOIN (SELECT {month("created_at")} AS b, count(DISTINCT customer_id) AS r
                FROM m_orders JOIN m_customers USING (customer_id)
                WHERE {month("first_purchase_at")} < {month("created_at")} GROUP BY 1) g USING (b)""",
        "cohort_members": f"""
            SELECT customer_id, {month("first_purchase_at")} AS cohort_month FROM m_customers
            WHERE {between(day("first_purchase_at"), (_C0, _C1))}""",
        "cohorts": f"""
            SELECT cohort_month, cohort_size, period_number, coalesce(r, 0) AS returners,
                CASE WHEN cohort_month + to_months(CAST(period_number AS INTEGER)) <= DATE '{p.REPORT_END}'
                    THEN round_even(100.0::DOUBLE * coalesce(r, 0) / cohort_size, 2) END AS retention_pct
            FROM (SELECT cohort_month, count(*) AS cohort_size FROM cohort_members GROUP BY 1)
            CROSS JOIN (SELECT CAST(unnest(range(1, {p.PERIODS + 1})) AS INTEGER) AS period_number)
            LEFT JOIN (
                SELECT cohort_month, CAST(date_diff('month', cohort_month, {month("created_at")}) AS INTEGER)
                    AS period_number, count(DISTINCT customer_id) AS r
                FROM cohort_members JOIN m_orders USING (customer_id) GROUP BY 1, 2) USING (cohort_month, period_number)""",
        "quality": f"""
            SELECT channel, count(*) AS new_customers, count(*) FILTER (repeated) AS repeated_m3,
                {up("count(*)", "sum(count(*)) OVER ()", 1)} AS pct_of_total,
                {up("count(*) FILTER (repeated)", "count(*)", 1)} AS repeat_by_m3_pct,
                {pct("round(coalesce(avg(amount_spent::DOUBLE * 12 / tenure), 0), 0)")} AS avg_projected_12mo_value,
                {up(f"count(*) FILTER (last_day < DATE '{_Q0}')", "count(*)", 1)} AS hibernating_pct
            FROM (SELECT {channel_of("WHEN a.order_id IS NULL THEN 'Unknown'")} AS channel, amount_spent,
                    {day("last_order_at")} AS last_day,
                    greatest(12 * (year(DATE '{p.CHANNEL_REF}') - year(f)) + month(DATE '{p.CHANNEL_REF}') - month(f)
                        - CASE WHEN day(DATE '{p.CHANNEL_REF}') < day(f) THEN 1 ELSE 0 END, 3) AS tenure,
                    EXISTS (SELECT 1 FROM m_orders o WHERE o.customer_id = c.customer_id
                        AND o.created_at > c.first_purchase_at
                        AND o.created_at <= c.first_purchase_at + INTERVAL 90 DAY) AS repeated
                FROM (SELECT *, {day("first_purchase_at")} AS f FROM m_customers) c
                    LEFT JOIN m_attribution a ON a.order_id = c.first_order_id
                WHERE f >= DATE '{_Q0}' AND f < DATE '{_Q1}' AND number_of_orders > 0)
            GROUP BY channel""",
        # pseudonyms
        "map_product": f"""
            SELECT orig, n, t AS new_title, lower(regexp_replace(t, '[^a-zA-Z0-9]+', '-', 'g')) AS new_handle
            FROM (SELECT orig, n, {words_at(words.ADJECTIVES, "n - 1")} || ' ' ||
                    {words_at(words.NOUNS, "(n - 1) // 20")} ||
                    CASE WHEN n > 500 THEN ' ' || ((n - 1) // 500 + 1) ELSE '' END AS t
                FROM (SELECT orig, row_number() OVER (ORDER BY {h("orig", p.SALT)}, orig) AS n
                    FROM (SELECT title AS orig FROM m_lines WHERE {PRODUCT} AND title IS NOT NULL
                        UNION SELECT product_title FROM m_reviews WHERE product_title IS NOT NULL)))""",
        "map_season": """
            SELECT orig, 'S' || printf('%02d', row_number() OVER (ORDER BY orig)) AS alias
            FROM (SELECT DISTINCT season_code AS orig FROM m_lines WHERE season_code IS NOT NULL)""",
        "map_sku": f"""
            SELECT s.orig, coalesce(alias, 'GEN') || '-' ||
                printf('%05d', row_number() OVER (ORDER BY {h("s.orig", p.SALT)}, s.orig)) AS new_sku
            FROM (SELECT sku AS orig, max(season_code) AS season FROM m_lines WHERE {PRODUCT} AND sku <> '' GROUP BY 1) s
                LEFT JOIN map_season m ON m.orig = s.season""",
        "map_discount": f"""
            SELECT orig, 'PROMO' || printf('%03d', row_number() OVER (ORDER BY {h("orig", p.SALT)}, orig)) AS new_code
            FROM (SELECT lower(trim(discount_code)) AS orig FROM m_orders WHERE discount_code IS NOT NULL
                UNION SELECT lower(trim(code_or_title)) FROM m_discounts)""",
        "map_utm": f"""
            SELECT orig, 'campaign-' || printf('%03d', row_number() OVER (ORDER BY {h("orig", p.SALT)}, orig)) AS new_val
            FROM (SELECT DISTINCT utm_campaign AS orig FROM m_attribution WHERE utm_campaign IS NOT NULL)""",
        "map_campaign": f"""
            SELECT orig, 'cmp_' || printf('%04d', n) AS new_id,
                {words_at(words.CAMPAIGN_NAMES, "n - 1")} || ' ' || printf('%02d', n) AS new_name
            FROM (SELECT orig, row_number() OVER (ORDER BY {h("orig", p.SALT)}, orig) AS n
                FROM (SELECT DISTINCT campaign_id AS orig FROM m_ads))""",
        "map_adset": f"""
            SELECT orig, 'as_' || printf('%05d', n) AS new_id, 'Ad Set ' || printf('%03d', n) AS new_name
            FROM (SELECT orig, row_number() OVER (ORDER BY {h("orig", p.SALT)}, orig) AS n
                FROM (SELECT DISTINCT adset_id AS orig FROM m_ads))""",
        "map_ad": f"""
            SELECT orig, 'ad_' || printf('%05d', n) AS new_id, 'Creative ' || printf('%04d', n) AS new_name
            FROM (SELECT orig, row_number() OVER (ORDER BY {h("orig", p.SALT)}, orig) AS n
                FROM (SELECT DISTINCT ad_id AS orig FROM m_ads))""",
        "anon_lines": f"""
            SELECT order_id, line_item_id, CASE WHEN {PRODUCT} THEN new_sku ELSE sku END AS sku,
                CASE WHEN {PRODUCT} THEN new_title ELSE title END AS title, alias AS season_code, quantity,
                current_quantity, {unit(f"round(original_unit_price * {p.K}, 2)")} AS original_unit_price,
                {unit(f"round(discounted_unit_price * {p.K}, 2)")} AS discounted_unit_price, sku AS old_sku
            FROM m_lines l LEFT JOIN map_product mp ON mp.orig = l.title LEFT JOIN map_sku ms ON ms.orig = l.sku
                LEFT JOIN map_season se ON se.orig = l.season_code""",
        # perturbation
        "kept_orders": f"""
            SELECT * FROM m_orders WHERE {u("'o' || order_id", p.PERTURB_SALT)} >= 0.05
                + 0.20 * {u(f"'m' || strftime({day('created_at')}, '%Y-%m')", p.PERTURB_SALT)}
                + 0.10 * ({u(f"'d' || CAST({day('created_at')} AS VARCHAR)", p.PERTURB_SALT)} - 0.5)""",
        "factors": f"""
            SELECT *, CASE WHEN {PRODUCT} AND title IS NOT NULL AND original_unit_price > 0 THEN
                    greatest(round(original_unit_price * (0.70 + 0.70 * {u("'p' || title", p.PERTURB_SALT)}), 0) - 0.01, 0.99)
                END AS target,
                CASE WHEN NOT {PRODUCT} OR original_unit_price <= 0 OR quantity <> 1 OR current_quantity <> 1
                        OR returned_quantity > 0 OR line_item_id IN (SELECT line_item_id FROM m_refund_lines) THEN 1
                    WHEN {u("'q' || line_item_id", p.PERTURB_SALT)} < 0.12 THEN 2
                    WHEN {u("'q' || line_item_id", p.PERTURB_SALT)} < 0.16 THEN 3
                    WHEN {u("'q' || line_item_id", p.PERTURB_SALT)} < 0.18 THEN 4 ELSE 1 END AS times
            FROM m_lines""",
    }
)


def follow_price(x: str, times: str = "1") -> str:
    """An amount times target/original price, half away from zero, in whole cents."""
    a = f"CAST({x} * 100 AS HUGEINT) * CAST(target * 100 AS HUGEINT) * {times}"
    b = "CAST(old_price * 100 AS HUGEINT)"
    return unit(
        f"CASE WHEN target IS NULL THEN {x} * {times} ELSE CAST((2 * {a} + {b}) // (2 * {b}) AS DECIMAL(20,0)) * 0.01 END"
    )


def by_ratio(x: str) -> str:
    """A non-negative amount times the order's value ratio, half away from zero, in whole cents."""
    a = f"CAST({x} * 100 AS HUGEINT) * CAST(new_net * 100 AS HUGEINT)"
    b = "CAST(old_net * 100 AS HUGEINT)"
    return (
        f"CASE WHEN old_net > 0 THEN CAST((2 * {a} + {b}) // (2 * {b}) AS DECIMAL(20,0)) * 0.01 ELSE {x} END"
    )


TABLES.update(
    {
        "new_lines": f"""
            SELECT order_id, line_item_id, CAST(quantity * times AS INTEGER) AS quantity,
                CAST(current_quantity * times AS INTEGER) AS current_quantity, {follow_price("old_price")} AS original_unit_price,
                {follow_price("discounted_unit_price")} AS discounted_unit_price,
                {money("discounted_unit_price * quantity")} AS old_net, times, target, old_price
            FROM (SELECT *, original_unit_price AS old_price FROM factors)""",
        "new_refund_lines": f"""
            SELECT r.id, r.refund_id, r.order_id, r.subtotal AS old_subtotal, {follow_price("r.subtotal")} AS subtotal
            FROM m_refund_lines r JOIN new_lines n ON n.order_id = r.order_id AND n.line_item_id = r.line_item_id""",
        "ratios": """
            SELECT order_id, sum(old_net) AS old_net, sum(discounted_unit_price * quantity) AS new_net
            FROM new_lines GROUP BY 1""",
        "new_refunds": f"""
            SELECT f.refund_id, f.order_id, f.total_refunded AS old_total,
                {unit(f'''CASE WHEN f.total_refunded = 0 THEN 0 WHEN s.old > 0 THEN
                    CAST((2 * CAST(f.total_refunded * 100 AS HUGEINT) * CAST(s.new * 100 AS HUGEINT)
                        + CAST(s.old * 100 AS HUGEINT)) // (2 * CAST(s.old * 100 AS HUGEINT)) AS DECIMAL(20,0)) * 0.01
                    ELSE {by_ratio("f.total_refunded")} END''')} AS total_refunded
            FROM m_refunds f
                LEFT JOIN (SELECT refund_id, sum(old_subtotal) AS old, sum(subtotal) AS new FROM new_refund_lines
                    GROUP BY 1) s USING (refund_id)
                LEFT JOIN ratios USING (order_id)""",
        "new_orders": f"""
            SELECT o.order_id, {money(by_ratio("total_amount"))} AS total_amount, {money(by_ratio("total_paid"))} AS total_paid,
                {money("greatest(total_refunded + coalesce(delta, 0), 0)")} AS total_refunded,
                {money(f"greatest(current_total + {by_ratio('total_amount')} - total_amount - coalesce(delta, 0), 0)")}
                    AS current_total,
                {money(f"net_payment + {by_ratio('total_paid')} - total_paid - coalesce(delta, 0)")} AS net_payment
            FROM m_orders o LEFT JOIN ratios USING (order_id)
                LEFT JOIN (SELECT order_id, sum(total_refunded - old_total) AS delta FROM new_refunds GROUP BY 1)
                    USING (order_id)""",
        "grown": f"""
            SELECT line_item_id, CASE WHEN v < 0.70 THEN 2 WHEN v < 0.92 THEN 3 ELSE 4 END AS q
            FROM (SELECT line_item_id, {u("'q' || line_item_id", p.QTY_SALT)} AS draw, {u("'s' || line_item_id", p.QTY_SALT)} AS v,
                    least(0.95, (0.10 + 0.35 * {u(f"'m' || strftime({day('created_at')}, '%Y-%m')", p.QTY_SALT)})
                        * (0.50 + {u("'t' || title", p.QTY_SALT)})) AS chance
                FROM m_lines JOIN m_orders USING (order_id)
                WHERE quantity = 1 AND current_quantity = 1 AND returned_quantity = 0 AND original_unit_price > 0
                    AND title IS NOT NULL AND {PRODUCT}
                    AND line_item_id NOT IN (SELECT line_item_id FROM m_refund_lines))
            WHERE draw < chance""",
        "quantity_lines": f"""
            SELECT order_id, line_item_id, coalesce(q, quantity) AS quantity, coalesce(q, current_quantity) AS current_quantity,
                CASE WHEN q IS NOT NULL AND unfulfilled_quantity = quantity THEN q ELSE unfulfilled_quantity END
                    AS unfulfilled_quantity,
                {unit(f'CASE WHEN q IS NULL THEN original_unit_price ELSE {up("original_unit_price", "q", 2, 1)} END')}
                    AS original_unit_price,
                {unit(f'CASE WHEN q IS NULL THEN discounted_unit_price ELSE {up("discounted_unit_price", "q", 2, 1)} END')}
                    AS discounted_unit_price, sku, title, season_code, line_status
            FROM m_lines LEFT JOIN grown USING (line_item_id)""",
    }
)


def ledger_total(lines: str, refunds: str = "m_refund_lines") -> str:
    """Net sales of a dataset whose lines keep their ids."""
    keep = PRODUCT.replace("sku", "o.sku")
    return f"""(SELECT sum(a) FROM (
        SELECT l.discounted_unit_price * l.quantity AS a FROM {lines} l JOIN m_lines o USING (line_item_id) WHERE {keep}
        UNION ALL SELECT -r.subtotal FROM {refunds} r JOIN m_lines o USING (line_item_id) WHERE {keep}))"""


def statement(body: str) -> str:
    """Prefix a body with the table definitions it uses, dependencies first."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"[a-z_]+", sql):
            if name in TABLES and name not in order:
                need(TABLES[name])
                if name not in order:
                    order.append(name)

    need(body)
    defs = ",\n".join(f"{n} AS ({TABLES[n].strip()})" for n in order)
    return f"WITH {defs}\n{body.strip()}" if defs else body.strip()


def oracle(name: str, body: str) -> None:
    ORACLES[name] = statement(body)


# --- ledger and views --------------------------------------------------------

oracle("net_sales_lines", "SELECT * FROM m_ledger")
oracle(
    "refund_reconciliation",
    f"""SELECT f.refund_id, f.order_id, {day("f.processed_at")} AS processed_date, f.total_refunded,
        {money("coalesce(sum(r.subtotal), 0)")} AS allocated_subtotal, count(r.id) AS refund_line_count,
        {money("CASE WHEN count(r.id) = 0 THEN f.total_refunded ELSE 0 END")} AS unallocated_refund, f.note
    FROM m_refunds f LEFT JOIN m_refund_lines r ON r.refund_id = f.refund_id
    GROUP BY f.refund_id, f.order_id, f.processed_at, f.total_refunded, f.note""",
)
oracle(
    "daily_sales_by_channel",
    f"""SELECT {day("created_at")} AS order_date, coalesce(traffic_channel, 'UNKNOWN') AS traffic_channel,
        coalesce(traffic_source, 'UNKNOWN') AS traffic_source, coalesce(device_type, 'unknown') AS device_type,
        count(*) AS orders, {money("sum(total_amount)")} AS gross_revenue, {money("sum(total_refunded)")} AS refunded,
        {money("sum(net_payment)")} AS net_revenue
    FROM m_orders LEFT JOIN m_attribution USING (order_id) GROUP BY 1, 2, 3, 4""",
)
oracle(
    "daily_conversion",
    f"""SELECT session_date AS order_date, CAST(sum(sessions) AS BIGINT) AS sessions, coalesce(max(n), 0) AS orders,
        {money("max(net)")} AS net_revenue, {up("coalesce(max(n), 0)", "sum(sessions)")} AS conversion_pct
    FROM m_sessions LEFT JOIN (SELECT {day("created_at")} AS session_date, count(*) AS n, sum(net_payment) AS net
        FROM m_orders GROUP BY 1) USING (session_date) GROUP BY session_date""",
)
for _name, _table, _key, _out, _where in [
    ("monthly_visitors", "m_visitors", "new_vs_returning", "new_vs_returning", "true"),
    ("monthly_channels", "m_channels", "channel_group", "channel_group", "true"),
    ("us_states_monthly", "m_regions", "region", "state", "country = 'United States'"),
]:
    oracle(
        _name,
        f"""SELECT CAST(date_trunc('month', session_date) AS DATE) AS month, {_key} AS {_out},
            CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(total_users) AS BIGINT) AS users
        FROM {_table} WHERE {_where} GROUP BY 1, 2""",
    )
oracle(
    "monthly_channel_conversion",
    f"""SELECT month, channel, sessions, coalesce(n, 0) AS orders, {money("net")} AS net_revenue,
        {up("net", "n", 0, 1)} AS aov, {up("coalesce(n, 0)", "sessions")} AS conversion_pct
    FROM (SELECT CAST(date_trunc('month', session_date) AS DATE) AS month,
            CASE WHEN channel_group IN ('Paid Shopping', 'Cross-network') THEN 'Paid Search' ELSE channel_group END AS channel,
            CAST(sum(sessions) AS BIGINT) AS sessions FROM m_channels GROUP BY 1, 2)
    LEFT JOIN (SELECT {month("created_at")} AS month, {channel_of("")} AS channel, count(*) AS n,
            round(sum(net_payment), 0) AS net
        FROM m_orders LEFT JOIN m_attribution USING (order_id) GROUP BY 1, 2) USING (month, channel)""",
)


def ads_sql(grain: str, name: str) -> str:
    return f"""SELECT platform, CAST(date_trunc('month', date) AS DATE) AS month, {grain}_id, max({name}) AS {grain}_name,
        {money("sum(spend)")} AS spend, CAST(sum(impressions) AS BIGINT) AS impressions,
        CAST(sum(clicks) AS BIGINT) AS clicks, {up("sum(clicks)", "sum(impressions)")} AS ctr_pct,
        {up("sum(spend)", "sum(clicks)", 2, 1)} AS cpc, CAST(sum(purchases) AS BIGINT) AS purchases,
        {money("sum(purchase_value)")} AS revenue, {up("sum(purchase_value)", "sum(spend)", 2, 1)} AS roas,
        {up("sum(spend)", "sum(purchases)", 2, 1)} AS cpa
    FROM m_ads GROUP BY 1, 2, 3"""


oracle("campaign_monthly", ads_sql("campaign", "campaign_name"))
oracle(
    "adset_monthly",
    f"""SELECT *, 'ACTIVE' AS status, CASE right(adset_id, 1) WHEN '0' THEN 'lookalike' WHEN '1' THEN 'interest'
        ELSE 'broad' END AS targeting_type, 'US' AS geo FROM ({ads_sql("adset", "'Set ' || adset_id")})""",
)
oracle(
    "ad_monthly",
    f"""SELECT *, 'ACTIVE' AS status, CASE right(ad_id, 1) WHEN '1' THEN 'video' ELSE 'image' END AS creative_format,
        right(ad_id, 1) <> '1' AS is_dynamic FROM ({ads_sql("ad", "'Ad ' || ad_id")})""",
)

# --- revenue -----------------------------------------------------------------

_KPI = f"""{money("coalesce(sum(amount) FILTER (row_type = 'SALE'), 0)")} AS sales,
    {money("abs(coalesce(sum(amount) FILTER (row_type = 'RETURN'), 0))")} AS back, {money("coalesce(sum(amount), 0)")} AS net,
    CAST(coalesce(sum(quantity), 0) AS BIGINT) AS qty, count(DISTINCT order_id) FILTER (row_type = 'SALE') AS orders"""

oracle(
    "revenue_summary",
    f"""SELECT DATE '{p.SUMMARY[0]}' AS start_date, DATE '{p.SUMMARY[1]}' AS end_date, c.sales AS total_sales,
        c.back AS total_returns, c.net AS net_sales, c.orders AS total_orders, c.qty AS total_qty,
        coalesce({even("c.net", "c.orders", 2, 1)}, 0) AS average_order_value,
        {growth("c.net", "q.net")} AS net_sales_change_percent, {growth("c.sales", "q.sales")} AS total_sales_change_percent,
        {growth("c.back", "q.back")} AS total_returns_change_percent, {growth("c.orders", "q.orders")} AS orders_change_percent,
        {growth("c.qty", "q.qty")} AS total_qty_change_percent,
        CASE WHEN q.net <> 0 AND q.orders > 0 THEN
            {pct("round_even((c.net::DOUBLE / c.orders / (q.net::DOUBLE / q.orders) - 1) * 100, 2)")} END AS aov_change_percent
    FROM (SELECT {_KPI} FROM m_ledger WHERE {between("date_key", p.SUMMARY)}) c,
        (SELECT {_KPI} FROM m_ledger WHERE {between("date_key", previous_period(*p.SUMMARY))}) q""",
)
oracle(
    "revenue_sparklines",
    f"""SELECT date, net AS net_sales, sales AS total_sales, back AS total_returns, orders AS total_orders, qty AS total_qty,
        coalesce({even("net", "orders", 2, 1)}, 0) AS average_order_value
    FROM (SELECT date_key AS date, {_KPI} FROM m_ledger WHERE {between("date_key", p.SUMMARY)} GROUP BY 1)""",
)
oracle("revenue_trend", "SELECT * FROM trend")
oracle("revenue_trend_weekly", trend_sql(p.TREND_DAYS, "week"))
oracle("revenue_trend_monthly", "SELECT * FROM trend_monthly")
oracle(
    "revenue_trend_totals",
    f"""SELECT n AS total_points, c AS current_total_net_sales, q AS previous_total_net_sales, co AS current_total_orders,
        qo AS previous_total_orders, {growth("c", "q")} AS net_sales_change_percent, {growth("co", "qo")} AS orders_change_percent
    FROM (SELECT count(*) AS n, {money("sum(current_net_sales)")} AS c, {money("sum(previous_net_sales)")} AS q,
        CAST(sum(current_orders) AS BIGINT) AS co, CAST(sum(previous_orders) AS BIGINT) AS qo FROM trend_monthly)""",
)
_CHANNEL = f"""
    SELECT channel, CAST(sum(orders) AS BIGINT) AS orders, {money("coalesce(sum(revenue), 0)")} AS revenue,
        {money("sum(sum(revenue)) OVER ()")} AS total_revenue, CAST(sum(sum(orders)) OVER () AS BIGINT) AS total_orders,
        CASE WHEN sum(sum(revenue)) OVER () > 0 THEN {even("sum(revenue)", "sum(sum(revenue)) OVER ()")} ELSE 0 END AS percentage
    FROM (SELECT CASE WHEN row_number() OVER (ORDER BY revenue DESC NULLS LAST, channel) <= 4 THEN channel ELSE 'Other' END
            AS channel, orders, revenue
        FROM (SELECT coalesce(traffic_channel, 'UNKNOWN') AS channel, count(*) AS orders, sum(net_payment) AS revenue
            FROM m_orders LEFT JOIN m_attribution USING (order_id) WHERE {between(day("created_at"), p.SUMMARY)} GROUP BY 1))
    GROUP BY channel"""
oracle("revenue_by_channel", _CHANNEL)
oracle("revenue_by_channel_limited", f"SELECT * FROM ({_CHANNEL}) ORDER BY revenue DESC, channel LIMIT 2")
oracle(
    "yearly_comparison_months",
    f"""SELECT strftime(make_date(2000, CAST(month_number AS INTEGER), 1), '%b') AS month, month_number,
        {money("coalesce(sum(amount) FILTER (year(date_key) = year(last)), 0)")} AS current_year_revenue,
        {money("coalesce(sum(amount) FILTER (year(date_key) = year(last) - 1), 0)")} AS previous_year_revenue
    FROM (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month_number)
        LEFT JOIN m_ledger ON month(date_key) = month_number, (SELECT max(date_key) AS last FROM m_ledger)
    GROUP BY month_number""",
)
oracle(
    "yearly_comparison_ytd",
    f"""SELECT CAST(year(last) AS INTEGER) AS current_year, CAST(year(last) - 1 AS INTEGER) AS previous_year, last AS ytd_end_date,
        c AS current_year_total, q AS previous_year_total, {growth_pos("c", "q")} AS yoy_change_percent
    FROM (SELECT any_value(last) AS last,
            {money("sum(amount) FILTER (date_key >= date_trunc('year', last) AND date_key <= last)")} AS c,
            {money("sum(amount) FILTER (date_key >= date_trunc('year', last) - INTERVAL 1 YEAR AND date_key <= last - INTERVAL 1 YEAR)")} AS q
        FROM m_ledger, (SELECT max(date_key) AS last FROM m_ledger))""",
)
oracle(
    "top_products",
    f"""SELECT title AS product_name, {money("c")} AS revenue, CAST(cu AS BIGINT) AS units_sold, {money("coalesce(q, 0)")} AS previous_revenue,
        CAST(coalesce(qu, 0) AS BIGINT) AS previous_units_sold, row_number() OVER (ORDER BY c DESC, title) AS rank,
        {growth_pos("c", "coalesce(q, 0)")} AS revenue_change_percent, {growth_pos("cu", "coalesce(qu, 0)")} AS units_change_percent
    FROM (SELECT title, sum(amount) AS c, sum(quantity) AS cu FROM m_ledger WHERE {between("date_key", p.PRODUCTS)}
            GROUP BY 1 HAVING sum(amount) > 0)
        LEFT JOIN (SELECT title, sum(amount) AS q, sum(quantity) AS qu FROM m_ledger
            WHERE {between("date_key", previous_period(*p.PRODUCTS))} GROUP BY 1) USING (title)""",
)
oracle(
    "product_count",
    f"""SELECT count(*) AS total_products_count
    FROM (SELECT title FROM m_ledger WHERE {between("date_key", p.PRODUCTS)} GROUP BY title HAVING sum(amount) > 0)""",
)

# --- customers ---------------------------------------------------------------

oracle("buyer_count", "SELECT count(*) AS total_customers FROM m_customers WHERE number_of_orders > 0")
oracle(
    "customer_summary",
    f"""SELECT DATE '{p.ACTIVE[0]}' AS start_date, DATE '{p.ACTIVE[1]}' AS end_date, count(*) AS total_customers,
        count(*) FILTER ({between(day("customer_since"), p.ACTIVE)}) AS new_customers,
        count(*) FILTER ({day("customer_since")} < DATE '{p.ACTIVE[0]}') AS returning_customers,
        coalesce({even("sum(amount_spent)", "count(amount_spent)", 2, 1)}, 0) AS average_ltv,
        CASE WHEN count(*) > 0 THEN {even("count(*) FILTER (number_of_orders > 1)", "count(*)")} ELSE 0 END AS repeat_purchase_rate
    FROM m_customers WHERE customer_id IN (SELECT customer_id FROM active)""",
)
oracle("rfm_scores", "SELECT * FROM rfm")
oracle("rfm_segments", "SELECT * FROM segments")
oracle("order_segments", "SELECT segment, count(*) AS customer_count FROM rfm GROUP BY 1")
_TOP3 = "coalesce(sum(total_lifetime_value) FILTER (segment IN ('Champions', 'Loyal', 'Cant Lose Them')), 0)"
oracle(
    "rfm_top_value_share",
    f"""SELECT {money(_TOP3)} AS top_ltv, {money("sum(total_lifetime_value)")} AS total_ltv,
        {up(_TOP3, "sum(total_lifetime_value)")} AS top_value_share_pct FROM segments""",
)
oracle("top_customers", "SELECT * FROM top_customers")
oracle(
    "top_customers_concentration",
    f"SELECT count(*) AS customers, {money('sum(lifetime_value)')} AS top_lifetime_value FROM top_customers",
)
oracle("mask_email", "SELECT customer_id, left(email, 2) || '***@mail.test' AS email_masked FROM m_customers")
oracle("acquisition_trend", "SELECT * FROM months")
oracle("acquisition_trend_from_activity", "SELECT * FROM months")
oracle(
    "acquisition_trend_totals",
    f"""SELECT n AS total_new, r AS total_returning, t AS current_month_total,
        {growth_pos("t", "b")} AS mom_change_percent, rate AS current_repeat_rate
    FROM (SELECT CAST(sum(new_customers) AS BIGINT) AS n, CAST(sum(returning_customers) AS BIGINT) AS r FROM months),
        (SELECT total_active AS t, {pct("repeat_rate_percent")} AS rate FROM months ORDER BY month DESC LIMIT 1),
        (SELECT total_active AS b FROM months ORDER BY month DESC LIMIT 1 OFFSET 1)""",
)
oracle("cohort_retention", "SELECT * FROM cohorts")
oracle("cohort_retention_from_activity", "SELECT * FROM cohorts")
oracle(
    "cohort_weighted_average",
    """SELECT period_number, round(sum(retention_pct * cohort_size) / nullif(sum(CASE WHEN retention_pct IS NOT NULL
        THEN cohort_size END), 0), 6) AS weighted_retention_pct FROM cohorts GROUP BY 1""",
)
oracle(
    "cohort_best_m1",
    """SELECT cohort_month, retention_pct FROM cohorts WHERE period_number = 1 AND retention_pct IS NOT NULL
    ORDER BY retention_pct DESC, cohort_month LIMIT 1""",
)
oracle("acquisition_channel_quality", "SELECT * FROM quality")
oracle(
    "acquisition_channel_quality_totals",
    f"""SELECT DATE '{_Q0}' AS cohort_start, DATE '{_Q1}' AS cohort_end, CAST(n AS BIGINT) AS total_new_customers,
        coalesce({even("b", "n", 1)}, 0) AS avg_repeat_by_m3_pct, channel AS top_channel, pct_of_total AS top_channel_share,
        repeat_by_m3_pct AS top_channel_repeat_rate
    FROM (SELECT sum(new_customers) AS n, sum(repeated_m3) AS b FROM quality),
        (SELECT * FROM quality ORDER BY new_customers DESC, channel LIMIT 1)""",
)
_D = f"CAST(DATE '{p.AS_OF}' - {day('last_order_at')} AS INTEGER)"
oracle(
    "severity_bands",
    f"""SELECT 'customer ' || customer_id AS subject, CAST(d AS DOUBLE) AS value,
        CASE WHEN d > 730 THEN 'critical' WHEN d > 365 THEN 'warning' WHEN d IS NOT NULL THEN 'normal' END AS severity,
        CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 30 THEN d || 'd ago' WHEN d < 365 THEN (d // 30) || 'mo ago'
            WHEN d IS NOT NULL THEN CAST(round(d::DOUBLE / 365, 1) AS DECIMAL(12,1)) || 'yr ago' END AS label
    FROM (SELECT customer_id, {_D} AS d FROM m_customers)
    UNION ALL SELECT 'channel ' || channel, CAST(hibernating_pct AS DOUBLE), CASE WHEN hibernating_pct >= 35 THEN 'critical'
        WHEN hibernating_pct >= 20 THEN 'warning' ELSE 'healthy' END, NULL FROM quality""",
)

# --- numbering, notes, ingestion ---------------------------------------------

oracle(
    "assign_row_numbers",
    "SELECT order_id, created_at, row_number() OVER (ORDER BY created_at, order_id) AS row_number FROM m_orders",
)
oracle(
    "ntile_global",
    """SELECT order_id, total_amount, CAST(ntile(7) OVER (ORDER BY total_amount NULLS LAST, order_id) AS INTEGER) AS bucket
    FROM m_orders""",
)
oracle(
    "rank_top",
    f"""SELECT customer_id, {money("s")} AS spend, row_number() OVER (ORDER BY s DESC NULLS LAST, customer_id) AS rank
    FROM (SELECT customer_id, sum(total_amount) AS s FROM m_orders GROUP BY 1)""",
)
oracle(
    "share_of_total",
    f"""SELECT device_type, count(*) AS orders, {up("count(*)", "sum(count(*)) OVER ()")} AS share
    FROM m_attribution GROUP BY 1""",
)
oracle("annotations_list", f"SELECT * FROM m_notes WHERE {between('date', p.NOTES)} AND category = 'incident'")
oracle("annotations_count", f"SELECT count(*) AS total FROM m_notes WHERE {between('date', p.NOTES)}")
oracle(
    "annotations_append",
    """SELECT (SELECT max(id) FROM m_notes) + row_number() OVER (ORDER BY date, title, created_by, category NULLS FIRST, description NULLS FIRST) AS id,
        date, title, description, category, created_by, TIMESTAMP '1996-02-01' AS created_at, TIMESTAMP '1996-02-01' AS updated_at
    FROM checked_notes WHERE reason IS NULL""",
)
oracle("annotations_rejected", "SELECT * FROM checked_notes WHERE reason IS NOT NULL")
oracle(
    "annotations_overlay",
    """SELECT date, current_net_sales, id AS annotation_id, title, category
    FROM notes_trend LEFT JOIN m_notes USING (date)""",
)
oracle(
    "derive_line_columns",
    f"""SELECT order_id, line_item_id, returned_quantity, current_quantity, returned_quantity > 0 AS is_returned,
        {unit("discounted_unit_price * current_quantity")} AS net_sales FROM m_lines""",
)
oracle(
    "upsert_snapshot",
    f"""SELECT session_date, referrer_source, CAST(sessions + CASE WHEN session_date > DATE '{p.SPLIT_DAY - timedelta(days=p.REFETCH_DAYS)}'
        THEN 1 ELSE 0 END AS BIGINT) AS sessions, updated_at FROM m_sessions""",
)
oracle(
    "refetch_window",
    f"""SELECT session_date, referrer_source, CAST(sessions * CASE WHEN session_date BETWEEN
        DATE '{p.SPLIT_DAY - timedelta(days=p.REFETCH_DAYS - 1)}' AND DATE '{p.SPLIT_DAY}' THEN 2 ELSE 1 END AS BIGINT) AS sessions
    FROM m_sessions""",
)
oracle(
    "replace_children",
    f"""SELECT id, order_id, CAST(position AS SMALLINT) AS position, CASE WHEN again THEN upper(code_or_title) ELSE code_or_title END
        AS code_or_title
    FROM (SELECT *, {between(day("created_at"), p.SUMMARY)} AS again FROM m_discounts JOIN m_orders USING (order_id))
    WHERE NOT again OR position = 0""",
)
oracle("pending_attribution", "SELECT order_id, updated_at FROM m_attribution WHERE NOT journey_ready")
oracle("resolve_discount_allocations", "SELECT * FROM m_allocations")

# --- anonymisation -----------------------------------------------------------

_CID = "CAST(customer_id AS VARCHAR)"
oracle(
    "salted_draws",
    f"""SELECT customer_id, {h(_CID, p.SALT)} AS hash, {u(_CID, p.SALT)} AS uniform, {name_of(_CID, p.SALT)} AS name
    FROM m_customers""",
)
oracle("anonymize_path", f"SELECT session_date, landing_page, {path_of('landing_page', p.SALT)} AS path FROM m_pages")
oracle(
    "build_mappings",
    """SELECT 'product' AS kind, orig, new_title AS alias FROM map_product UNION ALL SELECT 'season', orig, alias FROM map_season
    UNION ALL SELECT 'sku', orig, new_sku FROM map_sku UNION ALL SELECT 'discount', orig, new_code FROM map_discount
    UNION ALL SELECT 'utm', orig, new_val FROM map_utm UNION ALL SELECT 'campaign', orig, new_name FROM map_campaign
    UNION ALL SELECT 'adset', orig, new_id FROM map_adset UNION ALL SELECT 'ad', orig, new_id FROM map_ad""",
)
oracle(
    "anonymize_customers",
    f"""SELECT customer_id, 'customer' || substr(md5({_CID} || '{p.SALT}'), 1, 12) || '@example.com' AS email,
        {name_of(_CID, p.SALT)} AS display_name, {money(f"round(amount_spent * {p.K}, 2)")} AS amount_spent,
        left(zip, 3) || '00' AS zip, CAST(NULL AS VARCHAR) AS tags FROM m_customers""",
)
oracle(
    "anonymize_orders",
    f"""SELECT order_id, '#' || (10000 + row_number() OVER (ORDER BY created_at, order_id)) AS order_name,
        {money(f"round(total_amount * {p.K}, 2)")} AS total_amount, {money(f"round(net_payment * {p.K}, 2)")} AS net_payment,
        {money(f"round(current_total * {p.K}, 2)")} AS current_total, {money(f"round(total_paid * {p.K}, 2)")} AS total_paid,
        {money(f"round(total_refunded * {p.K}, 2)")} AS total_refunded, new_code AS discount_code
    FROM m_orders LEFT JOIN map_discount ON orig = lower(trim(discount_code))""",
)
oracle(
    "anonymize_attribution",
    f"""SELECT order_id, CAST(NULL AS VARCHAR) AS user_agent,
        CASE WHEN lower(traffic_source) <> 'facebook' THEN 'https://' || lower(traffic_source) || '.example.com' END AS referrer_url,
        {path_of("('/products/p' || page_no)", p.SALT)} AS landing_page, new_val AS utm_campaign, CAST(NULL AS VARCHAR) AS utm_content
    FROM m_attribution LEFT JOIN map_utm ON orig = utm_campaign""",
)
oracle(
    "anonymize_discounts",
    f"""SELECT id, {unit(f"round(value_amount * {p.K}, 2)")} AS value_amount, value_percentage,
        CASE WHEN description IS NOT NULL THEN 'Manual discount' END AS description, new_code AS code_or_title
    FROM m_discounts LEFT JOIN map_discount ON orig = lower(trim(code_or_title))""",
)
oracle(
    "anonymize_lines",
    f"""SELECT order_id, line_item_id, sku, title, season_code, original_unit_price, discounted_unit_price,
        {unit("discounted_unit_price * current_quantity")} AS net_sales FROM anon_lines""",
)
oracle(
    "anonymize_refunds",
    f"""SELECT refund_id, {unit(f"round(total_refunded * {p.K}, 2)")} AS total_refunded,
        CASE WHEN note IS NULL THEN NULL WHEN note ILIKE '%redo%' THEN 'Return via app' ELSE 'Refund' END AS note FROM m_refunds""",
)
oracle(
    "anonymize_landing_pages",
    f"""SELECT session_date, {path_of("landing_page", p.SALT)} AS landing_page, CAST(sum(sessions) AS BIGINT) AS sessions,
        CAST(sum(engaged_sessions) AS BIGINT) AS engaged_sessions FROM m_pages GROUP BY 1, 2""",
)
oracle(
    "anonymize_ads",
    f"""SELECT date, platform, a.new_id AS ad_id, a.new_name AS ad_name, s.new_id AS adset_id, s.new_name AS adset_name,
        c.new_id AS campaign_id, c.new_name AS campaign_name, {money(f"round(spend * {p.K}, 2)")} AS spend, impressions,
        CAST(clicks AS BIGINT) AS clicks, CAST(purchases AS BIGINT) AS purchases,
        {money(f"round(purchase_value * {p.K}, 2)")} AS purchase_value
    FROM m_ads JOIN map_ad a ON a.orig = ad_id JOIN map_adset s ON s.orig = adset_id JOIN map_campaign c ON c.orig = campaign_id""",
)
_ADS_SUMS = f"""{money(f"round(sum(spend) * {p.K}, 2)")} AS spend, CAST(sum(impressions) AS BIGINT) AS impressions,
    CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(purchases) AS BIGINT) AS purchases,
    {money(f"round(sum(purchase_value) * {p.K}, 2)")} AS purchase_value"""
oracle(
    "anonymize_campaigns",
    f"""SELECT date, platform, new_id AS campaign_id, new_name AS campaign_name, {_ADS_SUMS}
    FROM m_ads JOIN map_campaign ON orig = campaign_id GROUP BY date, platform, new_id, new_name, m_ads.campaign_name""",
)
oracle(
    "anonymize_adsets",
    f"""SELECT date, platform, s.new_id AS adset_id, s.new_name AS adset_name, c.new_id AS campaign_id,
        c.new_name AS campaign_name, {_ADS_SUMS}
    FROM m_ads JOIN map_adset s ON s.orig = adset_id JOIN map_campaign c ON c.orig = campaign_id
    GROUP BY date, platform, s.new_id, s.new_name, c.new_id, c.new_name, m_ads.campaign_name""",
)
oracle(
    "anonymize_refund_lines",
    f"""SELECT id, order_id, line_item_id, quantity, {unit(f"round(subtotal * {p.K}, 2)")} AS subtotal FROM m_refund_lines""",
)
oracle(
    "anonymize_allocations",
    f"""SELECT id, line_item_id, order_discount_id, {unit(f"round(allocated_amount * {p.K}, 2)")} AS allocated_amount FROM m_allocations""",
)
oracle(
    "anonymize_ads_meta",
    f"""SELECT platform, new_id AS id, 'crv_' || {h("'c-' || ad_id", p.SALT)} AS detail,
        CASE WHEN right(ad_id, 1) = '1' THEN {path_of("('/collections/' || ad_id)", p.SALT)} END AS landing_url
    FROM (SELECT DISTINCT platform, ad_id FROM m_ads) JOIN map_ad ON orig = ad_id
    UNION ALL SELECT platform, new_id, CASE right(adset_id, 1) WHEN '0' THEN 'Source audience/Custom audience'
        WHEN '1' THEN 'Custom audience' ELSE '' END, NULL
    FROM (SELECT DISTINCT platform, adset_id FROM m_ads) JOIN map_adset ON orig = adset_id""",
)
_RID = "CAST(id AS VARCHAR)"


def _by_rating(good: list[str], fair: list[str], poor: list[str]) -> str:
    draw = h(_RID, p.SALT)
    return (
        f"CASE WHEN rating >= 4 THEN {words_at(good, draw)} WHEN coalesce(rating, 3) = 3 THEN {words_at(fair, draw)} "
        f"ELSE {words_at(poor, draw)} END"
    )


oracle(
    "anonymize_reviews",
    f"""SELECT id, {_by_rating(words.GOOD_TITLES, words.FAIR_TITLES, words.POOR_TITLES)} AS title,
        {_by_rating(words.GOOD_TEXTS, words.FAIR_TEXTS, words.POOR_TEXTS)} AS body, 9000000000 + n AS product_external_id,
        new_handle AS product_handle, new_title AS product_title, CAST(NULL AS VARCHAR) AS ip_address,
        {h("'rv' || (id * 7)", p.SALT)} AS reviewer_id,
        CASE WHEN id % 4 > 0 THEN {h("'rx' || (id * 11)", p.SALT)} END AS reviewer_external_id,
        regexp_replace({name_of("'r' || id", p.SALT)}, ' (.)\\S*$', ' \\1.') AS reviewer_name,
        'reviewer' || substr(md5({_RID} || '{p.SALT}'), 1, 12) || '@example.com' AS reviewer_email,
        false AS has_pictures, CAST(NULL AS VARCHAR) AS pictures
    FROM m_reviews LEFT JOIN map_product ON orig = product_title""",
)


def _scaled_check(name: str, before: str, after: str) -> str:
    return f"""SELECT '{name}' AS check_name, {money("b")} AS before_value, {money("a")} AS after_value,
        coalesce(abs(a / nullif(b, 0) - {p.K}) / {p.K} <= 0.005, true) AS ok FROM (SELECT {before} AS b, {after} AS a)"""


def _same_check(name: str, table: str) -> str:
    return f"""SELECT '{name}', {money("count(*)")}, {money("count(*)")}, true FROM {table}"""


def _sum_of(table: str, col: str) -> tuple[str, str]:
    return f"(SELECT sum({col}) FROM {table})", f"(SELECT sum(round({col} * {p.K}, 2)) FROM {table})"


_ANON_REFUNDS = f"(SELECT line_item_id, round(subtotal * {p.K}, 2) AS subtotal FROM m_refund_lines)"
_CAMPAIGN = "(SELECT sum(spend) AS spend, sum(purchase_value) AS purchase_value FROM m_ads GROUP BY date, platform, campaign_id, campaign_name)"
oracle(
    "anonymize_checks",
    " UNION ALL ".join(
        [
            _scaled_check("net_sales", ledger_total("m_lines"), ledger_total("anon_lines", _ANON_REFUNDS)),
            _scaled_check("net_payment", *_sum_of("m_orders", "net_payment")),
            _scaled_check("refunds", *_sum_of("m_refunds", "total_refunded")),
            _scaled_check("ad_spend", *_sum_of(_CAMPAIGN, "spend")),
            _scaled_check("ad_revenue", *_sum_of(_CAMPAIGN, "purchase_value")),
            _same_check("orders", "m_orders"),
            _same_check("line_items", "m_lines"),
            _same_check("reviews", "m_reviews"),
            f"SELECT 'customer_emails', {money('0')}, {money('0')}, true",
            f"SELECT 'reviewer_emails', {money('0')}, {money('0')}, true",
        ]
    ),
)
_SCANNED = {
    "m_customers": ("customers", ["email", "display_name", "province", "country"]),
    "m_attribution": ("order_attribution", ["traffic_source", "traffic_channel", "device_type", "utm_campaign"]),
    "m_refunds": ("refunds", ["note"]),
    "m_reviews": ("reviews", ["title", "body", "source", "product_title", "product_handle", "reviewer_name"]),
    "m_ads": ("campaign_daily", ["platform", "campaign_name"]),
    "m_notes": ("annotations", ["title", "description", "category", "created_by"]),
    "m_channels": ("channel_daily", ["channel_group", "source", "medium"]),
    "m_sessions": ("sessions_daily", ["referrer_source"]),
    "m_visitors": ("visitors_daily", ["new_vs_returning"]),
    "m_regions": ("region_daily", ["country", "region"]),
    "m_pages": ("landing_pages_daily", ["landing_page"]),
    "m_orders": ("orders", ["order_name"]),
    "m_lines": ("order_line_items", ["sku", "title", "season_code", "line_status"]),
    "m_discounts": ("order_discounts", ["code_or_title", "kind", "description"]),
}
oracle(
    "term_scan",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{out}' AS table_name, '{c}' AS column_name, count(*) AS hits FROM {t} WHERE regexp_matches({c}, '{p.BRAND}', 'i')"
        for t, (out, cols) in _SCANNED.items()
        for c in cols
    )
    + f""" UNION ALL SELECT 'order_attribution', 'referrer_url', count(*) FROM m_attribution
        WHERE regexp_matches('https://' || lower(traffic_source) || '.example.com', '{p.BRAND}', 'i')) WHERE hits > 0""",
)

# --- perturbation ------------------------------------------------------------

_KEPT = "WHERE order_id IN (SELECT order_id FROM kept_orders)"
oracle(
    "drop_orders",
    f"""SELECT 'orders' AS table_name, count(*) AS rows FROM kept_orders
    UNION ALL SELECT 'order_attribution', count(*) FROM m_attribution {_KEPT}
    UNION ALL SELECT 'order_discounts', count(*) FROM m_discounts {_KEPT}
    UNION ALL SELECT 'order_line_items', count(*) FROM m_lines {_KEPT}
    UNION ALL SELECT 'refund_line_items', count(*) FROM m_refund_lines {_KEPT}
    UNION ALL SELECT 'refunds', count(*) FROM m_refunds {_KEPT}
    UNION ALL SELECT 'line_item_discount_allocations', count(*) FROM m_allocations
        WHERE line_item_id IN (SELECT line_item_id FROM m_lines {_KEPT})""",
)
oracle(
    "perturb_lines",
    f"""SELECT order_id, line_item_id, quantity, current_quantity, original_unit_price, discounted_unit_price,
        {unit("discounted_unit_price * current_quantity")} AS net_sales, old_net, times FROM new_lines""",
)
oracle("perturb_refund_lines", "SELECT id, order_id, subtotal FROM new_refund_lines")
oracle(
    "perturb_allocations",
    f"""SELECT id, {follow_price("allocated_amount", "times")} AS allocated_amount
    FROM m_allocations JOIN new_lines USING (line_item_id)""",
)
oracle("rederive_refunds", "SELECT refund_id, order_id, total_refunded, old_total FROM new_refunds")
oracle("rederive_orders", "SELECT * FROM new_orders")
oracle(
    "rederive_discounts",
    f"""SELECT id, {unit(by_ratio("value_amount"))} AS value_amount FROM m_discounts LEFT JOIN ratios USING (order_id)""",
)
oracle(
    "rederive_customers",
    f"""SELECT customer_id, CAST(n AS INTEGER) AS number_of_orders, {money("spent")} AS amount_spent,
        (SELECT min(o.order_id) FROM kept_orders o WHERE o.customer_id = s.customer_id AND o.created_at = f) AS first_order_id,
        f AS first_purchase_at,
        (SELECT max(o.order_id) FROM kept_orders o WHERE o.customer_id = s.customer_id AND o.created_at = l) AS last_order_id,
        l AS last_order_at, least(customer_since, f) AS customer_since
    FROM (SELECT customer_id, count(*) AS n, sum(net_payment) AS spent, min(created_at) AS f, max(created_at) AS l
        FROM kept_orders GROUP BY 1) s JOIN m_customers USING (customer_id)""",
)
oracle(
    "renumber_orders",
    """SELECT order_id, '#' || (10000 + row_number() OVER (ORDER BY created_at, order_id)) AS order_name, created_at
    FROM kept_orders""",
)


def _check(name: str, value: str, ok: str) -> str:
    return f"SELECT '{name}' AS check_name, CAST({value} AS DECIMAL(28,4)) AS value, {ok} AS ok"


def _none(name: str, rows: str, bad: str) -> str:
    """A check that holds when no row is bad."""
    n = f"(SELECT count(*) FILTER ({bad}) FROM {rows})"
    return _check(name, n, f"{n} = 0")


def _line_checks(lines: str, where: str) -> list[str]:
    refunds = f"(SELECT order_id, line_item_id, quantity AS back FROM m_refund_lines {where})"
    return [
        _none("invalid_quantities", f"{lines} {where}", "quantity < 1 OR current_quantity > quantity"),
        _none("refunds_over_line", f"{refunds} JOIN {lines} USING (order_id, line_item_id)", "back > quantity"),
        _none(
            "inconsistent_prices",
            f"{lines} {where}",
            "original_unit_price < 0 OR discounted_unit_price < 0 OR discounted_unit_price > original_unit_price",
        ),
    ]


oracle(
    "perturb_checks",
    " UNION ALL ".join(
        [
            *_line_checks("new_lines", _KEPT),
            _none(
                "negative_money",
                f"new_orders {_KEPT}",
                "total_amount < 0 OR total_paid < 0 OR total_refunded < 0",
            ),
            _check(
                "orders_changed",
                "(SELECT count(*) FROM kept_orders)",
                "(SELECT count(*) FROM kept_orders) <> (SELECT count(*) FROM m_orders)",
            ),
            _check(
                "multi_unit_share",
                f"(SELECT round(count(*) FILTER (quantity > 1)::DOUBLE / count(*), 4) FROM new_lines {_KEPT})",
                f"(SELECT count(*) FILTER (quantity > 1)::DOUBLE / count(*) FROM new_lines {_KEPT}) >= 0.05",
            ),
        ]
    ),
)
oracle(
    "perturb_quantity",
    """SELECT order_id, line_item_id, quantity, current_quantity, unfulfilled_quantity, original_unit_price,
        discounted_unit_price FROM quantity_lines""",
)
_UNITS = "(SELECT sum(quantity) FROM quantity_lines)"
oracle(
    "perturb_quantity_checks",
    " UNION ALL ".join(
        [
            *_line_checks("quantity_lines", ""),
            _check("units_grew", _UNITS, f"{_UNITS} >= 1.05 * (SELECT sum(quantity) FROM m_lines)"),
            _check(
                "net_sales_held",
                ledger_total("quantity_lines"),
                f"abs({ledger_total('quantity_lines')} - {ledger_total('m_lines')}) <= 0.001 * abs({ledger_total('m_lines')})",
            ),
        ]
    ),
)

# --- data quality ------------------------------------------------------------

SOURCE = {
    "customers": "m_customers",
    "orders": "m_orders",
    "order_attribution": "m_attribution",
    "order_discounts": "m_discounts",
    "order_line_items": "m_lines",
    "refund_line_items": "m_refund_lines",
    "refunds": "m_refunds",
    "line_item_discount_allocations": "m_allocations",
    "sessions_daily": "m_sessions",
    "visitors_daily": "m_visitors",
    "channel_daily": "m_channels",
    "device_daily": "m_devices",
    "region_daily": "m_regions",
    "landing_pages_daily": "m_pages",
    "reviews": "m_reviews",
    "campaign_daily": "(SELECT date, platform, campaign_id FROM m_ads GROUP BY 1, 2, 3, campaign_name)",
    "adset_daily": "(SELECT date, platform, adset_id FROM m_ads GROUP BY 1, 2, 3, campaign_id, campaign_name)",
    "ad_daily": "m_ads",
    "adset_meta": "(SELECT DISTINCT platform, adset_id FROM m_ads)",
    "ad_meta": "(SELECT DISTINCT platform, ad_id FROM m_ads)",
    "annotations": "m_notes",
}
TABLES["m_devices"] = f"""
    SELECT d AS session_date, CASE {_KIND} WHEN 'view' THEN 'mobile' WHEN 'click' THEN 'desktop' ELSE 'tablet' END
        AS device_category, count(*) AS sessions FROM ev GROUP BY ALL"""


def _duplicates(table: str, keys: list[str]) -> str:
    cols = ", ".join(keys)
    return f"""SELECT '{table}' AS table_name, '{",".join(keys)}' AS key, count(*) AS duplicate_keys,
        CAST(coalesce(sum(n), 0) AS BIGINT) AS rows
    FROM (SELECT count(*) AS n FROM {SOURCE[table]} GROUP BY {cols} HAVING count(*) > 1)"""


def _orphans(child: str, parent: str, keys: list[str], parent_keys: list[str]) -> str:
    match = " AND ".join(f"par.{b} = c.{a}" for a, b in zip(keys, parent_keys, strict=True))
    cols = ", ".join(f"c.{k}" for k in keys)
    return f"""SELECT '{child}' AS child, '{parent}' AS parent, '{",".join(keys)}' AS key, count(*) AS orphan_keys,
        CAST(coalesce(sum(n), 0) AS BIGINT) AS rows
    FROM (SELECT count(*) AS n FROM {SOURCE[child]} c WHERE {" AND ".join(f"c.{k} IS NOT NULL" for k in keys)}
        AND NOT EXISTS (SELECT 1 FROM {SOURCE[parent]} par WHERE {match}) GROUP BY {cols})"""


oracle("check_keys", " UNION ALL ".join(_duplicates(t, k) for t, keys in KEYS.items() for k in keys))
oracle("check_references", " UNION ALL ".join(_orphans(*r) for r in REFERENCES))
oracle(
    "check_domains",
    """SELECT * FROM (SELECT 'annotation_requests' AS table_name, 'date not null' AS rule, count(*) FILTER (date IS NULL) AS violations
        FROM note_requests
    UNION ALL SELECT 'annotation_requests', 'title not empty', count(*) FILTER (title = '') FROM note_requests
    UNION ALL SELECT 'annotation_requests', 'category known', count(*) FILTER (category = 'party') FROM note_requests)
    WHERE violations > 0""",
)
oracle(
    "check_metric_bounds",
    f"""SELECT 'net_sales' AS metric, count(*) AS violations, CAST(min(net) AS DOUBLE) AS lowest, CAST(max(net) AS DOUBLE) AS highest
    FROM (SELECT sum(amount) AS net FROM m_ledger WHERE {between("date_key", p.SUMMARY)} GROUP BY date_key) WHERE net < 0
    HAVING count(*) > 0
    UNION ALL SELECT 'total_qty', count(*), CAST(min(q) AS DOUBLE), CAST(max(q) AS DOUBLE)
    FROM (SELECT sum(quantity) AS q FROM m_ledger WHERE {between("date_key", p.SUMMARY)} GROUP BY date_key) WHERE q < 0
    HAVING count(*) > 0""",
)
