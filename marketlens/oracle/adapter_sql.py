"""The star-schema mapping of ``sources/adapter.py`` written as DuckDB CTEs.

Every oracle query is ``WITH <STAR_CTES>[, more CTEs] SELECT …`` over the
driver's pre-registered views.  CTE names: customers, products, sellers,
orders_en (enriched orders), order_items, payments, reviews.
"""

from __future__ import annotations

from ..functions.exact import sql_cents, sql_tenths


def _tenths(start: str, end: str) -> str:
    s = f"date_diff('second', {start}, {end})"
    return f"CAST(sign({s}) * ((abs({s}) * 20 + 86400) // 172800) * 0.1 AS DECIMAL(6,1))"


_ORDERS_BASE = """
orders_b AS (
    SELECT o_orderkey AS k, o_custkey,
        CASE WHEN o_orderstatus IN ('F', 'P') THEN 'delivered'
             WHEN o_orderkey % 5 = 0 THEN 'shipped'
             WHEN o_orderkey % 5 = 1 THEN 'canceled'
             WHEN o_orderkey % 5 = 2 THEN 'invoiced'
             WHEN o_orderkey % 5 = 3 THEN 'processing'
             ELSE 'unavailable' END AS order_status,
        o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT))
                    + to_minutes(CAST((o_orderkey * 7) % 60 AS BIGINT)) AS order_purchase_timestamp
    FROM orders
),
orders_c AS (
    SELECT CAST(k AS VARCHAR) AS order_id,
        'c' || CAST(k AS VARCHAR) AS customer_id,
        order_status,
        order_purchase_timestamp,
        order_purchase_timestamp + to_hours(CAST(k % 3 AS BIGINT)) AS order_approved_at,
        CASE WHEN order_status IN ('delivered', 'shipped')
             THEN order_purchase_timestamp + to_days(CAST(1 + k % 5 AS BIGINT)) + to_hours(CAST(k % 7 AS BIGINT))
        END AS order_delivered_carrier_date,
        CASE WHEN order_status = 'delivered' AND k % 1201 <> 0
             THEN order_purchase_timestamp
                  + to_days(CAST(3 + (k * 13) % 29 + CASE WHEN k % 97 = 0 THEN 30 ELSE 0 END AS BIGINT))
                  + to_hours(CAST(k % 11 AS BIGINT))
        END AS order_delivered_customer_date,
        CAST(CAST(order_purchase_timestamp AS DATE) AS TIMESTAMP) + to_days(CAST(20 + k % 13 AS BIGINT))
            AS order_estimated_delivery_date,
        CAST(year(order_purchase_timestamp) AS INTEGER) AS purchase_year,
        CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month,
        CAST(day(order_purchase_timestamp) AS INTEGER) AS purchase_day,
        CAST(isodow(order_purchase_timestamp) - 1 AS INTEGER) AS purchase_weekday,
        CAST(hour(order_purchase_timestamp) AS INTEGER) AS purchase_hour,
        strftime(order_purchase_timestamp, '%Y-%m') AS year_month
    FROM orders_b
),
"""

_ORDERS_EN = f"""
orders_en AS (
    SELECT *,
        {_tenths('order_purchase_timestamp', 'order_delivered_customer_date')} AS delivery_duration_days,
        {_tenths('order_purchase_timestamp', 'order_estimated_delivery_date')} AS estimated_delivery_days,
        {_tenths('order_estimated_delivery_date', 'order_delivered_customer_date')} AS delivery_delay_days,
        order_delivered_customer_date > order_estimated_delivery_date AS is_late,
        {_tenths('order_purchase_timestamp', 'order_delivered_carrier_date')} AS carrier_handling_days
    FROM orders_c
),
"""

_DIMS = """
customers AS (
    SELECT 'c' || CAST(o.o_orderkey AS VARCHAR) AS customer_id,
        CAST(o.o_custkey AS VARCHAR) AS customer_unique_id,
        lpad(CAST(o.o_custkey % 99991 AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
        'city_' || CAST(o.o_custkey % 40 AS VARCHAR) AS customer_city,
        n.n_name AS customer_state
    FROM orders o
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
),
products AS (
    SELECT CAST(p_partkey AS VARCHAR) AS product_id,
        CASE WHEN p_partkey % 54 <> 0 THEN p_name END AS product_category_name,
        CASE WHEN p_partkey % 54 <> 0 AND p_name NOT IN ('red bolt', 'cold ring')
             THEN replace(p_name, ' ', '_') END AS product_category_name_english,
        CASE WHEN p_partkey % 54 <> 0 THEN CAST(20 + p_partkey % 40 AS SMALLINT) END AS product_name_lenght,
        CASE WHEN p_partkey % 54 <> 0 THEN CAST(100 + (p_partkey * 7) % 900 AS INTEGER) END
            AS product_description_lenght,
        CASE WHEN p_partkey % 54 <> 0 THEN CAST(1 + p_partkey % 6 AS TINYINT) END AS product_photos_qty,
        CASE WHEN p_partkey % 54 <> 0 THEN CAST(p_size * 25 AS DECIMAL(8,2)) END AS product_weight_g,
        CASE WHEN p_partkey % 54 <> 0 THEN CAST(10 + p_partkey % 50 AS DECIMAL(6,2)) END AS product_length_cm,
        CASE WHEN p_partkey % 54 <> 0 THEN CAST(2 + p_partkey % 30 AS DECIMAL(6,2)) END AS product_height_cm,
        CASE WHEN p_partkey % 54 <> 0 THEN CAST(8 + p_partkey % 40 AS DECIMAL(6,2)) END AS product_width_cm,
        p_partkey % 54 = 0 AS is_incomplete
    FROM part
),
sellers AS (
    SELECT CAST(s.s_suppkey AS VARCHAR) AS seller_id,
        lpad(CAST(s.s_suppkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
        'city_' || CAST(s.s_suppkey % 40 AS VARCHAR) AS seller_city,
        n.n_name AS seller_state
    FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
),
"""

_FACTS = """
order_items AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 1024,
            l_linenumber, l_partkey, l_suppkey,
            l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus)
            AS order_item_id,
        CAST(l_partkey AS VARCHAR) AS product_id,
        CAST(l_suppkey AS VARCHAR) AS seller_id,
        l_shipdate AS shipping_limit_date,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(10,2)) AS price,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(2,2)) * CAST(l_tax AS DECIMAL(3,2))
             AS DECIMAL(10,2)) AS freight_value
    FROM lineitem
),
pay_b AS (
    SELECT o_orderkey AS k,
        CASE WHEN o_orderkey % 5000 = 7 THEN 'not_defined'
             WHEN o_orderpriority = '3-MEDIUM' THEN 'boleto'
             WHEN o_orderpriority = '5-LOW' THEN 'debit_card'
             ELSE 'credit_card' END AS ptype,
        CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.002 AS DECIMAL(3,3)) AS DECIMAL(10,2)) AS tot,
        o_orderkey % 20 = 0 AS split
    FROM orders
),
pay_v AS (
    SELECT *, CAST(tot * CAST(0.3 AS DECIMAL(1,1)) AS DECIMAL(10,2)) AS voucher FROM pay_b
),
payments AS (
    SELECT CAST(k AS VARCHAR) AS order_id, 1 AS payment_sequential, ptype AS payment_type,
        CAST(CASE WHEN ptype = 'credit_card' THEN 1 + k % 10 ELSE 1 END AS INTEGER) AS payment_installments,
        CASE WHEN split THEN CAST(tot - voucher AS DECIMAL(10,2)) ELSE tot END AS payment_value
    FROM pay_v
    UNION ALL
    SELECT CAST(k AS VARCHAR), 2, 'voucher', 1, voucher FROM pay_v WHERE split
),
reviews AS (
    SELECT 'r' || order_id AS review_id,
        order_id,
        CAST(CASE WHEN coalesce(is_late, false) THEN 1 + CAST(order_id AS BIGINT) % 3
                  ELSE 3 + CAST(order_id AS BIGINT) % 3 END AS INTEGER) AS review_score,
        CASE WHEN CAST(order_id AS BIGINT) % 4 = 0 THEN 'title ' || order_id END AS review_comment_title,
        NULLIF(CASE WHEN CAST(order_id AS BIGINT) % 3 = 0 THEN ''
                    WHEN CAST(order_id AS BIGINT) % 7 = 0 THEN 'comment ' || order_id || chr(10) || '"quoted"'
                    ELSE 'comment ' || order_id END, '')
            AS review_comment_message,
        CAST(CAST(coalesce(order_delivered_customer_date, order_estimated_delivery_date) AS DATE) AS TIMESTAMP)
            + to_days(1) AS review_creation_date,
        CAST(CAST(coalesce(order_delivered_customer_date, order_estimated_delivery_date) AS DATE) AS TIMESTAMP)
            + to_days(1) + to_hours(CAST(CAST(order_id AS BIGINT) % 48 AS BIGINT)) AS review_answer_timestamp
    FROM orders_en
)"""

STAR_CTES = (_ORDERS_BASE + _ORDERS_EN + _DIMS + _FACTS).strip()


def with_star(body: str, ctes: str = "", recursive: bool = False) -> str:
    """Wrap a report: ``WITH [RECURSIVE] <star>, <ctes> <body>``."""
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{STAR_CTES}{extra}\n{body.strip()}"


#: One row per delivered order, with its buyer, payments, items and reviews
#: already added up.  Reports that are defined on joined rows weight these
#: figures by how many rows the other tables hold for the order.
ORDER_GRAIN = f"""per_payment AS (
    SELECT order_id, count(*) AS pay_n, CAST(sum({sql_cents('payment_value')}) AS BIGINT) AS pay_c,
        CAST(sum(DISTINCT {sql_cents('payment_value')}) AS BIGINT) AS pay_distinct_c,
        max(payment_type) AS pay_type, max(payment_installments) AS pay_months
    FROM payments GROUP BY order_id
),
per_items AS (
    SELECT order_id, count(*) AS item_n, CAST(sum({sql_cents('price')}) AS BIGINT) AS price_c,
        CAST(sum({sql_cents('freight_value')}) AS BIGINT) AS freight_c
    FROM order_items GROUP BY order_id
),
per_review AS (
    SELECT order_id, count(*) AS review_n, count(review_score) AS score_n, CAST(sum(review_score) AS BIGINT) AS score_s,
        max(review_score) AS score
    FROM reviews GROUP BY order_id
),
grain AS (
    SELECT e.*, b.customer_unique_id AS buyer, b.customer_state AS state,
        {sql_tenths('e.delivery_duration_days')} AS days_t, {sql_tenths('e.delivery_delay_days')} AS delay_t,
        pay_n, pay_c, pay_distinct_c, pay_type, pay_months, item_n, price_c, freight_c,
        coalesce(review_n, 1) AS review_w, coalesce(score_n, 0) AS score_n, score_s, score,
        coalesce(review_n, 0) AS review_n
    FROM (SELECT * FROM orders_en WHERE order_status = 'delivered') e
    JOIN customers b USING (customer_id)
    LEFT JOIN per_payment USING (order_id)
    LEFT JOIN per_items USING (order_id)
    LEFT JOIN per_review USING (order_id)
)"""
