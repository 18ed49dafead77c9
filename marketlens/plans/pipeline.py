"""Pipeline tables: enriched orders (p07), order totals (p08), monthly sales
(p09), customer features (p10), load verification (p18) and integrity
checks (p19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import cond_count, days_ratio, money, money_ratio, ratio_round, tenths
from ..functions.exact import sql_cents as C
from ..functions.exact import sql_days_ratio as RD
from ..functions.exact import sql_money_ratio as RM
from ..functions.exact import sql_ratio_round as R
from ..functions.exact import sql_tenths as T
from ..operators.grain import item_totals, payment_totals
from ..oracle.adapter_sql import with_star
from ..session import scratch_path
from ..sources.adapter import Star
from .registry import report


@report("p07_orders_enriched", with_star("SELECT * FROM orders_en ORDER BY order_id"))
def p07(st: Star) -> DataFrame:
    return st.orders


ORDER_TOTALS_SQL = f"""pay_o AS (
    SELECT order_id, sum(payment_value) AS pay_sum, CAST(sum({C('payment_value')}) AS BIGINT) AS pay_c,
        count(*) AS pay_rows FROM payments GROUP BY order_id
),
item_o AS (
    SELECT order_id, count(*) AS item_rows, sum(price) AS price_sum, sum(freight_value) AS freight_sum
    FROM order_items GROUP BY order_id
),
order_totals AS (
    SELECT o.order_id, o.order_status, o.year_month,
        CAST(p.pay_sum AS DOUBLE) AS total_payment, p.pay_c AS total_payment_cents,
        coalesce(p.pay_rows, 0) AS payment_count,
        coalesce(i.item_rows, 0) AS item_count,
        CAST(i.price_sum AS DOUBLE) AS items_total, CAST(i.freight_sum AS DOUBLE) AS freight_total,
        CAST(o.delivery_duration_days AS DOUBLE) AS delivery_duration_days,
        o.is_late, r.review_score
    FROM orders_en o LEFT JOIN pay_o p ON o.order_id = p.order_id
    LEFT JOIN item_o i ON o.order_id = i.order_id
    LEFT JOIN reviews r ON o.order_id = r.order_id
)"""


def order_totals(st: Star) -> DataFrame:
    """One row per order with payment, item and delivery totals (u2 grain)."""
    o = st.orders.select("order_id", "order_status", "year_month", "delivery_duration_days", "is_late")
    j = (
        o.join(payment_totals(st), "order_id", "left")
        .join(item_totals(st), "order_id", "left")
        .join(st.reviews.select("order_id", "review_score"), "order_id", "left")
    )
    return j.select(
        "order_id",
        "order_status",
        "year_month",
        money("pay_sum").alias("total_payment"),
        F.col("pay_cents").cast("bigint").alias("total_payment_cents"),
        F.coalesce(F.col("pay_rows"), F.lit(0)).cast("bigint").alias("payment_count"),
        F.coalesce(F.col("item_rows"), F.lit(0)).cast("bigint").alias("item_count"),
        money("price_sum").alias("items_total"),
        money("freight_sum").alias("freight_total"),
        F.col("delivery_duration_days").cast("double").alias("delivery_duration_days"),
        "is_late",
        "review_score",
    )


@report("p08_order_totals", with_star("SELECT * FROM order_totals", ORDER_TOTALS_SQL))
def p08(st: Star) -> DataFrame:
    return order_totals(st)


MONTHLY_SALES_SQL = (
    ORDER_TOTALS_SQL
    + f""",
monthly_sales AS (
    SELECT year_month, row_number() OVER (ORDER BY year_month) AS month_number,
        count(*) AS order_count, CAST(sum(total_payment_cents) AS DOUBLE) / 100 AS revenue,
        {RM('sum(total_payment_cents)', 'count(total_payment_cents)', 2)} AS avg_order_value,
        {R('sum(review_score)', 'count(review_score)', 2)} AS avg_review_score,
        {RD('sum(CAST(delivery_duration_days * 10 AS BIGINT))', 'count(delivery_duration_days)', 1)} AS avg_delivery_days,
        CAST(sum(CASE WHEN is_late THEN 1 ELSE 0 END) AS BIGINT) AS late_order_count
    FROM order_totals WHERE order_status = 'delivered' AND year_month IS NOT NULL
    GROUP BY year_month
)"""
)


def monthly_sales(st: Star) -> DataFrame:
    ot = order_totals(st).filter((F.col("order_status") == "delivered") & F.col("year_month").isNotNull())
    g = ot.groupBy("year_month").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum("total_payment_cents").alias("_c"),
        F.count("total_payment_cents").alias("_cn"),
        F.sum("review_score").alias("_r"),
        F.count("review_score").alias("_rn"),
        F.sum((F.col("delivery_duration_days") * 10).cast("bigint")).alias("_d"),
        F.count("delivery_duration_days").alias("_dn"),
        cond_count(F.col("is_late")).alias("late_order_count"),
    )
    # Month grain (bounded by the calendar): a plain ordered window.
    return g.select(
        "year_month",
        F.row_number().over(Window.orderBy("year_month")).cast("bigint").alias("month_number"),
        "order_count",
        (F.col("_c").cast("double") / 100).alias("revenue"),
        money_ratio("_c", "_cn", 2).alias("avg_order_value"),
        ratio_round("_r", "_rn", 2).alias("avg_review_score"),
        days_ratio("_d", "_dn", 1).alias("avg_delivery_days"),
        "late_order_count",
    )


@report("p09_monthly_sales", with_star("SELECT * FROM monthly_sales", MONTHLY_SALES_SQL))
def p09(st: Star) -> DataFrame:
    return monthly_sales(st).orderBy("year_month")


CUSTOMER_FEATURES_SQL = f"""customer_features AS (
    SELECT c.customer_unique_id,
        CAST(datediff('day', CAST(max(o.order_purchase_timestamp) AS DATE),
            CAST((SELECT max(order_purchase_timestamp) FROM orders_en WHERE order_status = 'delivered') AS DATE))
            AS BIGINT) AS recency_days,
        count(DISTINCT o.order_id) AS frequency,
        CAST(sum(p.payment_value) AS DOUBLE) AS monetary,
        CAST(sum({C('p.payment_value')}) AS BIGINT) AS monetary_cents,
        count(DISTINCT o.order_id) > 1 AS is_repeat_customer
    FROM customers c JOIN orders_en o ON c.customer_id = o.customer_id
    JOIN payments p ON o.order_id = p.order_id
    WHERE o.order_status = 'delivered'
    GROUP BY c.customer_unique_id
)"""


def customer_features(st: Star) -> DataFrame:
    from .advanced import rfm_base

    b = rfm_base(st)
    return b.select(
        "customer_unique_id",
        "recency_days",
        "frequency",
        money("monetary").alias("monetary"),
        F.col("monetary_c").alias("monetary_cents"),
        (F.col("frequency") > 1).alias("is_repeat_customer"),
    )


@report("p10_customer_features", with_star("SELECT * FROM customer_features", CUSTOMER_FEATURES_SQL))
def p10(st: Star) -> DataFrame:
    return customer_features(st)


# ---------------------------------------------------------------- p18 / p19

STAR_TABLES = ("customers", "products", "sellers", "orders", "order_items", "payments", "reviews")


def star_frames(st: Star) -> dict[str, DataFrame]:
    return {name: getattr(st, name) for name in STAR_TABLES}


@report(
    "p18_load_verify",
    with_star(
        "\nUNION ALL\n".join(
            f"SELECT '{t}' AS table_name, {i + 1} AS load_order, count(*) AS expected_count, count(*) AS row_count, true AS ok FROM {'orders_en' if t == 'orders' else t}"
            for i, t in enumerate(STAR_TABLES)
        )
    ),
    note="a new version of the tables is written in FK order below the shared checkpoint folder, verified and published",
)
def p18(st: Star) -> DataFrame:
    from ..sources.versions import load_version

    return load_version(st, scratch_path(st.spark, "star"))


# (check, table, violating rows) — FK orphans, duplicate keys, NULLs in NOT NULL columns.
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("reviews", "order_id", "orders", "order_id"),
]
PRIMARY_KEYS = {
    "customers": ["customer_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "payments": ["order_id", "payment_sequential"],
    "reviews": ["review_id"],
}
NOT_NULL = {
    "customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"],
    "products": ["product_id"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_estimated_delivery_date"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"],
    "payments": ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"],
    "reviews": ["review_id", "order_id", "review_score"],
}


def _sql_name(t: str) -> str:
    return "orders_en" if t == "orders" else t


def _integrity_sql() -> str:
    parts = []
    for child, ck, parent, pk in FOREIGN_KEYS:
        parts.append(
            f"SELECT 'orphan {child}.{ck} -> {parent}' AS check_name, '{child}' AS table_name, count(*) AS violations "
            f"FROM {_sql_name(child)} x WHERE NOT EXISTS (SELECT 1 FROM {_sql_name(parent)} y WHERE y.{pk} = x.{ck})"
        )
    for t, keys in PRIMARY_KEYS.items():
        k = ", ".join(keys)
        parts.append(
            f"SELECT 'duplicate key {t}({k})', '{t}', coalesce(sum(n - 1), 0)::BIGINT "
            f"FROM (SELECT count(*) AS n FROM {_sql_name(t)} GROUP BY {k} HAVING count(*) > 1) d"
        )
    for t, cols in NOT_NULL.items():
        cond = " OR ".join(f"{c} IS NULL" for c in cols)
        parts.append(f"SELECT 'null required column {t}', '{t}', count(*) FROM {_sql_name(t)} WHERE {cond}")
    return with_star("\nUNION ALL\n".join(parts))


#: For every foreign key its place among those that name the same parent.
REFERENCE_SLOTS = [[p for _, _, p, _ in FOREIGN_KEYS[:i]].count(parent) + 1 for i, (_, _, parent, _) in enumerate(FOREIGN_KEYS)]
#: A number for every table, which takes less of a grouping's memory than its name.
DOMAINS = {t: i for i, t in enumerate(PRIMARY_KEYS)}


def key_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """(domain, k1, k2, kind, missing): a row for every primary key and every
    reference of every table.  Kind 0 is the key itself, kind i > 0 the i-th of
    FOREIGN_KEYS that name the domain's table; a reference lies in the domain of
    the table that it names, a key that only its own table has is a domain of its
    own."""
    named = {parent: pk for _, _, parent, pk in FOREIGN_KEYS}
    tables = []
    for t, keys in PRIMARY_KEYS.items():
        text = lambda c: F.col(c).cast("string")
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in NOT_NULL[t]])
        entry = lambda domain, k1, k2, kind, gone: F.struct(F.lit(DOMAINS[domain]).alias("domain"), k1.alias("k1"), k2.alias("k2"), F.lit(kind).alias("kind"), gone.cast("int").alias("missing"))
        none = F.lit(None).cast("string")
        entries = [entry(t, text(keys[0]), text(keys[1]) if len(keys) > 1 else none, 0, missing)]
        for (child, ck, parent, _), slot in zip(FOREIGN_KEYS, REFERENCE_SLOTS):
            if child == t:
                entries.append(entry(parent, text(ck), none, slot, F.lit(False)))
        assert t not in named or keys == [named[t]]
        tables.append(frames[t].select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    return reduce(DataFrame.unionByName, tables)


def integrity(frames: dict[str, DataFrame]) -> DataFrame:
    """check_name, table_name, violations.  Keys and the references to them are
    united and grouped once; tasks count before they shuffle, so a parent with a
    third of all children is a row a task."""
    refs = range(1, len(FOREIGN_KEYS) + 1)
    per_key = key_rows(frames).groupBy("domain", "k1", "k2").agg(
        cond_count(F.col("kind") == 0).alias("own"),
        F.sum("missing").alias("missing"),
        *[cond_count(F.col("kind") == s).alias(f"s{s}") for s in range(1, max(REFERENCE_SLOTS) + 1)],
    )
    # a missing reference names no parent, not even one whose key is missing
    lost = (F.col("own") == 0) | F.col("k1").isNull()
    of = lambda t: F.col("domain") == DOMAINS[t]
    own = lambda t: F.when(of(t), F.col("own"))
    whole = per_key.agg(
        *[F.sum(F.when(lost & of(parent), F.col(f"s{s}"))).alias(f"r{i}") for i, (_, _, parent, _), s in zip(refs, FOREIGN_KEYS, REFERENCE_SLOTS)],
        *[F.sum(F.greatest(own(t) - 1, F.lit(0))).alias(f"d_{t}") for t in PRIMARY_KEYS],
        *[F.sum(F.when(of(t), F.col("missing"))).alias(f"m_{t}") for t in PRIMARY_KEYS],
    )
    check = lambda name, t, c: F.struct(F.lit(name).alias("check_name"), F.lit(t).alias("table_name"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("violations"))
    checks = [check(f"orphan {child}.{ck} -> {parent}", child, f"r{i}") for i, (child, ck, parent, _) in zip(refs, FOREIGN_KEYS)]
    checks += [check(f"duplicate key {t}({', '.join(keys)})", t, f"d_{t}") for t, keys in PRIMARY_KEYS.items()]
    checks += [check(f"null required column {t}", t, f"m_{t}") for t in PRIMARY_KEYS]
    return whole.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


@report("p19_integrity_check", _integrity_sql())
def p19(st: Star) -> DataFrame:
    return integrity(star_frames(st))
