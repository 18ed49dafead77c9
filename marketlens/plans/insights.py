"""Rule-based insights report (p17, s11).

A one-row metrics DataFrame (every metric an exact integer: counts, cents,
tenths, hundredths) is combined with a fixed rule table; each rule has a
condition and a text template, and the rules are evaluated in one projection
(array of structs → explode → filter), so the metrics are computed once.
Numbers are rendered from integers, never from binary floating point.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import cents, cond_count, ratio_round, tenths
from ..functions.exact import sql_cents as C
from ..functions.exact import sql_ratio_round as R
from ..functions.exact import sql_tenths as T
from ..operators.scalars import one_row
from ..oracle.adapter_sql import with_star
from ..session import scratch_path
from ..sources.adapter import Star
from ..sources.outputs import read_insights_report, write_insights_report
from .advanced import CATEGORY_REVENUE_SQL, category_revenue
from .basic import delivered_items
from .pipeline import CUSTOMER_FEATURES_SQL, ORDER_TOTALS_SQL, customer_features, order_totals
from .registry import report

METHODOLOGY = "Rule-based summary of exact aggregates over delivered orders; thresholds are fixed."


def _int(c: Column) -> Column:
    return c.cast("bigint")


def metrics(st: Star) -> DataFrame:
    ot = order_totals(st).filter((F.col("order_status") == "delivered") & F.col("total_payment_cents").isNotNull())
    sales = ot.agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("total_payment_cents").alias("revenue_c"),
        _int(ratio_round(F.sum("total_payment_cents"), F.count(F.lit(1)), 0)).alias("aov_c"),
    )
    months = st.delivered().agg(F.min("year_month").alias("first_month"), F.max("year_month").alias("last_month"))
    by_month = ot.groupBy("year_month").agg(F.sum("total_payment_cents").alias("c"))
    peak = by_month.agg(F.min(F.struct((-F.col("c")).alias("neg"), "year_month")).alias("p")).select(
        F.col("p.year_month").alias("peak_month"), (-F.col("p.neg")).alias("peak_c")
    )
    cat = category_revenue(st).agg(F.min(F.struct((-F.col("rev_c")).alias("neg"), "category")).alias("p")).select(
        F.col("p.category").alias("top_category"), (-F.col("p.neg")).alias("top_category_c")
    )
    cust = customer_features(st).agg(
        _int(ratio_round(cond_count(F.col("is_repeat_customer")) * 1000, F.count(F.lit(1)), 0)).alias("repeat_t")
    )
    d = st.delivered()
    dd = d.filter(F.col("delivery_duration_days").isNotNull())
    deliv = dd.agg(
        _int(ratio_round(cond_count(F.col("is_late")) * 1000, F.count(F.lit(1)), 0)).alias("late_t"),
        _int(ratio_round(F.sum(tenths("delivery_duration_days")), F.count(F.lit(1)), 0)).alias("avg_days_t"),
    )
    early = d.agg(_int(ratio_round(-F.sum(tenths("delivery_delay_days")), F.count("delivery_delay_days"), 0)).alias("early_t"))
    rv = st.reviews.agg(
        _int(ratio_round(F.sum("review_score") * 100, F.count("review_score"), 0)).alias("review_h"),
        _int(ratio_round(cond_count(F.col("review_score") == 5) * 1000, F.count(F.lit(1)), 0)).alias("five_t"),
    )
    fr = delivered_items(st).agg(
        _int(ratio_round(F.sum(cents("freight_value")) * 1000, F.sum(cents("price")), 0)).alias("freight_t")
    )
    p = st.payments
    cc = (
        one_row(
            p.filter(F.col("payment_type") == "credit_card").select("order_id").distinct().agg(F.count(F.lit(1)).alias("_cc")),
            p.select("order_id").distinct().agg(F.count(F.lit(1)).alias("_all")),
        )
        .select(_int(ratio_round(F.col("_cc") * 1000, F.col("_all"), 0)).alias("cc_t"))
    )
    return one_row(sales, months, peak, cat, cust, deliv, early, rv, fr, cc)  # all 1-row frames


def _money(c: str) -> Column:
    x = F.col(c)
    return F.concat(F.call_function("div", x, F.lit(100)).cast("string"), F.lit("."), F.lpad((x % 100).cast("string"), 2, "0"))


def _tenths_txt(c: str) -> Column:
    x = F.col(c)
    a = F.abs(x)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.call_function("div", a, F.lit(10)).cast("string"), F.lit("."), (a % 10).cast("string"))


def _hundredths_txt(c: str) -> Column:
    x = F.col(c)
    return F.concat(F.call_function("div", x, F.lit(100)).cast("string"), F.lit("."), F.lpad((x % 100).cast("string"), 2, "0"))


def _lit(s: str) -> Column:
    return F.lit(s)


def rules() -> list[tuple[str, int, Column, Column]]:
    # (section, order, condition, text) — fixed report wording and thresholds.
    true = F.lit(True)
    return [
        ("executive_summary", 1, true, F.concat(
            F.col("n_orders").cast("string"), _lit(" delivered orders worth R$ "), _money("revenue_c"),
            _lit(" between "), F.col("first_month"), _lit(" and "), F.col("last_month"),
            _lit("; average order value R$ "), _money("aov_c"), _lit("."))),
        ("key_trends", 1, true, F.concat(_lit("Revenue peaked in "), F.col("peak_month"), _lit(" at R$ "), _money("peak_c"), _lit("."))),
        ("customer_insights", 1, true, F.concat(_tenths_txt("repeat_t"), _lit("% of customers ordered more than once."))),
        ("customer_insights", 2, true, F.concat(_lit("Credit card pays for "), _tenths_txt("cc_t"), _lit("% of orders."))),
        ("product_insights", 1, true, F.concat(_lit("Top category by item revenue: "), F.col("top_category"),
                                               _lit(" (R$ "), _money("top_category_c"), _lit(")."))),
        ("product_insights", 2, true, F.concat(_lit("Freight averages "), _tenths_txt("freight_t"), _lit("% of item price."))),
        ("delivery_insights", 1, true, F.concat(_lit("Delivery takes "), _tenths_txt("avg_days_t"), _lit(" days on average; "),
                                                _tenths_txt("late_t"), _lit("% of orders arrive late."))),
        ("delivery_insights", 2, true, F.concat(_lit("Orders arrive "), _tenths_txt("early_t"), _lit(" days before the estimate on average."))),
        ("review_insights", 1, true, F.concat(_lit("Average review score "), _hundredths_txt("review_h"), _lit(" with "),
                                              _tenths_txt("five_t"), _lit("% five-star reviews."))),
        ("potential_issues", 1, F.col("late_t") > 100, _lit("Late deliveries exceed 10% of delivered orders.")),
        ("potential_issues", 2, F.col("repeat_t") < 100, _lit("Fewer than 10% of customers come back for a second order.")),
        ("potential_issues", 3, F.col("freight_t") > 150, _lit("Freight costs exceed 15% of item price.")),
        ("suggested_actions", 1, F.col("late_t") > 100, _lit("Review carrier performance on the slowest routes.")),
        ("suggested_actions", 2, F.col("repeat_t") < 100, _lit("Target one-time buyers with a second-purchase campaign.")),
        ("suggested_actions", 3, F.col("freight_t") > 150, _lit("Negotiate freight rates or set free-shipping thresholds.")),
    ]


def insights(st: Star) -> DataFrame:
    m = metrics(st)
    items = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(o).alias("ord"), c.alias("keep"), t.alias("text"))
        for s, o, c, t in rules()
    ])
    return m.select(F.explode(items).alias("r")).filter("r.keep").select("r.section", "r.ord", "r.text")


# ---------------------------------------------------------------- oracle

_METRICS_SQL = (
    ORDER_TOTALS_SQL
    + ",\n"
    + CUSTOMER_FEATURES_SQL
    + ",\n"
    + CATEGORY_REVENUE_SQL
    + f""",
ot_d AS (SELECT * FROM order_totals WHERE order_status = 'delivered' AND total_payment_cents IS NOT NULL),
m AS (
    SELECT
        (SELECT count(*) FROM ot_d) AS n_orders,
        (SELECT CAST(sum(total_payment_cents) AS BIGINT) FROM ot_d) AS revenue_c,
        (SELECT CAST({R('sum(total_payment_cents)', 'count(*)', 0)} AS BIGINT) FROM ot_d) AS aov_c,
        (SELECT min(year_month) FROM orders_en WHERE order_status = 'delivered') AS first_month,
        (SELECT max(year_month) FROM orders_en WHERE order_status = 'delivered') AS last_month,
        (SELECT year_month FROM (SELECT year_month, sum(total_payment_cents) AS c FROM ot_d GROUP BY year_month)
            ORDER BY c DESC, year_month LIMIT 1) AS peak_month,
        (SELECT CAST(max(c) AS BIGINT) FROM (SELECT sum(total_payment_cents) AS c FROM ot_d GROUP BY year_month)) AS peak_c,
        (SELECT category FROM cat_rev ORDER BY rev_c DESC, category LIMIT 1) AS top_category,
        (SELECT max(rev_c) FROM cat_rev) AS top_category_c,
        (SELECT CAST({R('sum(CASE WHEN is_repeat_customer THEN 1 ELSE 0 END) * 1000', 'count(*)', 0)} AS BIGINT)
            FROM customer_features) AS repeat_t,
        (SELECT CAST({R('sum(CASE WHEN is_late THEN 1 ELSE 0 END) * 1000', 'count(*)', 0)} AS BIGINT) FROM orders_en
            WHERE order_status = 'delivered' AND delivery_duration_days IS NOT NULL) AS late_t,
        (SELECT CAST({R(f"sum({T('delivery_duration_days')})", 'count(*)', 0)} AS BIGINT) FROM orders_en
            WHERE order_status = 'delivered' AND delivery_duration_days IS NOT NULL) AS avg_days_t,
        (SELECT CAST({R(f"-sum({T('delivery_delay_days')})", 'count(delivery_delay_days)', 0)} AS BIGINT) FROM orders_en
            WHERE order_status = 'delivered') AS early_t,
        (SELECT CAST({R('sum(review_score) * 100', 'count(review_score)', 0)} AS BIGINT) FROM reviews) AS review_h,
        (SELECT CAST({R('sum(CASE WHEN review_score = 5 THEN 1 ELSE 0 END) * 1000', 'count(*)', 0)} AS BIGINT)
            FROM reviews) AS five_t,
        (SELECT CAST({R(f"sum({C('oi.freight_value')}) * 1000", f"sum({C('oi.price')})", 0)} AS BIGINT)
            FROM order_items oi JOIN orders_en o ON oi.order_id = o.order_id WHERE o.order_status = 'delivered') AS freight_t,
        (SELECT CAST({R("(SELECT count(DISTINCT order_id) FROM payments WHERE payment_type = 'credit_card') * 1000", '(SELECT count(DISTINCT order_id) FROM payments)', 0)} AS BIGINT)) AS cc_t
)"""
)


def _sm(c: str) -> str:
    return f"(CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def _st(c: str) -> str:
    return f"((CASE WHEN {c} < 0 THEN '-' ELSE '' END) || CAST(abs({c}) // 10 AS VARCHAR) || '.' || CAST(abs({c}) % 10 AS VARCHAR))"


def _sh(c: str) -> str:
    return f"(CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


_RULES_SQL = [
    ("executive_summary", 1, "true", f"CAST(n_orders AS VARCHAR) || ' delivered orders worth R$ ' || {_sm('revenue_c')} || ' between ' || first_month || ' and ' || last_month || '; average order value R$ ' || {_sm('aov_c')} || '.'"),
    ("key_trends", 1, "true", f"'Revenue peaked in ' || peak_month || ' at R$ ' || {_sm('peak_c')} || '.'"),
    ("customer_insights", 1, "true", f"{_st('repeat_t')} || '% of customers ordered more than once.'"),
    ("customer_insights", 2, "true", f"'Credit card pays for ' || {_st('cc_t')} || '% of orders.'"),
    ("product_insights", 1, "true", f"'Top category by item revenue: ' || top_category || ' (R$ ' || {_sm('top_category_c')} || ').'"),
    ("product_insights", 2, "true", f"'Freight averages ' || {_st('freight_t')} || '% of item price.'"),
    ("delivery_insights", 1, "true", f"'Delivery takes ' || {_st('avg_days_t')} || ' days on average; ' || {_st('late_t')} || '% of orders arrive late.'"),
    ("delivery_insights", 2, "true", f"'Orders arrive ' || {_st('early_t')} || ' days before the estimate on average.'"),
    ("review_insights", 1, "true", f"'Average review score ' || {_sh('review_h')} || ' with ' || {_st('five_t')} || '% five-star reviews.'"),
    ("potential_issues", 1, "late_t > 100", "'Late deliveries exceed 10% of delivered orders.'"),
    ("potential_issues", 2, "repeat_t < 100", "'Fewer than 10% of customers come back for a second order.'"),
    ("potential_issues", 3, "freight_t > 150", "'Freight costs exceed 15% of item price.'"),
    ("suggested_actions", 1, "late_t > 100", "'Review carrier performance on the slowest routes.'"),
    ("suggested_actions", 2, "repeat_t < 100", "'Target one-time buyers with a second-purchase campaign.'"),
    ("suggested_actions", 3, "freight_t > 150", "'Negotiate freight rates or set free-shipping thresholds.'"),
]

INSIGHTS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{s}' AS section, {o} AS ord, {t} AS text FROM m WHERE {c}" for s, o, c, t in _RULES_SQL
)


@report("p17_insights", with_star(INSIGHTS_SQL, _METRICS_SQL))
def p17(st: Star) -> DataFrame:
    return insights(st).orderBy("section", "ord")


S11_SQL = with_star(
    INSIGHTS_SQL
    + f"""
UNION ALL SELECT 'data_range', 1, first_month || ' to ' || last_month FROM m
UNION ALL SELECT 'methodology_note', 1, '{METHODOLOGY}' FROM m
UNION ALL SELECT 'generated_at', 1, last_month FROM m""",
    _METRICS_SQL,
)


def endpoint_rows(m: DataFrame, generated_at: str | None = None) -> DataFrame:
    """Rule rows plus data range, methodology note and the caller's time of
    generation (the last month of the data, if none is given), from the metrics
    row."""
    items = F.array(
        *[F.struct(F.lit(s).alias("section"), F.lit(o).alias("ord"), c.alias("keep"), t.alias("text")) for s, o, c, t in rules()],
        F.struct(F.lit("data_range").alias("section"), F.lit(1).alias("ord"), F.lit(True).alias("keep"),
                 F.concat(F.col("first_month"), F.lit(" to "), F.col("last_month")).alias("text")),
        F.struct(F.lit("methodology_note").alias("section"), F.lit(1).alias("ord"), F.lit(True).alias("keep"),
                 F.lit(METHODOLOGY).alias("text")),
        F.struct(F.lit("generated_at").alias("section"), F.lit(1).alias("ord"), F.lit(True).alias("keep"),
                 (F.col("last_month") if generated_at is None else F.lit(generated_at)).alias("text")),
    )
    return m.select(F.explode(items).alias("r")).filter("r.keep").select("r.section", "r.ord", "r.text")


@report("s11_insights", S11_SQL, note="the insights endpoint: rule rows plus data range and methodology note")
def s11(st: Star) -> DataFrame:
    return endpoint_rows(metrics(st)).orderBy("section", "ord")


@report(
    "s11b_insights_from_report",
    S11_SQL,
    note="the insights endpoint served from the written JSON report (raw metrics left out)",
)
def s11b(st: Star) -> DataFrame:
    spark = st.orders.sparkSession
    m = metrics(st).persist(StorageLevel.MEMORY_AND_DISK)  # one row, written twice
    root = write_insights_report(endpoint_rows(m), m, scratch_path(spark, "insights-report"))
    m.unpersist()
    return read_insights_report(spark, root).orderBy("section", "ord")
