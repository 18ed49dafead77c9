"""EDA tables behind the charts (e01–e09; e05–e07 live with the models)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import cents, ratio_round, tenths
from ..functions.exact import sql_cents as C
from ..functions.exact import sql_ratio_round as R
from ..functions.exact import sql_tenths as T
from ..operators.global_rank import discrete_quantiles
from ..operators.scalars import one_row
from ..oracle.adapter_sql import with_star
from ..sources.adapter import Star
from .basic import delivered_items
from .intermediate import ia2
from .pipeline import ORDER_TOTALS_SQL, order_totals
from .registry import REPORTS, report
from .service import s04a

BIN_CENTS = 5000  # R$50 histogram bins


@report(
    "e01_order_value_dist",
    with_star(
        f"""SELECT CAST(b * {BIN_CENTS} AS DOUBLE) / 100 AS bin_start, CAST((b + 1) * {BIN_CENTS} AS DOUBLE) / 100 AS bin_end,
            count(*) AS order_count
        FROM (SELECT total_payment_cents // {BIN_CENTS} AS b FROM order_totals
              WHERE order_status = 'delivered' AND total_payment_cents IS NOT NULL) t
        GROUP BY b ORDER BY b""",
        ORDER_TOTALS_SQL,
    ),
)
def e01(st: Star) -> DataFrame:
    ot = order_totals(st).filter((F.col("order_status") == "delivered") & F.col("total_payment_cents").isNotNull())
    b = F.call_function("div", F.col("total_payment_cents"), F.lit(BIN_CENTS))
    g = ot.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("order_count"))
    return g.select(
        (F.col("b") * BIN_CENTS / 100).cast("double").alias("bin_start"),
        ((F.col("b") + 1) * BIN_CENTS / 100).cast("double").alias("bin_end"),
        "order_count",
    ).orderBy("bin_start")


@report(
    "e01b_order_value_box",
    with_star(
        """SELECT CAST(min(total_payment_cents) AS DOUBLE) / 100 AS min_value,
            quantile_cont(total_payment_cents, 0.25) / 100 AS q1,
            quantile_cont(total_payment_cents, 0.5) / 100 AS median,
            quantile_cont(total_payment_cents, 0.75) / 100 AS q3,
            CAST(max(total_payment_cents) AS DOUBLE) / 100 AS max_value
        FROM order_totals WHERE order_status = 'delivered' AND total_payment_cents IS NOT NULL""",
        ORDER_TOTALS_SQL,
    ),
)
def e01b(st: Star) -> DataFrame:
    ot = order_totals(st).filter((F.col("order_status") == "delivered") & F.col("total_payment_cents").isNotNull())
    mm = ot.agg(
        (F.min("total_payment_cents").cast("double") / 100).alias("min_value"),
        (F.max("total_payment_cents").cast("double") / 100).alias("max_value"),
    )
    q = discrete_quantiles(ot, ["total_payment_cents"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return one_row(mm, q).select(
        "min_value",
        (F.col("total_payment_cents__q1") / 100).alias("q1"),
        (F.col("total_payment_cents__q2") / 100).alias("median"),
        (F.col("total_payment_cents__q3") / 100).alias("q3"),
        "max_value",
    )


@report(
    "e02_weekday_hour",
    with_star(
        """SELECT purchase_weekday, purchase_hour, count(*) AS order_count FROM orders_en
        GROUP BY purchase_weekday, purchase_hour ORDER BY purchase_weekday, purchase_hour"""
    ),
)
def e02(st: Star) -> DataFrame:
    return (
        st.orders.groupBy("purchase_weekday", "purchase_hour")
        .agg(F.count(F.lit(1)).alias("order_count"))
        .orderBy("purchase_weekday", "purchase_hour")
    )


# Aliases: the same report under its chart name.
report("e03_state_geography", REPORTS["s04a_customer_states"].oracle, note="= s04a_customer_states")(s04a)
report("e08_customer_behaviour", REPORTS["ia2_repeat_buckets"].oracle, note="= ia2_repeat_buckets")(ia2)

CORR_FEATURES = ["total_payment_cents", "item_count", "freight_cents", "delivery_tenths", "review_score"]


def _corr_base(st: Star) -> DataFrame:
    ot = order_totals(st).filter(F.col("order_status") == "delivered")
    base = ot.select(
        F.col("total_payment_cents"),
        F.col("item_count"),
        F.round(F.col("freight_total") * 100, 0).cast("bigint").alias("freight_cents"),
        (F.col("delivery_duration_days") * 10).cast("bigint").alias("delivery_tenths"),
        F.col("review_score").cast("bigint").alias("review_score"),
    )
    cond = None
    for c in CORR_FEATURES:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return base.filter(cond)


@report(
    "e04_correlation_matrix",
    with_star(
        "\nUNION ALL\n".join(
            f"""SELECT '{a}' AS feature_x, '{b}' AS feature_y, round(
                CAST(count(*) * sum(CAST({a} AS HUGEINT) * {b}) - sum(CAST({a} AS HUGEINT)) * sum({b}) AS DOUBLE)
                / (sqrt(CAST(count(*) * sum(CAST({a} AS HUGEINT) * {a}) - sum(CAST({a} AS HUGEINT)) * sum({a}) AS DOUBLE))
                   * sqrt(CAST(count(*) * sum(CAST({b} AS HUGEINT) * {b}) - sum(CAST({b} AS HUGEINT)) * sum({b}) AS DOUBLE))), 6)
                AS pearson_r FROM corr_base"""
            for a, b in combinations(CORR_FEATURES, 2)
        ),
        ORDER_TOTALS_SQL
        + """,
corr_base AS (
    SELECT total_payment_cents, item_count, CAST(round(freight_total * 100) AS BIGINT) AS freight_cents,
        CAST(delivery_duration_days * 10 AS BIGINT) AS delivery_tenths, CAST(review_score AS BIGINT) AS review_score
    FROM order_totals WHERE order_status = 'delivered' AND total_payment_cents IS NOT NULL AND item_count IS NOT NULL
        AND freight_total IS NOT NULL AND delivery_duration_days IS NOT NULL AND review_score IS NOT NULL
)""",
    ),
    note="Pearson r from exact integer moment sums, one pass for all pairs",
)
def e04(st: Star) -> DataFrame:
    base = _corr_base(st)
    d = "decimal(38,0)"
    aggs = [F.count(F.lit(1)).cast(d).alias("n")]
    for c in CORR_FEATURES:
        aggs += [F.sum(F.col(c).cast(d)).alias(f"s_{c}"), F.sum(F.col(c).cast(d) * F.col(c).cast(d)).alias(f"q_{c}")]
    for a, b in combinations(CORR_FEATURES, 2):
        aggs.append(F.sum(F.col(a).cast(d) * F.col(b).cast(d)).alias(f"x_{a}_{b}"))
    m = base.agg(*aggs)  # one pass, one row of moment sums
    n = F.col("n")

    def var(c):
        return (n * F.col(f"q_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}")).cast("double")

    rows = []
    for a, b in combinations(CORR_FEATURES, 2):
        cov = (n * F.col(f"x_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}")).cast("double")
        r = F.round(cov / (F.sqrt(var(a)) * F.sqrt(var(b))), 6)
        rows.append(F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"), r.alias("pearson_r")))
    return m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@report(
    "e09_shipping_share",
    with_star(
        f"""SELECT
            (SELECT {R(f"sum({C('oi.freight_value')}) * 100", f"sum({C('oi.price')})", 1)}
             FROM order_items oi JOIN orders_en o ON oi.order_id = o.order_id WHERE o.order_status = 'delivered')
                AS freight_pct_of_price,
            (SELECT {R(f"-sum({T('delivery_delay_days')})", 'count(delivery_delay_days) * 10', 1)}
             FROM orders_en WHERE order_status = 'delivered') AS avg_days_early"""
    ),
)
def e09(st: Star) -> DataFrame:
    items = delivered_items(st).agg(
        ratio_round(F.sum(cents("freight_value")) * 100, F.sum(cents("price")), 1).alias("freight_pct_of_price")
    )
    early = st.delivered().agg(
        ratio_round(-F.sum(tenths("delivery_delay_days")), F.count("delivery_delay_days") * 10, 1).alias("avg_days_early")
    )
    return one_row(items, early)
