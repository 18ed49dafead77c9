"""Anomaly detection: IQR fences (p13, p16), Isolation Forest (p14), their
union (p15) and the anomaly reports (s10, e06, e07).

IQR fences use exact sort-free quantiles (``discrete_quantiles``) on integer
features (cents, counts, tenths of a day), so fences and flags are exact.  The
forest is in ``forest``; its scores are whole numbers, too.

p14 grows the forest and scores every delivered order; what it returns is kept
for the source (``sources.kept``), and p15, s10, e06 and e07b serve from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import money, money_ratio, ratio_round, sql_money_ratio, sql_ratio_round
from ..oracle.adapter_sql import with_star
from ..operators.global_rank import discrete_quantiles
from ..operators.grain import item_totals, payment_totals
from ..operators.group_quantiles import group_quantiles
from ..plans.pipeline import MONTHLY_SALES_SQL, ORDER_TOTALS_SQL, monthly_sales
from ..plans.registry import report
from ..session import scratch_path
from ..sources.adapter import Star
from ..sources.kept import keep
from . import forest
from .scalars import one_row, with_scalars

IQR_K = 1.5
CONTAMINATION = 0.02
FEATURES = ["total_payment_cents", "item_count", "delivery_tenths"]


def delivered_features(st: Star) -> DataFrame:
    """Delivered orders with payment, number of items and delivery time, written
    once: fences, forest and flags read it several times."""
    o = st.delivered().select("order_id", F.col("delivery_duration_days").cast("double").alias("delivery_duration_days"))
    paid = payment_totals(st).select("order_id", "pay_sum", F.col("pay_cents").cast("bigint").alias("total_payment_cents"))
    items = item_totals(st).select("order_id", "item_rows")
    rows = o.join(paid, "order_id", "left").join(items, "order_id", "left")
    rows = rows.select(
        "order_id",
        money("pay_sum").alias("total_payment"),
        "total_payment_cents",
        F.coalesce(F.col("item_rows"), F.lit(0)).cast("bigint").alias("item_count"),
        "delivery_duration_days",
        (F.col("delivery_duration_days") * 10).cast("bigint").alias("delivery_tenths"),
    )
    path = scratch_path(st.spark, "order-features")
    rows.write.parquet(path)
    return st.spark.read.parquet(path)


def iqr_fences(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: <f>_lo / <f>_hi for every feature (exact quartiles of integer features)."""
    q = discrete_quantiles(df, features, {"q1": 0.25, "q3": 0.75})
    cols = []
    for f in features:
        q1, q3 = F.col(f"{f}__q1"), F.col(f"{f}__q3")
        cols += [(q1 - IQR_K * (q3 - q1)).alias(f"{f}_lo"), (q3 + IQR_K * (q3 - q1)).alias(f"{f}_hi")]
    return q.select(*cols)


def iqr_flags(df: DataFrame, features: list[str], names: list[str]) -> DataFrame:
    fences = iqr_fences(df, features)
    j = with_scalars(df, fences)
    for f, name in zip(features, names):
        v = F.col(f).cast("double")
        j = j.withColumn(name, F.coalesce((v < F.col(f"{f}_lo")) | (v > F.col(f"{f}_hi")), F.lit(False)))
    j = j.drop(*[c for f in features for c in (f"{f}_lo", f"{f}_hi")])
    any_flag = F.lit(False)
    for name in names:
        any_flag = any_flag | F.col(name)
    return j.withColumn("iqr_flag", any_flag)


IQR_NAMES = ["iqr_payment", "iqr_items", "iqr_delivery"]


def _sql_fences(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"(SELECT quantile_cont({c}, 0.25) - {IQR_K} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {src}) AS {c}_lo, "
            f"(SELECT quantile_cont({c}, 0.75) + {IQR_K} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {src}) AS {c}_hi"
        )
    return "SELECT " + ", ".join(parts)


ORDER_FEATURES_SQL = (
    ORDER_TOTALS_SQL
    + f""",
feats AS (
    SELECT order_id, total_payment, total_payment_cents, item_count, delivery_duration_days,
        CAST(delivery_duration_days * 10 AS BIGINT) AS delivery_tenths
    FROM order_totals WHERE order_status = 'delivered'
),
fences AS ({_sql_fences('feats', FEATURES)}),
iqr AS (
    SELECT f.*,
        coalesce(total_payment_cents < total_payment_cents_lo OR total_payment_cents > total_payment_cents_hi, false) AS iqr_payment,
        coalesce(item_count < item_count_lo OR item_count > item_count_hi, false) AS iqr_items,
        coalesce(delivery_tenths < delivery_tenths_lo OR delivery_tenths > delivery_tenths_hi, false) AS iqr_delivery
    FROM feats f CROSS JOIN fences
)"""
)


def order_iqr(st: Star) -> DataFrame:
    return iqr_flags(delivered_features(st), FEATURES, IQR_NAMES)


@report(
    "p13_anomaly_iqr",
    with_star(
        """SELECT order_id, total_payment, item_count, delivery_duration_days, iqr_payment, iqr_items, iqr_delivery
        FROM iqr WHERE iqr_payment OR iqr_items OR iqr_delivery ORDER BY order_id""",
        ORDER_FEATURES_SQL,
    ),
    note="fences q1 - 1.5 IQR / q3 + 1.5 IQR per feature over delivered orders",
)
def p13(st: Star) -> DataFrame:
    f = order_iqr(st).filter(F.col("iqr_flag"))
    return f.select(
        "order_id", "total_payment", "item_count", "delivery_duration_days", *IQR_NAMES
    )


# ---------------------------------------------------------------- monthly IQR (p16)


def monthly_iqr(st: Star) -> DataFrame:
    m = monthly_sales(st).withColumn("revenue_cents", F.round(F.col("revenue") * 100, 0).cast("bigint"))
    return iqr_flags(m, ["revenue_cents", "order_count"], ["iqr_revenue", "iqr_orders"])


@report(
    "p16_anomaly_months",
    with_star(
        """SELECT m.year_month, m.order_count, m.revenue,
            coalesce(revenue_cents < revenue_cents_lo OR revenue_cents > revenue_cents_hi, false) AS iqr_revenue,
            coalesce(order_count < order_count_lo OR order_count > order_count_hi, false) AS iqr_orders,
            'monthly' AS level
        FROM mrev m CROSS JOIN mfences
        WHERE revenue_cents < revenue_cents_lo OR revenue_cents > revenue_cents_hi
           OR order_count < order_count_lo OR order_count > order_count_hi
        ORDER BY m.year_month""",
        MONTHLY_SALES_SQL
        + f""",
mrev AS (SELECT *, CAST(round(revenue * 100) AS BIGINT) AS revenue_cents FROM monthly_sales),
mfences AS ({_sql_fences('mrev', ['revenue_cents', 'order_count'])})""",
    ),
)
def p16(st: Star) -> DataFrame:
    m = monthly_iqr(st).filter(F.col("iqr_flag"))
    return m.select(
        "year_month", "order_count", "revenue", "iqr_revenue", "iqr_orders", F.lit("monthly").alias("level")
    ).orderBy("year_month")


# ---------------------------------------------------------------- Isolation Forest


def isolation_scores(st: Star) -> DataFrame:
    """Every delivered order with its features, if_score (lower = stranger;
    below 0 is flagged at 2% contamination; null where a feature is missing) and
    if_flag.  The features are joined once and written, and so are the scores:
    what reads this runs neither the joins nor the forest again."""
    spark = st.spark
    feats = delivered_features(st)
    complete = feats.where(" and ".join(f"{f} is not null" for f in FEATURES))
    nodes = forest.grow(complete, "order_id", FEATURES)
    path = scratch_path(spark, "order-scores")
    forest.scored(feats, nodes, FEATURES).write.parquet(path)
    scored = spark.read.parquet(path)
    offset = discrete_quantiles(scored, ["raw_score"], {"offset": CONTAMINATION})
    score = (F.col("raw_score") - F.col("raw_score__offset")) / float(forest.SCORE)
    return with_scalars(scored, offset).select(
        "order_id", "total_payment", "delivery_duration_days", *FEATURES, score.alias("if_score"), F.coalesce(score < 0, F.lit(False)).alias("if_flag")
    )


def scored_orders(st: Star, fresh: bool = False) -> DataFrame:
    """``isolation_scores`` as kept for the star's source."""
    return keep(st, "isolation-forest", (forest.TREES, forest.SAMPLE, CONTAMINATION, FEATURES), lambda: isolation_scores(st), fresh)


FOREST_SQL = f"""{ORDER_FEATURES_SQL},
{forest.sql_forest("feats", "order_id", FEATURES)},
foffset AS (SELECT quantile_cont(raw_score, CAST({CONTAMINATION} AS DOUBLE)) AS cutoff FROM forest_scores),
scored AS (
    SELECT i.*, (s.raw_score - cutoff) / CAST({forest.SCORE} AS DOUBLE) AS if_score, coalesce(s.raw_score < cutoff, false) AS if_flag,
        iqr_payment OR iqr_items OR iqr_delivery AS iqr_flag
    FROM iqr i LEFT JOIN forest_scores s ON s.k = i.order_id, foffset
)"""

FLAGGED_SQL = """SELECT order_id, total_payment, item_count, delivery_duration_days, if_score, iqr_flag, if_flag,
        iqr_flag AND if_flag AS both_flag, 'order' AS level
    FROM scored WHERE iqr_flag OR if_flag"""


@report(
    "p14_isolation_forest",
    with_star("SELECT order_id, total_payment, item_count, delivery_duration_days, if_score, if_flag FROM scored", FOREST_SQL),
    note="grows the forest anew and keeps the scores for the source; every delivered order, scored in Arrow batches",
)
def p14(st: Star) -> DataFrame:
    return scored_orders(st, fresh=True).select("order_id", "total_payment", "item_count", "delivery_duration_days", "if_score", "if_flag")


def order_anomalies(st: Star) -> DataFrame:
    flagged = iqr_flags(scored_orders(st), FEATURES, IQR_NAMES).filter(F.col("iqr_flag") | F.col("if_flag"))
    return flagged.select(
        "order_id",
        "total_payment",
        "item_count",
        "delivery_duration_days",
        "if_score",
        "iqr_flag",
        "if_flag",
        (F.col("iqr_flag") & F.col("if_flag")).alias("both_flag"),
        F.lit("order").alias("level"),
    )


def kept_anomalies(st: Star) -> DataFrame:
    """``order_anomalies`` as kept for the star's source."""
    return keep(st, "order-anomalies", (forest.TREES, forest.SAMPLE, CONTAMINATION, IQR_K, FEATURES), lambda: order_anomalies(st))


@report("p15_anomaly_union", with_star(FLAGGED_SQL, FOREST_SQL), note="from the kept forest scores")
def p15(st: Star) -> DataFrame:
    return kept_anomalies(st)


def anomalies_report(st: Star, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be within 1..500")
    orders = kept_anomalies(st)
    months = monthly_iqr(st).filter(F.col("iqr_flag"))
    totals = (
        one_row(orders.agg(F.count(F.lit(1)).alias("order_anomalies")), months.agg(F.count(F.lit(1)).alias("monthly_anomalies")))
        .withColumn("total_flagged", F.col("order_anomalies") + F.col("monthly_anomalies"))
    )
    top = orders.orderBy(F.asc_nulls_last("if_score"), "order_id").limit(limit)
    return with_scalars(top, totals).select(
        "total_flagged",
        "order_anomalies",
        "monthly_anomalies",
        "order_id",
        "total_payment",
        "item_count",
        "delivery_duration_days",
        "if_score",
        "both_flag",
        "level",
    )


@report(
    "s10_anomalies",
    with_star(
        """SELECT order_anomalies + monthly_anomalies AS total_flagged, order_anomalies, monthly_anomalies, order_id, total_payment,
            item_count, delivery_duration_days, if_score, both_flag, level
        FROM (SELECT * FROM flagged ORDER BY if_score NULLS LAST, order_id LIMIT 50),
            (SELECT count(*) AS order_anomalies FROM flagged),
            (SELECT count(*) AS monthly_anomalies FROM mrev, mfences WHERE revenue_cents < revenue_cents_lo OR revenue_cents > revenue_cents_hi
                OR order_count < order_count_lo OR order_count > order_count_hi)""",
        f"""{FOREST_SQL},
flagged AS MATERIALIZED ({FLAGGED_SQL}),
{MONTHLY_SALES_SQL.removeprefix(ORDER_TOTALS_SQL + ",").strip()},
mrev AS (SELECT *, CAST(round(revenue * 100) AS BIGINT) AS revenue_cents FROM monthly_sales),
mfences AS ({_sql_fences('mrev', ['revenue_cents', 'order_count'])})""",
    ),
    note="top 50 order anomalies by ascending if_score plus totals, from the kept scores",
)
def s10(st: Star) -> DataFrame:
    return anomalies_report(st, 50)


@report(
    "e06_score_histogram",
    with_star(
        """SELECT bin * CAST(0.05 AS DOUBLE) AS bin_start, (bin + 1) * CAST(0.05 AS DOUBLE) AS bin_end, count(*) AS order_count,
            CAST(sum(CASE WHEN if_flag THEN 1 ELSE 0 END) AS BIGINT) AS flagged
        FROM (SELECT floor(if_score / CAST(0.05 AS DOUBLE)) AS bin, if_flag FROM scored WHERE if_score IS NOT NULL)
        GROUP BY bin ORDER BY bin""",
        FOREST_SQL,
    ),
    note="Isolation-Forest score histogram, 0.05 bins, from the kept scores",
)
def e06(st: Star) -> DataFrame:
    s = scored_orders(st).filter(F.col("if_score").isNotNull())
    b = F.floor(F.col("if_score") / 0.05)
    return (
        s.groupBy(b.alias("_b"))
        .agg(F.count(F.lit(1)).alias("order_count"), F.sum(F.col("if_flag").cast("int")).cast("bigint").alias("flagged"))
        .select((F.col("_b") * 0.05).alias("bin_start"), ((F.col("_b") + 1) * 0.05).alias("bin_end"), "order_count", "flagged")
        .orderBy("bin_start")
    )


# Features, as e07 shows them: name of the result, divisor of the integer.
SHOWN = {"total_payment": ("total_payment_cents", 100), "item_count": ("item_count", 1), "delivery_days": ("delivery_tenths", 10)}
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}

_QUARTILES_SQL = ",\n".join(
    f"quantile_cont({c}, CAST({p} AS DOUBLE)) / CAST({by} AS DOUBLE) AS {q}_{name}" for name, (c, by) in SHOWN.items() for q, p in QUARTILES.items()
)


def _summary_sql(flag: str, source: str) -> str:
    return (
        f"SELECT {flag} AS is_anomaly, count(*) AS order_count, "
        + sql_money_ratio("sum(total_payment_cents)", "count(total_payment_cents)", 2)
        + " AS avg_total_payment, "
        + sql_ratio_round("sum(item_count)", "count(item_count)", 2)
        + " AS avg_item_count, "
        + sql_ratio_round("sum(delivery_tenths)", "count(delivery_tenths) * 10", 2)
        + f""" AS avg_delivery_days, CAST(max(total_payment_cents) AS DOUBLE) / 100 AS max_total_payment,
        {_QUARTILES_SQL}
        FROM {source} GROUP BY is_anomaly ORDER BY is_anomaly"""
    )


def feature_summary(f: DataFrame) -> DataFrame:
    """Averages, maximum and quartiles of the features by is_anomaly."""
    path = scratch_path(f.sparkSession, "anomaly-features")
    f.select("is_anomaly", *FEATURES).write.parquet(path)
    f = f.sparkSession.read.parquet(path)
    quartiles = group_quantiles(f, "is_anomaly", FEATURES, QUARTILES)
    means = f.groupBy("is_anomaly").agg(
        F.count(F.lit(1)).alias("order_count"),
        money_ratio(F.sum("total_payment_cents"), F.count("total_payment_cents"), 2).alias("avg_total_payment"),
        ratio_round(F.sum("item_count"), F.count("item_count"), 2).alias("avg_item_count"),
        ratio_round(F.sum("delivery_tenths"), F.count("delivery_tenths") * 10, 2).alias("avg_delivery_days"),
        (F.max("total_payment_cents").cast("double") / 100).alias("max_total_payment"),
    )
    shown = [(F.col(f"{c}__{q}") / float(by)).alias(f"{q}_{name}") for name, (c, by) in SHOWN.items() for q in QUARTILES]
    return means.join(quartiles, "is_anomaly").select(*means.columns, *shown).orderBy("is_anomaly")


@report(
    "e07_anomaly_feature_dist",
    with_star(_summary_sql("iqr_payment OR iqr_items OR iqr_delivery", "iqr"), ORDER_FEATURES_SQL),
    note="normal vs IQR-anomalous delivered orders",
)
def e07(st: Star) -> DataFrame:
    return feature_summary(order_iqr(st).withColumn("is_anomaly", F.col("iqr_flag")))


@report(
    "e07b_anomaly_feature_dist_union",
    with_star(_summary_sql("iqr_flag OR if_flag", "scored"), FOREST_SQL),
    note="normal orders vs those that IQR or the Isolation Forest flags, from the kept scores",
)
def e07b(st: Star) -> DataFrame:
    f = iqr_flags(scored_orders(st), FEATURES, IQR_NAMES)
    return feature_summary(f.withColumn("is_anomaly", F.col("iqr_flag") | F.col("if_flag")))
