"""Monthly sales and customer features refreshed by month (p09b, p10b).

Deliveries land as files by purchase month: orders with their buyer, payments and
reviews, each in a folder ``year_month=...``.  For every month the state holds
what merges: sums and counts of the month, and per buyer the last purchase,
number of orders and money.  A refresh compares the fingerprint of each month's
files (path, length, modification time) with the one recorded, recomputes the
months that differ in one job, and records them.  Reports merge the months'
states: work on old months is that of adding up their totals and buyers.

The record of a refresh is written last, in a folder of its own; until its marker
is there, readers see the refresh before, whole.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exact import cents, cond_count, days_ratio, money, money_ratio, ratio_round, tenths
from ..operators.scalars import with_scalars
from ..oracle.adapter_sql import with_star
from ..session import scratch_path
from ..sources.adapter import Star
from ..sources.kept import _listed, _removed
from .pipeline import CUSTOMER_FEATURES_SQL, MONTHLY_SALES_SQL
from .registry import report

LANDED = ("orders", "payments", "reviews")
RECORD = "year_month string, mark string, batch string"


def landing(st: Star) -> dict[str, DataFrame]:
    """The star's orders (with buyer), payments and reviews, each with the
    purchase month of its order."""
    orders = st.orders.join(st.customers.select("customer_id", "customer_unique_id"), "customer_id", "left")
    months = st.orders.select("order_id", "year_month")
    return {"orders": orders, **{t: getattr(st, t).join(months, "order_id") for t in ("payments", "reviews")}}


def land(frames: dict[str, DataFrame], root: str) -> None:
    """Add files to the months that the frames hold: few for a small month, more
    for a large one."""
    for name, df in frames.items():
        df.hint("rebalance", "year_month").write.mode("append").partitionBy("year_month").parquet(f"{root}/{name}")


def marks(spark: SparkSession, root: str) -> DataFrame:
    """(year_month, mark): what the files of each month are, unread."""
    files = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").load(f"{root}/{t}").select("path", "length", "modificationTime") for t in LANDED])
    month = F.regexp_extract("path", "/year_month=([^/]+)/", 1)
    one = F.xxhash64("path", "length", F.col("modificationTime").cast("timestamp")).cast("decimal(38,0)")
    whole = files.groupBy(month.alias("year_month")).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(one).cast("string")).alias("mark"))
    return whole.where("year_month <> ''")


def record(spark: SparkSession, state: str) -> DataFrame:
    """The months of the last whole refresh, with their marks and batches."""
    found = _listed(spark, f"{state}/record-*/_SUCCESS")
    if not found:
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(found[-1].rsplit("/", 1)[0])


def month_states(orders: DataFrame, payments: DataFrame, reviews: DataFrame) -> DataFrame:
    """By month and buyer of the delivered orders: all that p09 and p10 need, in
    sums, counts and maxima.  Payments and reviews are brought to a row per order,
    so an order counts once for its buyer and as often as it has reviews for its
    month (``order_count``, ``c`` to ``late``); ``n`` is 0 where nothing was paid."""
    key = ["order_id", "year_month"]  # sorted by what tells rows apart first
    paid = payments.groupBy(*key).agg(F.sum(cents("payment_value")).alias("pay_cents"), F.sum("payment_value").alias("pay_sum"))
    scores = reviews.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), F.sum("review_score").alias("_score"), F.count("review_score").alias("_scored"))
    orders = orders.where("order_status = 'delivered' and year_month is not null").select(
        *key, "customer_unique_id", "order_purchase_timestamp", tenths("delivery_duration_days").alias("_days"), "is_late"
    )
    rows = orders.join(paid, key, "left").join(scores, key, "left").withColumn("_times", F.coalesce("_rows", F.lit(1)))

    def times(value: str) -> Column:
        return F.sum(F.when(F.col(value).isNotNull(), F.col("_times")).otherwise(0))

    return rows.groupBy("year_month", "customer_unique_id").agg(
        F.max(F.when(F.col("pay_sum").isNotNull(), F.col("order_purchase_timestamp"))).alias("last"),
        F.count("pay_sum").alias("n"),
        F.sum("pay_sum").alias("pay_sum"),
        F.sum("pay_cents").alias("pay_cents"),
        F.max("order_purchase_timestamp").alias("newest"),
        F.sum("_times").alias("order_count"),
        F.sum(F.col("pay_cents") * F.col("_times")).alias("c"),
        times("pay_cents").alias("cn"),
        F.sum("_score").alias("r"),
        F.sum(F.coalesce("_scored", F.lit(0))).alias("rn"),
        F.sum(F.col("_days") * F.col("_times")).alias("d"),
        times("_days").alias("dn"),
        F.sum(F.when(F.col("is_late"), F.col("_times")).otherwise(0)).alias("late"),
    )


def month_totals(buyers: DataFrame) -> DataFrame:
    """The months' rows: those of their buyers added up."""
    sums = [F.sum(c).alias(c) for c in ("order_count", "c", "cn", "r", "rn", "d", "dn", "late")]
    return buyers.groupBy("year_month").agg(*sums, F.max("newest").alias("last"))


def refresh(spark: SparkSession, root: str, state: str) -> list[str]:
    """Bring the state up to the landed files; returns the months recomputed."""
    known = {r["year_month"]: r for r in record(spark, state).collect()}  # a row per month
    now = {r["year_month"]: r["mark"] for r in marks(spark, root).collect()}
    changed = sorted(m for m, mark in now.items() if m not in known or known[m]["mark"] != mark)
    if not changed and known.keys() == now.keys():
        return []
    batch = f"batch-{uuid.uuid4().hex[:12]}"
    if changed:
        # the partition filter keeps the other months' files unread
        tables = [spark.read.parquet(f"{root}/{t}").withColumn("year_month", F.col("year_month").cast("string")).where(F.col("year_month").isin(changed)) for t in LANDED]
        month_states(*tables).hint("rebalance", "year_month").write.partitionBy("year_month").parquet(f"{state}/{batch}/buyers")
        buyers = spark.read.schema(_PARTS).parquet(f"{state}/{batch}/buyers")
        month_totals(buyers).write.parquet(f"{state}/{batch}/months")
    rows = [(m, mark, batch if m in changed else known[m]["batch"]) for m, mark in now.items()]
    number = max((int(p.rsplit("-", 1)[1]) + 1 for p in _listed(spark, f"{state}/record-*")), default=0)
    spark.createDataFrame(rows, RECORD).coalesce(1).write.parquet(f"{state}/record-{number:08d}")
    return changed


def prune(spark: SparkSession, state: str) -> int:
    """Remove the records before the last one and the batches that it doesn't
    name (also those of refreshes that broke off); returns how many folders."""
    named = {r["batch"] for r in record(spark, state).collect()}
    records = [p.rsplit("/", 1)[0] for p in _listed(spark, f"{state}/record-*/_SUCCESS")]
    spent = records[:-1] + [p for p in _listed(spark, f"{state}/batch-*") if p.rsplit("/", 1)[1] not in named]
    for folder in spent:
        _removed(spark, folder)
    return len(spent)


def _state(spark: SparkSession, state: str, kind: str, schema: str) -> DataFrame:
    """The rows of every month from the batch that holds it."""
    parts: dict[str, list[str]] = {}
    for r in record(spark, state).collect():
        parts.setdefault(r["batch"], []).append(r["year_month"])
    frames = [spark.read.schema(schema).parquet(f"{state}/{b}/{kind}").where(F.col("year_month").isin(months)) for b, months in sorted(parts.items())]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


_MONTHS = "year_month string, order_count long, c long, cn long, r long, rn long, d long, dn long, late long, last timestamp_ntz"
_BUYERS = "customer_unique_id string, last timestamp_ntz, n long, pay_sum decimal(38,2), pay_cents long, year_month string"
#: What a month's buyers add to its row.
_PARTS = "newest timestamp_ntz, order_count long, c long, cn long, r long, rn long, d long, dn long, late long, year_month string"


def sales_of(spark: SparkSession, state: str) -> DataFrame:
    """p09's rows from the state."""
    m = _state(spark, state, "months", _MONTHS)
    return m.select(
        "year_month",
        F.row_number().over(Window.orderBy("year_month")).cast("bigint").alias("month_number"),  # a row per month
        "order_count",
        (F.col("c").cast("double") / 100).alias("revenue"),
        money_ratio("c", "cn", 2).alias("avg_order_value"),
        ratio_round("r", "rn", 2).alias("avg_review_score"),
        days_ratio("d", "dn", 1).alias("avg_delivery_days"),
        F.col("late").alias("late_order_count"),
    )


def features_of(spark: SparkSession, state: str) -> DataFrame:
    """p10's rows from the state."""
    newest = _state(spark, state, "months", _MONTHS).agg(F.max("last").alias("_ref"))
    g = _state(spark, state, "buyers", _BUYERS).where("n > 0").groupBy("customer_unique_id").agg(
        F.max("last").alias("_last"), F.sum("n").alias("frequency"), F.sum("pay_sum").alias("pay_sum"), F.sum("pay_cents").alias("monetary_cents")
    )
    return with_scalars(g, newest).select(
        "customer_unique_id",
        F.datediff(F.to_date("_ref"), F.to_date("_last")).cast("bigint").alias("recency_days"),
        "frequency",
        money("pay_sum").alias("monetary"),
        "monetary_cents",
        (F.col("frequency") > 1).alias("is_repeat_customer"),
    )


def _in_two_deliveries(st: Star) -> tuple[SparkSession, str]:
    """The star's rows landed twice, every tenth order late, with a refresh after
    each; returns the state."""
    spark = st.spark
    root, state = scratch_path(spark, "landing"), scratch_path(spark, "month-state")
    frames = landing(st)
    late = F.col("order_id").cast("bigint") % 10 == 3
    land({t: df.where(~late) for t, df in frames.items()}, root)
    refresh(spark, root, state)
    land({t: df.where(late) for t, df in frames.items()}, root)
    refresh(spark, root, state)
    return spark, state


@report("p09b_monthly_refresh", with_star("SELECT * FROM monthly_sales", MONTHLY_SALES_SQL), note="p09 from month states, every tenth order landed late")
def p09b(st: Star) -> DataFrame:
    return sales_of(*_in_two_deliveries(st)).orderBy("year_month")


@report("p10b_customer_refresh", with_star("SELECT * FROM customer_features", CUSTOMER_FEATURES_SQL), note="p10 from month states, every tenth order landed late")
def p10b(st: Star) -> DataFrame:
    return features_of(*_in_two_deliveries(st))
