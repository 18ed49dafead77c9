"""Hot keys: one order, one value or one category holding a third of all rows.

The operators must keep exact results and spread such a key over many tasks
instead of landing it in one.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators.global_rank import add_rank, global_row_number
from marketlens.plans.registry import all_reports
from marketlens.sources.adapter import ITEM_SALTS, build_order_items, item_salt, load_star

N = 3000


def _raw_lineitem(spark):
    # every third line belongs to order 1; the rest to 2000 small orders
    r = spark.range(N)
    hot = F.col("id") % 3 == 0
    return r.select(
        F.when(hot, F.lit(1)).otherwise(2 + F.col("id") % 2000).cast("long").alias("l_orderkey"),
        (F.col("id") * 7 + 1).alias("l_partkey"),
        (F.col("id") % 50 + 1).alias("l_suppkey"),
        (F.col("id") % 4 + 1).cast("int").alias("l_linenumber"),
        (F.col("id") % 9 + 1).cast("double").alias("l_quantity"),
        (F.col("id") * 10 + 100).cast("double").alias("l_extendedprice"),
        F.lit(0.05).alias("l_discount"),
        F.lit(0.02).alias("l_tax"),
        F.lit("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"),
        F.timestamp_seconds(F.lit(1_500_000_000) + F.col("id") * 3600).cast("timestamp_ntz").alias("l_shipdate"),
    )


def test_hot_order_item_numbering_is_dense_and_spread(spark):
    raw = _raw_lineitem(spark)
    items = build_order_items(raw)
    per = items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("order_item_id").alias("d"), F.max("order_item_id").alias("hi")
    )
    assert per.filter((F.col("n") != F.col("d")) | (F.col("hi") != F.col("n"))).count() == 0
    kept = raw
    hot_rows = kept.filter("l_orderkey = 1").count()
    assert per.filter("order_id = '1'").first().n == hot_rows
    # the hot order is numbered in many independent (order, salt) groups
    groups = kept.filter("l_orderkey = 1").select(item_salt().alias("s")).distinct().count()
    assert groups > min(ITEM_SALTS, hot_rows) // 4
    # and the numbering follows (salt, line number, tie-breaks) exactly
    w = Window.partitionBy("l_orderkey").orderBy(
        item_salt(), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    want = kept.select(F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_partkey").cast("string").alias("product_id"),
                       F.row_number().over(w).alias("order_item_id"))
    got = items.select("order_id", "product_id", "order_item_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_value_ranks_exact_and_split_over_partitions(spark):
    df = spark.range(N).select(
        F.format_string("id%05d", "id").alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit(42)).otherwise(F.col("id") % 500).cast("long").alias("v"),
    )
    got = add_rank(global_row_number(df, [("v", True), ("id", True)], num_partitions=8), "_rn", ["v"], "rnk")
    w = Window.orderBy("v", "id")
    want = df.select("id", F.row_number().over(w).alias("_rn"), F.rank().over(Window.orderBy("v")).alias("rnk"))
    diff = got.select("id", "_rn", "rnk").exceptAll(want.select("id", F.col("_rn").cast("long"), F.col("rnk").cast("long")))
    assert diff.count() == 0
    # the range exchange samples the composite key, so the hot value spans several partitions
    spread = (
        df.repartitionByRange(8, "v", "id").filter("v = 42").select(F.spark_partition_id().alias("p")).distinct().count()
    )
    assert spread >= 2


def test_hot_category_top_k_limits_before_shuffle(spark):
    st = load_star(spark, "/root/testdata/sf0.001")
    plan = all_reports()["q05_top3_per_category"].build(st)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    partial_line = next(i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line)
    # the nearest exchange above the partial limit is the category shuffle: the
    # limit runs map-side, so a hot category ships at most 3 rows per partition
    exchange_line = max(i for i, line in enumerate(lines[:partial_line]) if "Exchange hashpartitioning" in line)
    assert "category" in lines[exchange_line] and exchange_line < partial_line
