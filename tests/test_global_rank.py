"""Distributed global ranks equal plain (single-partition) windows."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators.global_rank import (
    add_dense_rank,
    add_rank,
    discrete_quantiles,
    global_row_number,
    ntile,
)


def _frame(spark, n=3000):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 40, n)  # heavy ties
    rows = [(f"id{i:05d}", int(v) if i % 97 else None) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "id string, v long")


def test_row_number_rank_dense_ntile_equal_plain_windows(spark):
    df = _frame(spark)
    order = [("v", False), ("id", True)]
    got = global_row_number(df, order, count_out="_n")
    got = add_rank(got, "_rn", ["v"], "rnk")
    got = add_dense_rank(got, [("v", False)], "drk")
    got = got.withColumn("nt", ntile(F.col("_rn"), F.col("_n"), 4))
    w = Window.orderBy(F.col("v").desc_nulls_last(), "id")
    wv = Window.orderBy(F.col("v").desc_nulls_last())
    ref = df.select(
        "id",
        F.row_number().over(w).alias("rn_ref"),
        F.rank().over(wv).alias("rnk_ref"),
        F.dense_rank().over(wv).alias("drk_ref"),
        F.ntile(4).over(w).alias("nt_ref"),
    )
    j = got.join(ref, "id")
    bad = j.filter(
        (F.col("_rn") != F.col("rn_ref"))
        | (F.col("rnk") != F.col("rnk_ref"))
        | (F.col("drk") != F.col("drk_ref"))
        | (F.col("nt") != F.col("nt_ref"))
    ).count()
    assert j.count() == df.count()
    assert bad == 0


def test_ntile_remainder_groups(spark):
    for n in (1, 2, 5, 7, 10, 13):
        df = spark.range(n).select(F.col("id").alias("v"), F.lit(n).alias("_n"))
        got = df.select(ntile(F.col("v") + 1, F.col("_n"), 4).alias("t")).collect()
        ref = df.select(F.ntile(4).over(Window.orderBy("v")).alias("t")).collect()
        assert [r.t for r in got] == [r.t for r in ref]


def test_quantiles_of_a_hot_value_match_numpy(spark):
    rng = np.random.default_rng(11)
    vals = rng.integers(0, 10_000, 1001).tolist() + [5] * 300
    df = spark.createDataFrame([(int(v),) for v in vals], "v long")
    q = discrete_quantiles(df, ["v"], {"q1": 0.25, "q2": 0.5, "q3": 0.75, "p2": 0.02}).first()
    arr = np.array(vals, dtype=float)
    for name, p in {"q1": 0.25, "q2": 0.5, "q3": 0.75, "p2": 0.02}.items():
        assert abs(q[f"v__{name}"] - np.quantile(arr, p)) < 1e-9


def test_quantiles_of_few_rows_match_numpy(spark):
    probs = {"a": 0.02, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0}
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 986):
        vals = rng.integers(-50, 50, n).astype(float)
        got = discrete_quantiles(spark.createDataFrame([(float(v),) for v in vals], "v double"), ["v"], probs).first()
        for name, p in probs.items():
            assert abs(got[f"v__{name}"] - np.quantile(vals, p)) < 1e-9, (n, p)
    empty = discrete_quantiles(spark.createDataFrame([], "v double"), ["v"], probs).first()
    assert all(x is None for x in empty)


def test_no_single_partition_exchange_over_rows(spark):
    df = _frame(spark)
    plan = global_row_number(df, [("v", True), ("id", True)])._jdf.queryExecution().executedPlan().toString()
    # The rows come from the checkpoint; the only single-partition exchange is
    # the prefix sum over per-partition counts, inside the broadcast side.
    assert plan.count("SinglePartition") <= 1
    if "SinglePartition" in plan:
        assert plan.index("BroadcastExchange") < plan.index("SinglePartition")
    plain = df.withColumn("r", F.row_number().over(Window.orderBy("v")))
    assert "SinglePartition" in plain._jdf.queryExecution().executedPlan().toString()


def test_discrete_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2_000_000, 20001).tolist()  # wide domain
    b = (rng.integers(0, 5, 20001) * 3).tolist()  # heavy ties
    rows = [(int(x), int(y) if i % 13 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a long, b long")
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75, "lo": 0.0, "hi": 1.0}
    got = discrete_quantiles(df, ["a", "b"], probs).first()
    for c, vals in (("a", np.array(a, float)), ("b", np.array([y for i, y in enumerate(b) if i % 13], float))):
        for name, p in probs.items():
            assert got[f"{c}__{name}"] == np.quantile(vals, p), (c, name)
