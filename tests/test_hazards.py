"""Hand-made frames for the semantic hazards."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from marketlens.operators.anomalies import iqr_flags
from marketlens.operators.forecast import with_trends
from marketlens.operators.forest import EDGE, _grow_tree, unsuccessful
from marketlens.plans.advanced import next_month, value_tier
from marketlens.plans.intermediate import delay_bucket_sql
from marketlens.sources.adapter import category
from marketlens.sources.ingest import dedup_reviews


def test_delay_bucket_edges(spark):
    vals = ["-14.1", "-14.0", "-7.1", "-7.0", "-0.1", "0.0", "7.0", "7.1", "14.0", "14.1"]
    df = spark.createDataFrame([(Decimal(v),) for v in vals], "d decimal(6,1)")
    got = [r.b for r in df.select(F.expr(delay_bucket_sql("d")).alias("b")).collect()]
    assert got == [
        "> 14 days early", "8-14 days early", "8-14 days early", "1-7 days early", "1-7 days early",
        "exactly on time", "1-7 days late", "8-14 days late", "8-14 days late", "> 14 days late",
    ]


def test_category_coalesce(spark):
    df = spark.createDataFrame(
        [("a", "en"), (None, "pt"), (None, None)], "product_category_name_english string, product_category_name string"
    )
    assert [r.c for r in df.select(category().alias("c")).collect()] == ["a", "pt", "unknown"]


def test_value_tier_edges(spark):
    df = spark.createDataFrame([(4999,), (5000,), (14999,), (15000,), (49999,), (50000,)], "c long")
    got = [r.t.split()[0] for r in df.select(value_tier(F.col("c")).alias("t")).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "High", "Premium"]


def test_next_month_across_year_end(spark):
    df = spark.createDataFrame([("2017-12",), ("2018-01",), ("2018-03",)], "ym string")
    assert [r.n for r in df.select(next_month(F.col("ym")).alias("n")).collect()] == ["2018-01", "2018-02", "2018-04"]


def test_review_dedup_is_deterministic_on_equal_timestamps(spark):
    ts = "2018-01-01 10:00:00"
    raw = spark.createDataFrame(
        [("r1", "o1", "5", "", "", ts, ts), ("r2", "o1", "1", "", "x", ts, ts), ("r3", "o2", "4", "", "", ts, "")],
        "review_id string, order_id string, review_score string, review_comment_title string, "
        "review_comment_message string, review_creation_date string, review_answer_timestamp string",
    )
    schema = "review_id string, order_id string, review_score int, review_comment_title string, " \
             "review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz"
    from pyspark.sql.types import _parse_datatype_string

    out = {r.order_id: r for r in dedup_reviews(raw, _parse_datatype_string(schema)).collect()}
    assert out["o1"].review_id == "r2"  # equal answer time → highest review_id, every run
    assert out["o2"].review_comment_message is None and out["o2"].review_answer_timestamp is None


def test_iqr_with_zero_spread_and_outlier(spark):
    df = spark.createDataFrame([(i, 10, 5 if i < 9 else 500) for i in range(10)], "id int, const long, v long")
    got = iqr_flags(df, ["const", "v"], ["f_const", "f_v"]).orderBy("id").collect()
    assert not any(r.f_const for r in got)  # zero IQR: nothing outside [10, 10]
    assert [r.f_v for r in got] == [False] * 9 + [True]


def test_isolation_tree_on_constant_column_is_a_leaf():
    import pandas as pd

    pdf = pd.DataFrame({"tree": [0] * 8, "f0": [1.0] * 8, "f1": [2.0] * 8, "f2": [3.0] * 8})
    nodes = _grow_tree(pdf)
    assert len(nodes) == 1 and nodes.feat.iloc[0] == -1 and nodes["size"].iloc[0] == 8
    assert unsuccessful(1) == 0 and unsuccessful(2) == EDGE and abs(unsuccessful(256) / EDGE - 10.2448) < 1e-3


def test_quadratic_fit_recovers_coefficients_per_series(spark):
    truth = {1: (1000, 37, 3), 2: (-50, 4, 1)}
    rows = [(s, t, a + b * t + c * t * t, "train") for s, (a, b, c) in truth.items() for t in range(24)]
    rows += [(s, 24, None, "forecast") for s in truth]  # future rows receive the coefficients too
    df = spark.createDataFrame(rows, "s int, t long, y long, split string")
    out = with_trends(df, ["s"]).collect()
    assert len(out) == len(rows)
    for co in out:
        a, b, c = truth[co.s]
        assert abs(co.a2 - a) < 1e-6 and abs(co.b2 - b) < 1e-6 and abs(co.c2 - c) < 1e-9
        assert abs(co.b1 - (b + c * 23)) < 1e-6  # linear slope of t^2 over 0..23 is 23


def test_payments_sum_distinct_drops_equal_values(spark, duck):
    # Two equal payments on one order: SUM(DISTINCT) counts the value once.
    df = spark.createDataFrame([("o", 1, Decimal("10.00")), ("o", 2, Decimal("10.00")), ("o", 3, Decimal("5.00"))],
                               "order_id string, seq int, v decimal(10,2)")
    spark_v = df.select("order_id", "v").distinct().groupBy("order_id").agg(F.sum("v").alias("s")).first().s
    duck_v = duck.execute("SELECT sum(DISTINCT v) FROM (VALUES (10.00), (10.00), (5.00)) t(v)").fetchone()[0]
    assert spark_v == Decimal("15.00") == duck_v
