"""NTILE by selection equals the window, whatever is tied."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators import tiles as T


def _check(df, values, buckets):
    got = T.tiles(df, {v: f"t_{v}" for v in values}, "k", buckets)
    for v in values:
        got = got.withColumn(f"w_{v}", F.ntile(buckets).over(Window.orderBy(v, "k")).cast("long"))
    bad = got.where(" or ".join(f"t_{v} <> w_{v}" for v in values))
    assert bad.count() == 0, bad.limit(3).collect()
    assert got.count() == df.count()


KEYS = {
    "digits": lambda i: str(i * 7919 % 100_003),
    "hex": lambda i: hashlib.md5(str(i).encode()).hexdigest(),
    "prefixes": lambda i: "a" * (i + 1),
    "long prefix": lambda i: f"customer-of-the-north-{i:x}",
}


@pytest.mark.parametrize("few", [4096, 5])
@pytest.mark.parametrize("kind", KEYS)
def test_ties_of_every_size(spark, kind, few, monkeypatch):
    monkeypatch.setattr(T, "FEW", few)
    rng = np.random.default_rng(5)
    n = 400 if kind == "prefixes" else 3000
    rows = [(KEYS[kind](i), 1 if i % 30 else 2, 7 if i % 3 == 0 else int(rng.integers(0, 500)), -i) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, hot long, third long, own long").repartition(7).cache()
    for buckets in (4, 10):
        _check(df, ["hot", "third", "own"], buckets)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 9])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(str(i), i % 2) for i in range(n)], "k string, v long")
    _check(df, ["v"], 4)


def test_nothing_is_sorted(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("v"))
    plan = T.tiles(df, {"v": "t"}, "k", 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
