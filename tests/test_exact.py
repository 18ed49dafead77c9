"""Exact rounding helpers agree with decimal arithmetic and with the SQL twin."""

from decimal import ROUND_HALF_UP, Decimal

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from marketlens.functions.exact import pct, ratio_round, sql_pct, sql_ratio_round


def expected(n: int, d: int, k: int) -> float:
    q = (Decimal(n) / Decimal(d)).quantize(Decimal(1).scaleb(-k), rounding=ROUND_HALF_UP)
    return float(q)


@settings(max_examples=60, deadline=None)
@given(st.integers(-10**12, 10**12), st.integers(1, 10**6), st.integers(0, 3))
def test_sql_ratio_round_matches_decimal(n, d, k):
    got = duckdb.sql(f"SELECT {sql_ratio_round(str(n), str(d), k)}").fetchall()[0][0]
    assert got == expected(n, d, k)


def test_shares_of_huge_totals(spark):
    """Cents of a table of about 100 TB: the share formulas stay in range."""
    cents = 7_510_110_20 * 10**7
    row = spark.range(1).select(pct(F.lit(cents), F.lit(3 * cents), 2).alias("p"), ratio_round(F.lit(-cents), F.lit(7), 2).alias("r")).first()
    assert row.p == 33.33 and row.r == expected(-cents, 7, 2)
    assert duckdb.sql(f"SELECT {sql_pct(str(cents), f'3 * {cents}::HUGEINT', 2)}").fetchall()[0][0] == 33.33


def test_spark_ratio_round_matches_decimal(spark):
    import random

    random.seed(7)
    cases = [(random.randint(-10**12, 10**12), random.randint(1, 10**6), random.randint(0, 3)) for _ in range(200)]
    cases += [(5, 2, 0), (-5, 2, 0), (1005, 1000, 2), (-1005, 1000, 2), (0, 7, 1)]
    df = spark.createDataFrame(cases, "n long, d long, k int")
    from pyspark.sql import functions as F

    rows = df.select("n", "d", "k", *[ratio_round("n", "d", k).alias(f"r{k}") for k in range(4)]).collect()
    for r in rows:
        assert r[f"r{r.k}"] == expected(r.n, r.d, r.k), r
    assert df.select(ratio_round(F.lit(1), F.lit(0), 1).alias("x")).first().x is None
