"""Money of a large marketplace: squares and products that pass 64 bits."""

import pytest

from marketlens.operators.forecast import _metric_columns, _metrics


@pytest.fixture()
def months(spark):
    # errors of 5e9 and 1.2e11 cents: their squares pass 9.2e18
    rows = [("train", 7 * 10**9, 10**9), ("test", 10**10, 5 * 10**9), ("test", 2 * 10**11, 8 * 10**10)]
    return spark.createDataFrame(rows, "split string, y long, p long")


def test_error_metrics_beyond_64_bits(months):
    got = _metrics(months, "p", "m").first()
    errors, truth = [5 * 10**9, 12 * 10**10], [10**10, 2 * 10**11]
    assert got["test_months"] == 2
    assert got["mae"] == sum(errors) / 2 / 100
    assert got["rmse"] == round((sum(e * e for e in errors) / 2) ** 0.5) / 100
    assert got["mape"] == round(100 * sum(e / t for e, t in zip(errors, truth)) / 2, 2)


def test_error_metrics_on_every_row_beyond_64_bits(months):
    from pyspark.sql import Window

    rows = months.select("*", *_metric_columns("p", Window.partitionBy())).collect()
    assert {(r["mae"], r["mape"]) for r in rows} == {(625000000.0, 55.0)}


def test_relative_error_of_a_small_month(spark):
    # a prediction of 1e13 cents for a month of one cent: a million times the error passes 64 bits
    df = spark.createDataFrame([("test", 1, 10**13)], "split string, y long, p long")
    assert _metrics(df, "p", "m").first()["mae"] == (10**13 - 1) / 100
