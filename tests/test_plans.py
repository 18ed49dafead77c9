"""Plan checks: pushdown, pruning and pre-aggregation reach the physical plan."""

import re

import pytest

from marketlens.plans.registry import all_reports
from marketlens.sources.adapter import load_star

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns(spark):
    st = load_star(spark, SF)
    plan = _plan(all_reports()["b19_revenue_by_year"].build(st))
    # the scans read the columns that the report needs, and no others
    read = set(re.findall(r"(o_\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan))))
    assert read == {"o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"}


@pytest.mark.parametrize("key", ["b05_delivered_revenue", "b16_delivery_summary", "q15_monthly_dashboard"])
def test_delivered_filter_reaches_scan(spark, key):
    plan = _plan(all_reports()[key].build(load_star(spark, SF)))
    assert re.search(r"PushedFilters: \[[^\]]*In\(o_orderstatus, \[F,P\]\)", plan)


def test_reports_read_every_given_row(spark):
    st = load_star(spark, SF)
    raw = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    assert st.orders.count() == st.reviews.count() == raw("orders")
    assert st.order_items.count() == raw("lineitem")
    assert st.payments.where("payment_sequential = 1").count() == raw("orders")


def test_reports_pre_aggregate_before_exchange(spark):
    st = load_star(spark, SF)
    plan = _plan(all_reports()["b08_top_categories_revenue"].build(st))
    assert "HashAggregate" in plan and "partial" in plan.lower()


def test_reports_open_only_their_files(spark, monkeypatch):
    """b05 needs orders alone; tables are derived when they are asked for."""
    from marketlens.sources import adapter

    opened = []
    real = adapter.read_raw
    monkeypatch.setattr(adapter, "read_raw", lambda s, d, name: opened.append(name) or real(s, d, name))
    st = load_star(spark, SF)
    assert opened == []
    all_reports()["b05_delivered_revenue"].build(st).collect()
    assert opened == ["orders"]
    st.payments, st.order_items
    assert opened == ["orders", "lineitem"]


def test_loading_is_quick(spark):
    import time

    load_star(spark, SF)
    began = time.time()
    load_star(spark, SF)
    assert time.time() - began < 0.1
