"""Orders without payments, reviews or items: the branches that the given tables
leave empty, on a star with rows taken out by hand."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from marketlens.plans.registry import all_reports
from marketlens.sources.adapter import load_star

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    st = load_star(spark, SF)
    k = F.col("order_id").cast("long")
    return replace(st, payments=st.payments.where(k % 7 != 3), reviews=st.reviews.where(k % 5 != 2), source=None)


@pytest.fixture(scope="module")
def orders(star):
    rows = star.orders.select("order_id", "order_status").collect()
    return [(int(r.order_id), r.order_status == "delivered") for r in rows]


def test_payment_presence(star, orders):
    got = {r.payment_status: r.order_count for r in all_reports()["ib3_payment_presence"].build(star).collect()}
    unpaid = sum(k % 7 == 3 for k, _ in orders)
    paid_rows = sum(1 + (k % 20 == 0) for k, _ in orders if k % 7 != 3)
    assert got == {"No payment record": unpaid, "Has payment record": paid_rows}


def test_review_presence(star, orders):
    got = {r.review_status: r.order_count for r in all_reports()["ie1_review_presence"].build(star).collect()}
    done = [k for k, d in orders if d]
    without = sum(k % 5 == 2 for k in done)
    assert got == {"No review": without, "Has review": len(done) - without}


def test_unpaid_orders_leave_revenue_but_stay_in_delivery_figures(star, orders):
    done = [k for k, d in orders if d]
    assert all_reports()["b05_delivered_revenue"].build(star).first().delivered_orders == sum(k % 7 != 3 for k in done)
    assert all_reports()["p08_order_totals"].build(star).where("total_payment is null").count() == sum(k % 7 == 3 for k, _ in orders)


def test_forest_keeps_unscored_orders(star, orders):
    s = all_reports()["p14_isolation_forest"].build(star)
    missing = {k for k, d in orders if d and k % 7 == 3}
    unscored = {int(r.order_id) for r in s.where("if_score is null").collect()}
    assert missing <= unscored and s.where("if_score is null and if_flag").count() == 0
