"""Order-grain pre-aggregation (u2).

Joining orders with payments, items and reviews multiplies rows (an order with
3 payments and 4 items yields 12 joined rows).  Reports that must reproduce
such fan-out arithmetic do it from these per-order aggregates instead
(``sum(payment) × item_rows``), so every fact table is reduced to one row per
order *before* the shuffle join, and the join is 1:1 on ``order_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import cents
from ..sources.adapter import Star


def payment_totals(st: Star) -> DataFrame:
    p = st.payments
    return p.groupBy("order_id").agg(
        F.sum(cents("payment_value")).alias("pay_cents"),
        F.sum("payment_value").alias("pay_sum"),
        F.count(F.lit(1)).alias("pay_rows"),
        F.max("payment_type").alias("pay_max_type"),
        F.max("payment_installments").alias("pay_max_inst"),
    )


def item_totals(st: Star) -> DataFrame:
    i = st.order_items
    # (order_id, order_item_id) is the table's primary key (p19 checks it), so
    # COUNT(DISTINCT order_item_id) per order is its row count: no distinct
    # aggregation, and the item numbering is pruned from the plan.
    return i.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_rows"),
        F.count(F.lit(1)).alias("item_ids"),
        F.sum("price").alias("price_sum"),
        F.sum("freight_value").alias("freight_sum"),
        F.sum(cents("price")).alias("price_cents"),
        F.sum(cents("freight_value")).alias("freight_cents"),
    )


def delivered_ids(st: Star) -> DataFrame:
    return st.delivered().select("order_id")
