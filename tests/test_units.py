"""Means are in the units that their columns name: money in whole units, days in
days.  The reports' SQL (which the reports must equal) against plain averages."""

import pytest

from marketlens.oracle.adapter_sql import with_star
from marketlens.plans.registry import all_reports

DELIVERED = "orders_en o WHERE o.order_status = 'delivered'"
PAID = "payments p JOIN orders_en o USING (order_id) WHERE o.order_status = 'delivered'"
SOLD = "order_items i JOIN orders_en o USING (order_id) WHERE o.order_status = 'delivered'"

# report, key columns, mean column, plain SQL of the same mean by the same keys
MEANS = [
    ("b05_delivered_revenue", [], "avg_payment_per_row", f"SELECT avg(payment_value) FROM {PAID}"),
    ("b15_monthly_sales", ["year_month"], "avg_payment_brl", f"SELECT year_month, avg(payment_value) FROM {PAID} GROUP BY 1"),
    ("b16_delivery_summary", [], "avg_delivery_days", f"SELECT avg(delivery_duration_days) FROM {DELIVERED}"),
    ("ih1_delivery_by_state", ["customer_state"], "avg_delivery_days", "SELECT customer_state, avg(delivery_duration_days) FROM orders_en o JOIN customers USING (customer_id) WHERE o.order_status = 'delivered' GROUP BY 1"),
    ("ic3_freight_ratio", ["category"], "avg_freight_brl", f"SELECT coalesce(product_category_name_english, product_category_name, 'unknown'), avg(freight_value) FROM products JOIN {SOLD} AND products.product_id = i.product_id GROUP BY 1".replace("JOIN order_items i JOIN orders_en o USING (order_id) WHERE", "JOIN order_items i USING (product_id) JOIN orders_en o USING (order_id) WHERE").replace(" AND products.product_id = i.product_id", "")),
    ("p09_monthly_sales", ["year_month"], "avg_order_value", f"SELECT year_month, sum(payment_value) / count(DISTINCT order_id) FROM {PAID} GROUP BY 1"),
    ("p09_monthly_sales", ["year_month"], "avg_delivery_days", f"SELECT year_month, avg(delivery_duration_days) FROM {DELIVERED} GROUP BY 1"),
    ("q15_monthly_dashboard", ["year_month"], "avg_delivery_days", f"SELECT year_month, avg(delivery_duration_days) FROM {DELIVERED} GROUP BY 1"),
    ("q12_seller_quartiles", ["quartile"], "avg_revenue", "SELECT quartile, avg(v) FROM (SELECT ntile(4) OVER (ORDER BY v, seller_id) AS quartile, v FROM (SELECT seller_id, sum(price) AS v FROM " + SOLD + " GROUP BY 1)) GROUP BY 1"),
    ("s04b_customer_summary", [], "avg_spend", f"SELECT sum(payment_value) / count(DISTINCT customer_unique_id) FROM customers JOIN payments p ON true JOIN orders_en o ON o.order_id = p.order_id AND o.customer_id = customers.customer_id WHERE o.order_status = 'delivered'"),
]


@pytest.mark.parametrize("report, keys, column, plain", MEANS, ids=[f"{m[0]}-{m[2]}" for m in MEANS])
def test_mean_is_in_its_unit(duck, report, keys, column, plain):
    got = duck.execute(all_reports()[report].oracle)
    names = [d[0] for d in got.description]
    rows = [dict(zip(names, r)) for r in got.fetchall()]
    want = {tuple(r[:-1]): float(r[-1]) for r in duck.execute(with_star(plain)).fetchall()}
    assert rows
    for r in rows:
        digits = 1 if "days" in column else 2
        assert abs(r[column] - want[tuple(r[k] for k in keys)]) <= 0.51 * 10**-digits, (r, want[tuple(r[k] for k in keys)])


def test_means_lie_between_the_extremes(duck):
    """Every report with a minimum and a maximum beside a mean."""
    seen = 0
    for key, low, mean, high in [
        ("b06_order_value_stats", "min_order_value_brl", "avg_order_value_brl", "max_order_value_brl"),
        ("ih1_delivery_by_state", "fastest_days", "avg_delivery_days", "slowest_days"),
        ("q12_seller_quartiles", "min_revenue", "avg_revenue", "max_revenue"),
        ("e07_anomaly_feature_dist", "p25_total_payment", "p50_total_payment", "max_total_payment"),
    ]:
        got = duck.execute(all_reports()[key].oracle)
        names = [d[0] for d in got.description]
        for r in got.fetchall():
            r = dict(zip(names, r))
            assert r[low] <= r[mean] <= r[high], (key, r)
            seen += 1
    assert seen > 20
