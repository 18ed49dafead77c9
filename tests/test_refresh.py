"""Refresh by month equals the full run, and touches changed months only."""

import pytest
from pyspark.sql import functions as F

from marketlens.plans import refresh as R
from marketlens.plans.pipeline import customer_features, monthly_sales
from marketlens.session import scratch_path
from marketlens.sources.adapter import load_star

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF)


def test_late_order_changes_its_month_only(spark, star):
    root, state = scratch_path(spark, "landing"), scratch_path(spark, "state")
    assert R.sales_of(spark, state).count() == 0
    frames = R.landing(star)
    late = star.orders.where("order_status = 'delivered'").orderBy("order_id").first()
    is_late = F.col("order_id") == late.order_id
    R.land({t: df.where(~is_late) for t, df in frames.items()}, root)
    months = R.refresh(spark, root, state)
    assert len(months) == star.orders.select("year_month").distinct().count()
    before = {r.year_month: r.batch for r in R.record(spark, state).collect()}
    assert rows(R.sales_of(spark, state)) != rows(monthly_sales(star))
    assert R.refresh(spark, root, state) == []  # nothing has changed

    R.land({t: df.where(is_late) for t, df in frames.items()}, root)
    assert R.refresh(spark, root, state) == [late.year_month]
    assert rows(R.sales_of(spark, state)) == rows(monthly_sales(star))
    assert rows(R.features_of(spark, state)) == rows(customer_features(star))
    after = {r.year_month: r.batch for r in R.record(spark, state).collect()}
    assert {m for m in after if after[m] != before[m]} == {late.year_month}
    assert R.prune(spark, state) == 1  # the first record; its batch still holds the other months
    assert rows(R.features_of(spark, state)) == rows(customer_features(star))
    assert R.refresh(spark, root, state) == [] and R.prune(spark, state) == 0


def test_a_refresh_that_breaks_changes_nothing(spark, star, monkeypatch):
    root, state = scratch_path(spark, "landing"), scratch_path(spark, "state")
    frames = R.landing(star)
    odd = F.col("order_id").cast("bigint") % 2 == 1
    R.land({t: df.where(odd) for t, df in frames.items()}, root)
    R.refresh(spark, root, state)
    before = rows(R.sales_of(spark, state))
    R.land({t: df.where(~odd) for t, df in frames.items()}, root)
    with monkeypatch.context() as m:
        m.setattr(R, "month_states", lambda *t: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            R.refresh(spark, root, state)
    assert rows(R.sales_of(spark, state)) == before
    R.refresh(spark, root, state)
    assert rows(R.features_of(spark, state)) == rows(customer_features(star))


def test_only_changed_months_are_read(spark, star):
    root, state = scratch_path(spark, "landing"), scratch_path(spark, "state")
    R.land(R.landing(star), root)
    month = R.refresh(spark, root, state)[0]
    orders = spark.read.parquet(f"{root}/orders").where(F.col("year_month").cast("string").isin([month]))
    plan = orders._jdf.queryExecution().executedPlan().toString()
    assert f"year_month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_states_read_each_delivery_once(spark, tmp_path):
    """The months' rows come from those of the buyers, and repeated orders, payments
    and reviews, unpaid orders and unknown buyers count as in the joined rows."""
    orders = spark.sql("""
        SELECT order_id, customer_unique_id, order_status, timestamp_ntz'2020-01-05 10:00:00' + make_interval(0, 0, 0, day) AS order_purchase_timestamp,
               CAST(days AS decimal(6,1)) AS delivery_duration_days, is_late, '2020-01' AS year_month
        FROM VALUES ('1', 'a', 'delivered', 0, 2.5, true), ('1', 'a', 'delivered', 0, 2.5, true), ('2', 'a', 'delivered', 9, NULL, NULL),
                    ('3', NULL, 'delivered', 1, 4.0, false), ('4', 'b', 'delivered', 2, 1.0, true), ('5', 'b', 'shipped', 3, 1.0, true),
                    ('6', 'c', 'delivered', 20, 7.1, false) AS t (order_id, customer_unique_id, order_status, day, days, is_late)""")
    payments = spark.sql("""
        SELECT order_id, CAST(v AS decimal(10,2)) AS payment_value, '2020-01' AS year_month
        FROM VALUES ('1', 1.25), ('1', 2.00), ('2', 3.00), ('3', 0.50), ('4', NULL), ('5', 9.00) AS t (order_id, v)""")
    reviews = spark.sql("""
        SELECT order_id, score AS review_score, '2020-01' AS year_month
        FROM VALUES ('1', 5), ('1', 2), ('2', NULL), ('3', 4), ('3', NULL), ('6', 1) AS t (order_id, score)""")
    root, state = str(tmp_path / "root"), str(tmp_path / "state")
    R.land({"orders": orders, "payments": payments, "reviews": reviews}, root)
    assert R.refresh(spark, root, state) == ["2020-01"]

    (month,) = R._state(spark, state, "months", R._MONTHS).collect()
    assert (month.order_count, month.c, month.cn) == (9, 4 * 325 + 300 + 2 * 50, 7)
    assert (month.r, month.rn, month.d, month.dn, month.late) == (2 * 7 + 4 + 1, 6, 4 * 25 + 2 * 40 + 10 + 71, 8, 5)
    assert str(month["last"]) == "2020-01-25 10:00:00"
    got = {r.customer_unique_id: (r.recency_days, r.frequency, r.monetary_cents) for r in R.features_of(spark, state).collect()}
    assert got == {"a": (11, 3, 950), None: (19, 1, 50)}  # b's payment has no value, c has none
    assert "order_count" in spark.read.parquet(f"{state}/batch-*/buyers").columns
