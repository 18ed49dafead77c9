"""Integrity checks on tables with planted faults, against plain counting."""

from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from marketlens.plans.pipeline import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, integrity, key_rows, star_frames
from marketlens.sources.adapter import load_star

SF = "/root/testdata/sf0.001"


def plainly(frames):
    rows = {t: [r.asDict() for r in df.collect()] for t, df in frames.items()}
    out = {}
    for child, ck, parent, pk in FOREIGN_KEYS:
        there = {r[pk] for r in rows[parent]} - {None}
        out[f"orphan {child}.{ck} -> {parent}"] = sum(r[ck] not in there for r in rows[child])
    for t, keys in PRIMARY_KEYS.items():
        out[f"duplicate key {t}({', '.join(keys)})"] = sum(n - 1 for n in Counter(tuple(r[k] for k in keys) for r in rows[t]).values())
    for t, cols in NOT_NULL.items():
        out[f"null required column {t}"] = sum(any(r[c] is None for c in cols) for r in rows[t])
    return out


def found(frames):
    return {r.check_name: r.violations for r in integrity(frames).collect()}


@pytest.fixture(scope="module")
def broken(spark):
    st = load_star(spark, SF)
    k = F.col("order_id").cast("bigint")
    hide = lambda df, c, n: df.withColumn(c, F.when(k % n != 0, F.col(c)))
    frames = star_frames(replace(
        st,
        customers=st.customers.where(F.substring("customer_id", 2, 9).cast("bigint") % 7 != 0).unionByName(st.customers.limit(4)),
        products=st.products.unionByName(st.products.limit(3)).withColumn("product_id", F.when(F.col("product_id") != "5", F.col("product_id"))),
        sellers=st.sellers.where("seller_id <> '1'").withColumn("seller_city", F.when(F.col("seller_id") != "2", F.col("seller_city"))),
        orders=hide(st.orders.unionByName(st.orders.where(k % 11 == 0)), "order_status", 13),
        order_items=hide(st.order_items, "product_id", 9),
        payments=st.payments.unionByName(st.payments.where(k % 5 == 0)).unionByName(st.payments.limit(2).withColumn("order_id", F.lit(None).cast("string"))),
        reviews=hide(st.reviews, "order_id", 17),
        source=None,
    ))
    return {t: df.cache() for t, df in frames.items()}


def test_planted_faults(broken):
    want = plainly(broken)
    assert found(broken) == want
    assert sum(v > 0 for v in want.values()) >= 13


def test_sound_tables_and_empty_ones(spark):
    frames = star_frames(load_star(spark, SF))
    assert set(found(frames).values()) == {0}
    empty = {t: df.limit(0) for t, df in frames.items()}
    assert set(found(empty).values()) == {0} and len(found(empty)) == 20
    assert found(frames | {"sellers": empty["sellers"]})["orphan order_items.seller_id -> sellers"] == frames["order_items"].count()


def test_one_exchange_for_all_keys(spark):
    """Beside the item numbers' own, keys meet in one exchange, counted before."""
    frames = star_frames(load_star(spark, SF))
    plan = integrity(frames)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(domain") == 1 and "LeftAnti" not in plan
    below = plan.split("hashpartitioning(domain")[1]
    assert "partial_sum" in below
    assert key_rows(frames).columns == ["domain", "k1", "k2", "kind", "missing"]
