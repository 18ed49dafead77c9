"""Versioned loads: verified, published whole or not at all."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from marketlens.plans.service import s01
from marketlens.session import scratch_path
from marketlens.sources.adapter import load_star
from marketlens.sources.versions import LoadFailed, current, load_version, retire, versions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF)


@pytest.fixture
def root(spark):
    return scratch_path(spark, "versions")


def test_load_publish_and_retire(spark, star, root):
    with pytest.raises(FileNotFoundError):
        current(spark, root)
    rows = load_version(star, root).collect()
    assert [r.load_order for r in sorted(rows, key=lambda r: r.load_order)] == list(range(1, 8))
    assert all(r.ok and r.expected_count == r.row_count > 0 for r in rows)
    fewer = replace(star, reviews=star.reviews.where("review_score > 3"), source=None)
    assert all(r.ok for r in load_version(fewer, root).collect())
    assert len(versions(spark, root)) == 2
    assert current(spark, root).reviews.count() == fewer.reviews.count()
    assert s01(current(spark, root)).count() == 1
    assert retire(spark, root) == 1 and len(versions(spark, root)) == 1
    assert current(spark, root).reviews.count() == fewer.reviews.count()
    assert retire(spark, root) == 0


def test_unexpected_counts_leave_the_version_before(spark, star, root):
    load_version(star, root)
    before = current(spark, root)
    counts = {t: getattr(star, t).count() for t in ("customers", "products", "sellers", "orders", "order_items", "payments", "reviews")}
    with pytest.raises(LoadFailed, match="payments: .* expected") as failed:
        load_version(star, root, counts | {"payments": counts["payments"] + 1})
    assert [r.table_name for r in failed.value.verdict if not r.ok] == ["payments"]
    assert len(versions(spark, root)) == 1 and before.payments.count() == counts["payments"]
    assert all(r.ok for r in load_version(star, root, counts).collect())


def test_broken_table_leaves_the_version_before(spark, star, root):
    load_version(star, root)
    broken = replace(star, payments=star.payments.withColumn("payment_installments", F.raise_error(F.lit("broken")).cast("int")), source=None)
    with pytest.raises(Exception, match="broken"):
        load_version(broken, root)
    assert len(versions(spark, root)) == 1 and current(spark, root).orders.count() == star.orders.count()
