"""Plan shape over every registered report: no cartesian products, and the
per-order item numbering is pruned from reports that do not read it."""

import pytest

from marketlens.plans.registry import all_reports
from marketlens.sources.adapter import load_star

SF = "/root/testdata/sf0.001"
# Reports that fit models or sample at build time: their plans are covered by
# the model tests, building them here would only repeat the fits.
MODEL_KEYS = {r.key for r in all_reports().values() if r.oracle is None}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF)


@pytest.mark.parametrize("key", sorted(k for k in all_reports() if k not in MODEL_KEYS))
def test_no_cartesian_product(star, key):
    plan = _plan(all_reports()[key].build(star))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan


@pytest.mark.parametrize("key", ["b08_top_categories_revenue", "p08_order_totals", "b20_order_summary"])
def test_item_numbering_pruned_when_unused(star, key):
    plan = _plan(all_reports()[key].build(star))
    assert "_salt" not in plan and "row_number" not in plan


def test_item_numbering_splits_orders(star):
    plan = _plan(star.order_items.select("order_id", "order_item_id"))
    # numbered per (order, salt); the only per-order window runs over salt-group sizes
    assert "hashpartitioning(order_id" in plan and "_salt" in plan


def test_item_numbers_dense_and_unique(spark, star):
    from pyspark.sql import functions as F

    per = star.order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("order_item_id").alias("d"),
        F.min("order_item_id").alias("lo"),
        F.max("order_item_id").alias("hi"),
    )
    bad = per.filter((F.col("n") != F.col("d")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n"))).count()
    assert bad == 0


def test_cluster_without_shared_checkpoint_dir_fails(spark, monkeypatch):
    from marketlens import session

    class FakeContext:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class FakeConf:
        def get(self, key, default=None):
            return default

    class FakeSession:
        sparkContext = FakeContext()
        conf = FakeConf()

    with pytest.raises(RuntimeError):
        session.checkpoint_root(FakeSession())
