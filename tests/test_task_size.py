"""What one task takes in: bounded splits and shuffle reads, and no grouping that
keeps nearly a row for each of its input."""

import re
import types

from marketlens.operators import kmeans, segments
from marketlens.plans import pipeline
from marketlens.plans.registry import all_reports
from marketlens.session import _TASK_INPUT, bound_tasks
from marketlens.sources.adapter import load_star

SMALL = "/root/testdata/sf0.001"


def test_sizes_are_set_where_the_cluster_sets_none():
    held = {"spark.sql.files.maxPartitionBytes": "64m"}
    conf = types.SimpleNamespace(get=lambda k, d=None: held.get(k, d), set=held.__setitem__)
    bound_tasks(types.SimpleNamespace(conf=conf))
    assert held == _TASK_INPUT | {"spark.sql.files.maxPartitionBytes": "64m"}


def test_reading_the_tables_bounds_tasks(spark):
    load_star(spark, SMALL)
    assert all(spark.conf.get(k, None) for k in _TASK_INPUT)


def grouped(spark, key):
    """Columns of every grouping in the report's plan."""
    plan = all_reports()[key].build(load_star(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    return [re.findall(r"(\w+)#", keys) for keys in re.findall(r"Aggregate \[([^\]]*)\]", plan)]


def test_category_reviews_group_by_category_only(spark):
    assert {tuple(g) for g in grouped(spark, "b13_category_reviews")} == {("category",)}


def test_states_are_not_grouped_by_seller_and_order(spark):
    for key in ("ig2_seller_state", "ih2_delivery_by_seller_state"):
        assert not any({"seller_id", "order_id"} <= set(g) for g in grouped(spark, key)), key


def test_category_revenue_is_summed_once(spark):
    plan = all_reports()["ic2_category_performance"].build(load_star(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    inner = [line for line in plan.splitlines() if re.search(r"Aggregate \[category#\d+, order_id#\d+\]", line)]
    assert len(inner) == 1 and inner[0].count("sum(") == 1


def test_integrity_keeps_a_counter_per_reference_of_a_parent(spark):
    rows = pipeline.integrity(pipeline.star_frames(load_star(spark, SMALL)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    keys = next(line for line in plan.splitlines() if re.search(r"Aggregate \[domain#\d+, k1#\d+, k2#\d+\]", line))
    assert keys.count("sum(") == 2 + 3  # own, missing, and at most three tables that name a parent


def test_all_cluster_numbers_move_in_one_round(spark, monkeypatch):
    rows = [(i * i % 997, (i * 31) % 89, i % 7) for i in range(400)]
    z = spark.createDataFrame(rows, "z0 long, z1 long, z2 long").repartition(3)
    alone = {k: kmeans.fit_all(z, [k], segments.TURNED)[k] for k in (2, 3, 4)}
    assert kmeans.fit_all(z, [2, 3, 4], segments.TURNED) == alone
    assert kmeans.fit(z, 3, segments.TURNED) == alone[3]
