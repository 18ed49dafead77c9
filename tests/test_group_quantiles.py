"""Quantiles by key against numpy, with a key of a third of the rows."""

import math

import numpy as np
import pytest

from marketlens.operators.group_quantiles import group_quantiles

PROBS = {"p02": 0.02, "p25": 0.25, "p50": 0.5, "p75": 0.75, "top": 1.0}


def _same(got, rows, cols):
    groups = {}
    for k, *vs in rows:
        groups.setdefault(k, []).append(vs)
    assert {r.k for r in got} == set(groups)
    for r in got:
        for i, c in enumerate(cols):
            vs = [v[i] for v in groups[r.k] if v[i] is not None]
            for name, p in PROBS.items():
                want = float(np.quantile(vs, p)) if vs else None
                have = r[f"{c}__{name}"]
                assert have == want or math.isclose(have, want, rel_tol=1e-12), (r.k, c, name, have, want)


@pytest.mark.parametrize("n", [7, 400, 60_000])
def test_against_numpy(spark, n):
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 11}"
        rows.append((key, int(rng.integers(0, 10**6)), 5 if i % 2 else int(rng.integers(0, 9)), None if i % 7 else float(rng.normal())))
    rows += [("single", 3, 4, None), ("empty", None, None, None)]
    df = spark.createDataFrame(rows, "k string, a long, b long, c double").repartition(6)
    _same(group_quantiles(df, "k", ["a", "b", "c"], PROBS).collect(), rows, ["a", "b", "c"])


def test_hot_key_is_counted_before_it_is_shuffled(spark):
    """No exchange carries the rows themselves by key."""
    df = spark.range(1000).selectExpr("id % 2 as k", "id as a")
    kept = []
    import marketlens.operators.group_quantiles as g

    real = g._written
    g._written = lambda d, name: kept.append(d._jdf.queryExecution().executedPlan().toString()) or real(d, name)
    try:
        g.group_quantiles(df, "k", ["a"], PROBS)
    finally:
        g._written = real
    for plan in kept:
        for part in plan.split("Exchange hashpartitioning")[1:]:
            below = part.split("\n")[1:4]
            assert any("partial" in line or "Scan" in line or "Aggregate" in line or "Project" in line for line in below), plan


def test_empty(spark):
    assert group_quantiles(spark.createDataFrame([], "k int, a long"), "k", ["a"], PROBS).count() == 0
