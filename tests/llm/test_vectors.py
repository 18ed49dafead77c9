"""Nearest neighbours and the range join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import ann, rangejoin

SCHEMA = "vec_id long, embedding array<double>, label int, node string, score string, rank int"


def vectors(seed=2, n=500, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    v = [(centres[rng.integers(12)] + rng.standard_normal(dims) * rng.choice([0.02, 0.1, 0.3])).tolist() for _ in range(n)]
    v += [v[0]] * 40 + [[3 * x for x in v[1]]] * 4 + [None, [0.0] * dims, [1.0, None] + [0.0] * (dims - 2), [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), []]
    v += [(np.array(v[3]) + rng.standard_normal(dims) * 0.001).tolist() for _ in range(80)]
    return v


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def frame(spark, v, ids=None):
    return spark.createDataFrame([(i, x, 0, "n", "s", 1) for i, x in zip(ids or range(len(v)), v)], SCHEMA)


def brute_links(v):
    ok = [i for i in range(len(v)) if usable(v[i])]
    u = np.array([v[i] for i in ok])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = np.arange(len(ok))
    for _ in range(len(ok)):
        new = np.minimum(comp, np.where(near, comp[None, :], len(ok)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    out = {i: (0, i, True) for i in range(len(v))}
    for k, i in enumerate(ok):
        c = ok[comp[k]]
        out[i] = (int(near[k].sum()), c, c == i)
    return out


@pytest.mark.parametrize("cell", [4096, 20])
def test_range_join(spark, cell, monkeypatch):
    """With one cell, and with many cells and blocks."""
    monkeypatch.setattr(rangejoin, "CELL", cell)
    monkeypatch.setattr(rangejoin, "OWN", cell)
    monkeypatch.setattr(rangejoin, "OTHER", cell)
    v = vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rangejoin.link(frame(spark, v)).collect()}
    assert got == brute_links(v)


def test_replicas_cover_every_link():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 5)) + np.array([2, 0, 0, 0, 0])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = x[:30]
    dots, own = rangejoin._nearest(x, pivots)
    d = rangejoin._distance(dots.max(axis=1))
    radius = np.array([d[own == c].max(initial=-1) for c in range(30)])
    cell, visit = rangejoin.replicas(x, pivots, radius)
    a, b = np.nonzero(x @ x.T >= 0.95)
    assert visit[a, cell[b]].all() and visit.mean() < 0.9


def nearest(v, i, k=5):
    ok = [j for j in range(len(v)) if usable(v[j]) and j != i]
    a = np.array(v[i])
    s = [(-float(np.dot(a, v[j]) / (np.linalg.norm(a) * np.linalg.norm(v[j]))), j) for j in ok]
    return sorted((round(x, 9), j) for x, j in s)[:k]


def test_search(spark):
    v = vectors(seed=4, n=900, dims=16)
    got = {}
    for r in ann.search(frame(spark, v), F.expr("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i in range(0, len(v), 20) if usable(v[i])]
    assert sorted(got) == asked
    hit = 0
    for i in asked:
        rows = sorted(got[i])
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and i not in [r[1] for r in rows]
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        for _, j, s in rows:
            a, b = np.array(v[i]), np.array(v[j])
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
        hit += len({r[1] for r in rows} & {j for _, j in nearest(v, i)})
    assert hit / (5 * len(asked)) >= 0.9


def test_ties_go_to_the_smaller_id(spark):
    v = [[1.0, 0.0]] * 9 + [[0.0, 1.0]] * 2
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(frame(spark, v), F.expr("vec_id in (0, 3, 8)")).collect())
    assert [x[2] for x in got] == [1, 2, 3, 4, 5, 0, 1, 2, 4, 5, 0, 1, 2, 3, 4]


def test_fewer_candidates_than_wanted(spark):
    v = [[1.0, 0.0], [-1.0, 0.1], [0.0, -1.0]]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(frame(spark, v), F.expr("vec_id >= 0")).collect())
    assert got == [(0, 1, 2), (0, 2, 1), (1, 1, 2), (1, 2, 0), (2, 1, 0), (2, 2, 1)]
    assert ann.search(frame(spark, v[:1]), F.expr("vec_id >= 0")).count() == 0


def test_hot_group_is_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", 16)
    v = vectors(seed=4, n=300, dims=8)
    got = {}
    for r in ann.search(frame(spark, v), F.expr("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[i] & {j for _, j in nearest(v, i)}) for i in got)
    assert hit / (5 * len(got)) >= 0.9


def test_no_vector_comes_to_the_driver(spark, monkeypatch):
    """The sample that fits the probes grew with the vectors' length there."""

    def driver(*_):
        raise AssertionError("vectors on the driver")

    monkeypatch.setattr(ann.Tables, "fit", driver)
    got = ann.search(frame(spark, vectors(n=60, dims=40)), F.expr("vec_id % 20 = 0"))
    assert got.count() == 5 * got.select("query_id").distinct().count() > 0


def test_null_ids_and_repeats(spark):
    v = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]]
    df = frame(spark, v, [None, 4, 4])
    rows = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in rangejoin.link(df).collect()), key=str)
    assert rows == [(4, 0, 4, True), (4, 1, 4, True), (None, 1, 4, False)]


def test_empty(spark):
    df = frame(spark, [])
    assert rangejoin.link(df).count() == 0 and ann.search(df, F.expr("vec_id % 50 = 0")).count() == 0


def test_every_length_is_compared(spark):
    """Vectors of the rarer lengths link and are found among their own."""
    long, short = vectors(n=120), vectors(seed=3, n=60, dims=4)[:100]
    df = frame(spark, long + short)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rangejoin.link(df).collect()}
    at = len(long)
    assert got == brute_links(long) | {at + i: (n, at + c, k) for i, (n, c, k) in brute_links(short).items()}
    found = {}
    for r in ann.search(df, F.expr(f"vec_id in (0, 60, {at}, {at + 30})")).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(v) for q, v in found.items()} == {0: 5, 60: 5, at: 5, at + 30: 5}
    assert all((v >= at) == (q >= at) for q, some in found.items() for v in some)


def test_unusable_vectors_beside_what_is_left_of_them(spark):
    """Null and non-finite components link with nothing, not even with vectors
    that equal the rest of theirs."""
    v = [[1.0, 2.0], [1.0, 2.0], [1.0, 2.0, None], [None, 1.0, 2.0], [1.0, None, 2.0], [float("nan"), 1.0, 2.0], [1.0, 2.0, float("inf")], [None, None], [], None, [0.0, 0.0], [3.0], [None, 3.0], [3.0, None], [3.0]]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rangejoin.link(frame(spark, v)).collect()}
    want = {i: (0, i, True) for i in range(len(v))} | {0: (1, 0, True), 1: (1, 0, False), 11: (1, 11, True), 14: (1, 11, False)}
    assert got == want
    found = {r.query_id for r in ann.search(frame(spark, v), F.expr("vec_id >= 0")).collect()}
    assert found == {0, 1, 11, 14}
