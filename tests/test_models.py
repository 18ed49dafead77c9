"""Model-backed reports: Isolation Forest, K-Means segments, K selection and the
anomaly reports (their rows are held against SQL in ``test_oracle``).

The distributed Isolation Forest scorer is checked against a plain recursive
path-length computation over the same forest on a small fixture, samples and
trees against their definition, K-Means against plain Lloyd rounds.
"""

import hashlib
import math
import os
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.operators import anomalies as A
from marketlens.operators import forest, kmeans
from marketlens.operators import segments as S
from marketlens.sources.adapter import load_star
from marketlens.sources.kept import forget, keep

SF = "/root/testdata/sf0.001"
FEATS = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF)


def _fixture(spark, n_normal=300):
    rng = np.random.default_rng(7)
    rows = [(f"n{i}", int(rng.normal(100, 5)), int(rng.integers(1, 3)), int(rng.normal(80, 4))) for i in range(n_normal)]
    rows += [("out0", 900, 9, 400), ("out1", 5, 8, 3), ("out2", 700, 1, 600)]
    return spark.createDataFrame(rows, "order_id string, f0 long, f1 long, f2 long")


def _brute_force_scores(nodes: pd.DataFrame, x: pd.DataFrame) -> dict[str, int]:
    trees = {t: g.set_index("node") for t, g in nodes.groupby("tree")}
    unsuccessful = lambda n: 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def path(tree, node, row, depth):
        r = tree.loc[node]
        if r["feat"] < 0:
            return depth + unsuccessful(int(r["size"]))
        return path(tree, 2 * node + (row[int(r["feat"])] >= r["thr"]), row, depth + 1)

    out = {}
    for rec in x.itertuples(index=False):
        mean = sum(path(t, 1, (rec.f0, rec.f1, rec.f2), 0) for t in trees.values()) / len(trees)
        out[rec.order_id] = -(2.0 ** (-mean / unsuccessful(min(len(x), forest.SAMPLE))))
    return out


@pytest.mark.parametrize("n", [300, 90])
def test_forest_scores_equal_brute_force_and_rank_outliers_first(spark, n):
    x = _fixture(spark, n)
    nodes = forest.grow(x, "order_id", FEATS)
    table = nodes.toPandas()
    assert table["tree"].nunique() == forest.TREES
    # every tree is grown from min(SAMPLE, N) rows
    assert (table.loc[table["node"] == 1, "size"] == min(forest.SAMPLE, n + 3)).all()
    scored = forest.scored(x, nodes, FEATS).toPandas()
    expected = _brute_force_scores(table, x.toPandas())
    got = dict(zip(scored["order_id"], scored["raw_score"]))
    assert set(got) == set(expected)
    assert max(abs(got[k] / forest.SCORE - expected[k]) for k in got) < 1e-8
    lowest = scored.sort_values(["raw_score", "order_id"])["order_id"].head(3)
    assert set(lowest) == {"out0", "out1", "out2"}


def test_trees_follow_their_draws(spark):
    """Nodes hold the rows that their ancestors' thresholds send there, and
    leaves are where nothing can be split."""
    x = _fixture(spark)
    rows = forest.sample(x, "order_id", FEATS).toPandas()
    nodes = {(r.tree, r.node): r for r in forest.grow(x, "order_id", FEATS).toPandas().itertuples()}
    for tree in (0, 57, 99):
        held = {1: rows[rows["tree"] == tree][FEATS].to_numpy()}
        for node in range(1, 2 << forest.DEPTH):
            if node not in held:
                assert (tree, node) not in nodes
                continue
            sub, n = held[node], nodes[tree, node]
            assert n.size == len(sub)
            spread = [i for i in range(3) if len(sub) and sub[:, i].max() > sub[:, i].min()]
            if node >= 1 << forest.DEPTH or not spread:
                assert n.feat == -1
                continue
            draw = lambda what: int(hashlib.md5(f"{what}{tree}:{node}".encode()).hexdigest()[:13], 16)
            assert n.feat == spread[draw("f") % len(spread)]
            lo, hi = sub[:, n.feat].min(), sub[:, n.feat].max()
            assert lo < n.thr < hi and n.thr == lo + (draw("t") + 0.5) / 2**52 * (hi - lo)
            held[2 * node], held[2 * node + 1] = sub[sub[:, n.feat] < n.thr], sub[sub[:, n.feat] >= n.thr]


@pytest.mark.parametrize("n", [0, 1, 40, 300, 30_000])
def test_samples_are_exact_and_without_replacement(spark, n):
    x = spark.range(n).select(F.col("id").alias("key"), F.col("id").alias("v"))
    rows = forest.sample(x, "key", ["v"]).toPandas()
    assert len(rows) == forest.TREES * min(n, forest.SAMPLE)
    for _, g in rows.groupby("tree"):
        assert len(g) == min(n, forest.SAMPLE) == g["f0"].nunique()
    if n > forest.TREES * forest.SAMPLE:  # disjoint then
        assert rows["f0"].nunique() == len(rows)
        order = sorted(range(n), key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i))
        assert set(rows.loc[rows["tree"] == 3, "f0"].astype(int)) == set(order[3 * 256 : 4 * 256])


def test_sampling_costs_one_hash_a_row(spark):
    x = _fixture(spark)
    plan = forest.sample(x, "order_id", FEATS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 2 and "xxhash64" not in plan


def test_forest_does_not_depend_on_partitions(spark):
    x = _fixture(spark, 120)
    a, b = (forest.grow(x.repartition(p), "order_id", FEATS).toPandas().sort_values(["tree", "node"]).reset_index(drop=True) for p in (1, 13))
    pd.testing.assert_frame_equal(a, b)


def test_forest_of_nothing(spark):
    x = _fixture(spark).limit(0)
    assert forest.scored(x, forest.grow(x, "order_id", FEATS), FEATS).count() == 0
    same = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 1, 1), ("c", 1, 1, None)], "order_id string, f0 long, f1 long, f2 long")
    scores = {r.order_id: r.raw_score for r in forest.scored(same, forest.grow(same.na.drop(), "order_id", FEATS), FEATS).collect()}
    assert scores["a"] == scores["b"] is not None and scores["c"] is None


def test_isolation_scores_cover_complete_orders_and_flag_two_percent(star):
    feats = A.delivered_features(star)
    complete = feats.filter(F.col("total_payment_cents").isNotNull() & F.col("delivery_tenths").isNotNull()).count()
    s = A.isolation_scores(star)
    assert s.count() == feats.count()  # every delivered order, scored or not
    scored = s.filter("if_score is not null")
    n = scored.count()
    flagged = s.filter("if_flag").count()
    assert n == complete
    # the offset is the exact 2% quantile: at most ceil(2%·N) rows lie strictly below it
    assert 0 < flagged <= math.ceil(A.CONTAMINATION * n)
    assert s.filter(F.col("if_flag") != F.coalesce(F.col("if_score") < 0, F.lit(False))).count() == 0


def test_anomaly_build_runs_few_jobs(spark, star):
    """The features are joined once: jobs before the result stay few."""
    tracker = spark.sparkContext.statusTracker()
    forget(star, "isolation-forest")
    spark.sparkContext.setJobGroup("anomaly-build", "order anomalies")
    A.order_anomalies(star)
    jobs = tracker.getJobIdsForGroup("anomaly-build")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 50  # with the listing of the source's files; adaptive execution counts each exchange as a job


def test_anomaly_union_is_union_of_flags(star):
    u = A.order_anomalies(star)
    iqr_ids = {r.order_id for r in A.order_iqr(star).filter("iqr_flag").select("order_id").collect()}
    if_ids = {r.order_id for r in A.isolation_scores(star).filter("if_flag").select("order_id").collect()}
    rows = u.collect()
    assert {r.order_id for r in rows} == iqr_ids | if_ids
    assert all(r.both_flag == (r.order_id in iqr_ids and r.order_id in if_ids) for r in rows)
    assert all(r.level == "order" for r in rows)


def test_anomalies_report_limit_and_order(star):
    rep = A.anomalies_report(star, 5).collect()
    assert len(rep) == 5
    scores = [r.if_score for r in rep]
    assert scores == sorted(scores)
    assert all(r.total_flagged == r.order_anomalies + r.monthly_anomalies for r in rep)
    for bad in (0, 501):
        with pytest.raises(ValueError):
            A.anomalies_report(star, bad)


def test_score_histogram_counts_every_scored_order(star):
    h = A.e06(star).collect()
    assert sum(r.order_count for r in h) == A.isolation_scores(star).filter("if_score is not null").count()
    assert all(r.bin_end > r.bin_start for r in h)


def test_served_from_what_is_kept(spark, star, monkeypatch):
    """After p15 neither s10, e06 nor e07b grow a forest; p14 grows it anew, and
    s08 serves the segments of p11."""
    grown, fitted = [], []
    grow, fit = forest.grow, kmeans.fit
    monkeypatch.setattr(forest, "grow", lambda *a: grown.append(1) or grow(*a))
    monkeypatch.setattr(kmeans, "fit", lambda *a: fitted.append(1) or fit(*a))
    for name in ("isolation-forest", "order-anomalies", "customer-segments"):
        forget(star, name)
    n = A.p15(star).count()
    assert grown == [1]
    assert A.s10(star).first().order_anomalies == n and A.e06(star).count() and A.e07b(star).count() == 2 and A.p15(star).count() == n
    assert grown == [1]
    A.p14(star).count()
    assert grown == [1, 1]
    S.s08(star).count()
    S.s08(star).count()
    assert fitted == [1]
    S.p11(star).count()
    S.s08(star).count()
    assert fitted == [1, 1]


def test_changed_source_is_built_anew(spark, tmp_path, monkeypatch):
    grown = []
    grow = forest.grow
    monkeypatch.setattr(forest, "grow", lambda *a: grown.append(1) or grow(*a))
    source = f"{tmp_path}/sf"
    shutil.copytree(SF, source)
    a = {r.order_id for r in A.scored_orders(load_star(spark, source)).collect()}
    assert {r.order_id for r in A.scored_orders(load_star(spark, source)).collect()} == a and grown == [1]
    orders = pd.read_parquet(f"{SF}/orders.parquet")
    os.chmod(source, 0o755)
    os.remove(f"{source}/orders.parquet")
    orders.iloc[:-100].to_parquet(f"{source}/orders.parquet", coerce_timestamps="us")
    b = {r.order_id for r in A.scored_orders(load_star(spark, source)).collect()}
    assert grown == [1, 1] and b < a
    folder = next(f for f in os.listdir(f"{spark.conf.get('spark.checkpoint.dir')}/kept") if f.endswith(hashlib.md5(source.encode()).hexdigest()[:12]))
    assert len(os.listdir(f"{spark.conf.get('spark.checkpoint.dir')}/kept/{folder}")) == 1  # the version before is gone


def test_unfinished_builds_are_not_read(spark, star):
    forget(star, "test")
    frame = spark.range(5)
    with pytest.raises(ZeroDivisionError):
        keep(star, "test", 1, lambda: 1 / 0)
    first = keep(star, "test", 1, lambda: frame)
    os.remove(f"{first.inputFiles()[0].removeprefix('file://').rsplit('/', 1)[0]}/_SUCCESS")
    assert keep(star, "test", 1, lambda: spark.range(7)).count() == 7
    assert keep(star, "test", 2, lambda: spark.range(8)).count() == 8  # other parameters


def _plain_lloyd(z, k, turned):
    """Rounds over rows in plain integers."""
    at = lambda col, p: sorted(r[col] for r in z)[math.floor((len(z) - 1) * p)]
    centres = [tuple(at(i, (2 * (k - 1 - j if t else j) + 1) / (2 * k)) for i, t in enumerate(turned)) for j in range(k)]
    pick = lambda r: min(range(k), key=lambda j: (sum((a - b) ** 2 for a, b in zip(r, centres[j])), j))
    while True:
        groups = {j: [r for r in z if pick(r) == j] for j in range(k)}
        half_away = lambda s, n: (1 if s >= 0 else -1) * ((2 * abs(s) + n) // (2 * n))
        moved = [tuple(half_away(sum(r[i] for r in g), len(g)) for i in range(len(turned))) if (g := groups[j]) else centres[j] for j in range(k)]
        if moved == centres:
            return centres
        centres = moved


@pytest.mark.parametrize("k", [1, 2, 4, 7])
def test_kmeans_equals_plain_rounds(spark, k):
    rng = np.random.default_rng(k)
    rows = [tuple(int(v) for v in rng.normal(c, 200_000, 3)) for c in (-10**6, 0, 3 * 10**6) for _ in range(60)]
    z = spark.createDataFrame(rows, "z0 long, z1 long, z2 long")
    assert kmeans.fit(z, k, S.TURNED, rounds=500) == _plain_lloyd(rows, k, S.TURNED)


def test_standardised(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (6, 5)], "a long, b long")
    got = [tuple(r) for r in kmeans.standardised(df, {"a": F.col("a"), "b": F.col("b")}).select("z0", "z1").orderBy("z0").collect()]
    x = np.array([1, 2, 6])
    assert got == [(int(v), 0) for v in np.rint((x - 3) / x.std(ddof=1) * 1e6)]
    assert kmeans.standardised(df.limit(0), {"a": F.col("a")}).count() == 0


@pytest.mark.parametrize("partitions", ["3", "211"])
def test_segments_do_not_depend_on_partitions(spark, star, partitions):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    want = sorted(map(str, S.segment_customers(star).collect()))
    try:
        spark.conf.set(key, partitions)
        assert sorted(map(str, S.segment_customers(star).collect())) == want
    finally:
        spark.conf.set(key, before)


def test_segments_are_as_tight_as_those_of_other_starts(spark, star):
    """The quantile start ends within a tenth of MLlib's best of five."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    z = S.rfm_vectors(star).select("z0", "z1", "z2")
    centres = kmeans.fit(z, S.K, S.TURNED)
    rows = np.array([tuple(r) for r in z.collect()], float)
    cost = ((rows[:, None, :] - np.array(centres, float)) ** 2).sum(axis=2).min(axis=1).sum()
    v = VectorAssembler(inputCols=["z0", "z1", "z2"], outputCol="features").transform(z)
    best = min(KMeans(k=S.K, seed=s).fit(v).summary.trainingCost for s in range(5))
    assert cost <= 1.1 * best


def test_segments_cover_the_buyers(star):
    seg = S.segment_customers(star)
    rows = sorted((r.customer_unique_id, r.segment) for r in seg.select("customer_unique_id", "segment").collect())
    assert len(rows) == S.rfm_vectors(star).count() == len({r[0] for r in rows})
    assert {r[1] for r in rows} == {S.LOYAL, S.CHAMPIONS, S.RECENT, S.INACTIVE}


def test_segmentation_summary_totals(star):
    summ = S.segmentation_summary(star).collect()
    assert sum(r.customer_count for r in summ) == S.rfm_vectors(star).count()
    assert abs(sum(r.pct_of_total for r in summ) - 100.0) <= 0.2
    monetary = [r.avg_monetary for r in summ]
    assert monetary == sorted(monetary, reverse=True)


def test_name_clusters_is_a_bijection_under_label_permutation():
    prof = [(0, 30.0, 1.0, 80.0), (1, 300.0, 1.0, 40.0), (2, 100.0, 3.0, 300.0), (3, 90.0, 1.0, 900.0)]
    names = S.name_clusters(prof)
    permuted = S.name_clusters([(3 - c, r, f, m) for c, r, f, m in prof])
    assert sorted(names.values()) == sorted(permuted.values())
    assert {names[c] for c in names} == {permuted[3 - c] for c in names}
    assert all(names[c] == permuted[3 - c] for c in names)


def test_k_selection_rows(star):
    ks = S.p11b(star).collect()
    assert [r.k for r in ks] == S.K_CANDIDATES
    assert all(-1.0 <= r.silhouette <= 1.0 for r in ks)
