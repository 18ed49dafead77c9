"""Isolation Forest (Liu, Ting & Zhou, 2008) whose every draw is a hash.

MLlib has none.  Samples, split features and thresholds come from md5 sums of
the row's key or of (tree, node), and path lengths are whole numbers, so a
forest does not depend on partitioning and SQL can regrow and rescore it
(``sql_forest``).

* Sampling: rows in the order of one hash of their key are a random permutation;
  tree t takes the ranks from t * m on, m = min(SAMPLE, N), modulo N.  A row
  costs one hash whatever the number of trees; only rows below a threshold that
  leaves a few hundred more than the forest needs are ranked (TREES * SAMPLE
  rows and a margin, a constant).
* Growing: one tree per group of at most SAMPLE rows.  Nodes are numbered as in
  a heap (root 1, children 2i and 2i + 1).
* Scoring: the forest (TREES * 511 nodes at most) is broadcast, rows are scored
  in Arrow batches that carry their features along.

Features are whole numbers; rows with a missing one have no score.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TREES = 100
SAMPLE = 256
DEPTH = 8  # log2 of SAMPLE
#: Path lengths count in billionths of an edge, scores in hundred millionths.
EDGE, SCORE = 10**9, 10**8

NODE_SCHEMA = "tree int, node int, feat int, thr double, size long"


def unsuccessful(n: int) -> int:
    """Average path length of an unsuccessful search in a binary tree of ``n``
    points, in billionths."""
    if n <= 1:
        return 0
    if n == 2:
        return EDGE
    return round(EDGE * (2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n))


def _draw(what: str, tree: int, node: int) -> int:
    """52 bits."""
    return int(hashlib.md5(f"{what}{tree}:{node}".encode()).hexdigest()[:13], 16)


def sample(x: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(tree, f0, f1, ...): the rows of every tree.  ``x`` is read twice; write
    it before if it is costly."""
    n = x.count()
    need = min(n, TREES * SAMPLE)
    u = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    rows = x.select(u.alias("u"), F.col(key).alias("key"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    margin = 10 * math.isqrt(need) + 100
    while need + margin < n:
        below = rows.where(F.col("u") < (1 << 60) * (need + margin) // n)
        if below.count() >= need:
            rows = below
            break
        margin *= 2
    # a constant number of rows (TREES * SAMPLE and the margin) is ranked
    ranked = rows.withColumn("r", F.row_number().over(Window.orderBy("u", "key")) - 1).where(F.col("r") < need)
    size = min(SAMPLE, n)
    places = F.explode(F.sequence(F.col("r"), F.lit(max(TREES * size - 1, 0)), F.lit(max(n, 1))))
    return ranked.withColumn("place", places).select((F.col("place") / max(size, 1)).cast("int").alias("tree"), *[f"f{i}" for i in range(len(features))])


def _grow_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    x = pdf.drop(columns="tree").to_numpy(dtype="float64")
    rows = []

    def build(sub: np.ndarray, node: int) -> None:
        low, high = sub.min(axis=0), sub.max(axis=0)
        spread = np.flatnonzero(high > low)
        if node >= 1 << DEPTH or not len(spread):
            rows.append((tree, node, -1, 0.0, len(sub)))
            return
        feat = int(spread[_draw("f", tree, node) % len(spread)])
        lo, hi = float(low[feat]), float(high[feat])
        thr = lo + (_draw("t", tree, node) + 0.5) / (1 << 52) * (hi - lo)
        rows.append((tree, node, feat, thr, len(sub)))
        right = sub[:, feat] >= thr
        for part, child in ((sub[~right], 2 * node), (sub[right], 2 * node + 1)):
            if len(part):
                build(part, child)
            else:
                rows.append((tree, child, -1, 0.0, 0))

    build(x, 1)
    return pd.DataFrame(rows, columns=["tree", "node", "feat", "thr", "size"])


def grow(x: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """The forest's nodes (see NODE_SCHEMA; feat -1: leaf), TREES * (2 * SAMPLE - 1)
    rows at most."""
    return sample(x, key, features).groupBy("tree").applyInPandas(_grow_tree, NODE_SCHEMA)


def score_batches(nodes: pd.DataFrame, features: Sequence[str]):
    """A function for ``mapInArrow`` that appends raw_score to its columns: the
    score of Liu et al. with its sign turned (lower = stranger), in hundred
    millionths; null where a feature is null."""
    trees = []
    for _, g in nodes.sort_values(["tree", "node"]).groupby("tree"):
        feat, thr, path = np.full(2 << DEPTH, -1), np.zeros(2 << DEPTH), np.zeros(2 << DEPTH, np.int64)
        at = g["node"].to_numpy()
        feat[at], thr[at] = g["feat"].to_numpy(), g["thr"].to_numpy()
        path[at] = [EDGE * (n.bit_length() - 1) + unsuccessful(s) for n, s in zip(at.tolist(), g["size"].tolist())]
        trees.append((feat, thr, path))
    roots = nodes.loc[nodes["node"] == 1, "size"]
    norm = len(trees) * unsuccessful(int(roots.iloc[0])) if len(roots) else 0

    def scores(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x), np.int64)
        for feat, thr, path in trees:
            node = np.ones(len(x), np.int64)
            open_ = np.arange(len(x))  # rows not yet at a leaf
            while len(open_):
                f = feat[node[open_]]
                open_, f = open_[f >= 0], f[f >= 0]
                node[open_] = 2 * node[open_] + (x[open_, f] >= thr[node[open_]])
            total += path[node]
        if not norm:
            return np.full(len(x), -SCORE // 2)
        return -np.rint(SCORE * np.power(2.0, -(total.astype(np.float64) / norm))).astype(np.int64)

    def run(batches):
        for b in batches:
            x = np.column_stack([pc.cast(b.column(b.schema.get_field_index(c)), pa.float64()).to_numpy(zero_copy_only=False) for c in features]) if b.num_rows else np.zeros((0, len(features)))
            whole = ~np.isnan(x).any(axis=1)
            out = np.zeros(len(x), np.int64)
            if whole.any():
                out[whole] = scores(x[whole])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=~whole)], [*b.schema.names, "raw_score"])

    return run


def scored(rows: DataFrame, nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with raw_score."""
    schema = T.StructType([*rows.schema.fields, T.StructField("raw_score", T.LongType())])
    return rows.mapInArrow(score_batches(nodes.toPandas(), features), schema)  # the forest's size is bounded


# ---------------------------------------------------------------- the same in SQL


def _sql_draw(what: str) -> str:
    return f"CAST('0x' || substr(md5('{what}' || tree || ':' || node), 1, 13) AS BIGINT)"


def sql_forest(source: str, key: str, features: Sequence[str]) -> str:
    """CTEs that sample, grow and score level by level; the last one,
    ``forest_scores``, holds ``key`` and raw_score of every complete row of
    ``source``."""
    cols = [f"f{i}" for i in range(len(features))]
    whole = " AND ".join(f"{f} IS NOT NULL" for f in features)
    fs = ", ".join(cols)
    ctes = [
        f"fx AS MATERIALIZED (SELECT {key} AS k, {', '.join(f'CAST({f} AS DOUBLE) AS {c}' for f, c in zip(features, cols))} FROM {source} WHERE {whole})",
        f"fn AS MATERIALIZED (SELECT count(*) AS n, least(count(*), {SAMPLE}) AS m FROM fx)",
        f"franked AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(k AS VARCHAR)), 1, 15) AS BIGINT), k) - 1 AS r FROM fx)",
        f"fplaces AS (SELECT {fs}, unnest(range(r, {TREES} * m, n)) AS place FROM franked, fn WHERE r < {TREES} * m)",
        f"flevel0 AS MATERIALIZED (SELECT place // m AS tree, 1 AS node, {fs} FROM fplaces, fn)",
    ]
    pick = lambda list_: f"[{', '.join(list_)}]"
    for d in range(DEPTH + 1):
        stats = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols)
        ctes.append(f"fstat{d} AS MATERIALIZED (SELECT tree, node, count(*) AS size, {stats} FROM flevel{d} GROUP BY tree, node)")
        if d == DEPTH:
            break
        spread = f"list_filter({pick([f'CASE WHEN hi_{c} > lo_{c} THEN {i} END' for i, c in enumerate(cols)])}, lambda v: v IS NOT NULL)"
        ctes.append(f"fpick{d} AS (SELECT *, {spread} AS spread FROM fstat{d})")
        ctes.append(f"ffeat{d} AS (SELECT *, spread[1 + {_sql_draw('f')} % len(spread)] AS feat FROM fpick{d} WHERE len(spread) > 0)")
        low, high = pick([f"lo_{c}" for c in cols]), pick([f"hi_{c}" for c in cols])
        share = f"(CAST({_sql_draw('t')} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({1 << 52} AS DOUBLE)"
        ctes.append(f"fsplit{d} AS MATERIALIZED (SELECT tree, node, feat, {low}[feat + 1] + {share} * ({high}[feat + 1] - {low}[feat + 1]) AS thr FROM ffeat{d})")
        ctes.append(f"flevel{d + 1} AS MATERIALIZED (SELECT l.tree, 2 * l.node + CASE WHEN {pick(['l.' + c for c in cols])}[s.feat + 1] >= s.thr THEN 1 ELSE 0 END AS node, {', '.join('l.' + c for c in cols)} FROM flevel{d} l JOIN fsplit{d} s ON l.tree = s.tree AND l.node = s.node)")
    average = f"CASE WHEN size <= 1 THEN 0 WHEN size = 2 THEN {EDGE} ELSE CAST(round({EDGE} * (CAST(2 AS DOUBLE) * (ln(CAST(size - 1 AS DOUBLE)) + CAST(0.5772156649015329 AS DOUBLE)) - CAST(2 * (size - 1) AS DOUBLE) / size)) AS BIGINT) END"
    stats = " UNION ALL ".join(f"SELECT tree, node, size, CAST({d} AS BIGINT) AS depth FROM fstat{d}" for d in range(DEPTH + 1))
    ctes.append(f"fnodes AS MATERIALIZED (SELECT tree, node, depth * {EDGE} + {average} AS path FROM ({stats}))")
    ctes.append(f"fsplits AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM fsplit{d}' for d in range(DEPTH))})")
    ctes.append(f"fwalk0 AS (SELECT k, tree, 1 AS node, CAST(0 AS BIGINT) AS deep, {fs} FROM fx, (SELECT unnest(range({TREES})) AS tree))")
    for d in range(DEPTH):
        ctes.append(
            f"fwalk{d + 1} AS (SELECT w.k, w.tree, CASE WHEN s.tree IS NULL THEN w.node ELSE 2 * w.node + CASE WHEN {pick(['w.' + c for c in cols])}[s.feat + 1] >= s.thr THEN 1 ELSE 0 END END AS node, "
            f"CASE WHEN s.tree IS NULL THEN w.deep ELSE w.deep + 1 END AS deep, {', '.join('w.' + c for c in cols)} FROM fwalk{d} w LEFT JOIN fsplits s ON w.tree = s.tree AND w.node = s.node)"
        )
    # a child that no sampled row reaches holds nobody: its path is its depth
    ctes.append(f"fpaths AS (SELECT w.k, sum(coalesce(p.path, w.deep * {EDGE})) AS total FROM fwalk{DEPTH} w LEFT JOIN fnodes p ON w.tree = p.tree AND w.node = p.node GROUP BY w.k)")
    norm = f"(SELECT {TREES} * ({average.replace('size', 'm')}) FROM fn)"
    score = f"CASE WHEN {norm} = 0 THEN -{SCORE // 2} ELSE -CAST(round({SCORE} * pow(CAST(2 AS DOUBLE), -(CAST(total AS DOUBLE) / CAST({norm} AS DOUBLE)))) AS BIGINT) END"
    ctes.append(f"forest_scores AS MATERIALIZED (SELECT k, {score} AS raw_score FROM fpaths)")
    return ",\n".join(ctes)
