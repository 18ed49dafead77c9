"""Embedding near-duplicates by an exact metric range join (operator 10).

Cosine >= LEAST between unit vectors is distance <= EPS.  Pivots (vectors of
least hash) partition the vectors into cells of the nearest pivot.  A vector is
replicated to another cell if a partner could lie there: by the triangle
inequality it is within the cell's radius + EPS of the pivot and no more than 2
EPS farther from it than from its own pivot, and it lies within EPS of the plane
halfway between the two pivots.  Two vectors of a link would visit each other's
cell, so only one of any two cells receives the other's (in turn the lower and
the higher, by their numbers' sum).  Cells then join independently: each counts
the partners of its own vectors, and those of its visitors among its own.

Cells are dealt over blocks of bounded size, own vectors by replicated ones, so
a dense cell is split.  A block returns counts and, instead of links, a star for
each of its linked groups; components of the stars are the components of the
links.  Equal vectors are one node.

Where distances concentrate (random directions in many dimensions), every
vector is near every boundary and the work is that of comparing all blocks;
clustered embeddings prune.

Cases: see ``vectors`` for rows that link with nothing (they stay in the result
with 0 links); repeated ids are rows of their own; a null id takes part and
never names a component unless all its ids are null; empty table: no rows;
extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import arrow_rows, materialise, prepared, read_table
from marketlens.llm.components import connected_components
from marketlens.llm.vectors import cosine, matrix, node, unit, usable

LEAST = 0.95
#: Vectors that a cell is meant for, and most pivots (they are broadcast).
CELL, PIVOTS = 4096, 1024
#: Own and replicated vectors of a block.
OWN, OTHER = 4096, 8192
#: Room for rounding, in distance and cosine.
SLACK = 1e-9

_EPS = float(np.sqrt(2 - 2 * LEAST)) + SLACK


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dot products with the pivots and the nearest one (the first of equals)."""
    dots = x @ pivots.T
    return dots, dots.argmax(axis=1)


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * dots))


def replicas(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own cell of each unit vector, table of the cells that it has to visit,
    its own included)."""
    dots, own = _nearest(x, pivots)
    d = _distance(dots)
    mine = d[np.arange(len(x)), own][:, None]
    apart = _distance(pivots @ pivots.T)[own]
    plane = dots[np.arange(len(x)), own][:, None] - dots <= _EPS * apart + SLACK
    visit = (d <= radius + _EPS) & (d <= mine + 2 * _EPS) & plane
    visit[np.arange(len(x)), own] = True
    return own, visit


def receives(cell: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether a cell is the one of two that gets the other's vectors (both, if
    they are the same)."""
    return (cell == of) | (((cell + of) % 2 == 0) == (cell < of))


def _radii(nodes: DataFrame, pivots) -> np.ndarray:
    """Largest distance of each cell's vectors to its pivot."""

    def run(batches):
        for b in arrow_rows(batches):
            dots, own = _nearest(unit(matrix(b.column(0))), pivots.value)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(_distance(dots.max(axis=1)))], ["cell", "d"])

    got = nodes.select("embedding").mapInArrow(run, "cell int, d double").groupBy("cell").agg(F.max("d").alias("d")).toArrow()  # PIVOTS rows at most
    radius = np.full(len(pivots.value), -1.0)
    radius[got["cell"].to_numpy()] = got["d"].to_numpy()
    return radius


def _placed(nodes: DataFrame, pivots, radius) -> DataFrame:
    """cell, own, home, node, mult, embedding: each vector in its cell (own) and as
    a visitor of every cell that receives it and where it may have partners, its
    own included (home)."""

    def run(batches):
        for b in arrow_rows(batches):
            cell, visit = replicas(unit(matrix(b.column(2))), pivots.value, radius.value)
            visit &= receives(np.arange(visit.shape[1])[None, :], cell[:, None])
            row, to = np.nonzero(visit)
            take = pa.array(np.concatenate((np.arange(len(cell)), row)))
            cells = np.concatenate((cell, to)).astype(np.int32)
            mine = np.arange(len(cells)) < len(cell)
            home = cells == cell[np.concatenate((np.arange(len(cell)), row))]
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(mine), pa.array(home), *(c.take(take) for c in b.columns)], ["cell", "own", "home", "node", "mult", "embedding"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    return nodes.select("node", "mult", "embedding").mapInArrow(run, f"cell int, own boolean, home boolean, node long, mult long, embedding {kind}")


def block_links(own: pa.Table, others: pa.Table) -> list[tuple[int, int, int]]:
    """(node, links, root): for each own vector, and each visitor from another
    cell, the rows behind its partners, and for every vector of a link a common
    member of its linked group."""
    x, y = matrix(own["embedding"]), matrix(others["embedding"])
    xu, yu = unit(x), unit(y)
    xn, yn = own["node"].to_numpy(), others["node"].to_numpy()
    xm, ym = own["mult"].to_numpy(), others["mult"].to_numpy()
    up = {int(v): int(v) for v in np.concatenate((xn, yn))}

    def top(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    links, back = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    hint = yn.copy()  # a vector above each other one in its group
    for lo in range(0, len(x), 512):
        s = xu[lo : lo + 512] @ yu.T
        near = s >= LEAST - SLACK
        r, c = np.nonzero(near & (s < LEAST + SLACK))
        near[r, c] = cosine(x[lo + r], y[c]) >= LEAST
        near &= xn[lo : lo + 512, None] != yn[None, :]
        links[lo : lo + 512] = near @ ym
        back += xm[lo : lo + 512] @ near
        for i in np.flatnonzero(near.any(axis=1)):
            tops = {top(v) for v in np.unique(hint[near[i]]).tolist()} | {top(int(xn[lo + i]))}
            least = min(tops)
            for v in tops:
                up[v] = least
            hint[near[i]] = least
    back[others["home"].to_numpy()] = 0  # counted where they are own ones
    count = dict(zip(xn.tolist(), links.tolist()))
    for v, n in zip(yn.tolist(), back.tolist()):
        count[v] = count.get(v, 0) + n
    return [(v, count.get(v, 0), r) for v in up if (r := top(v)) != v or count.get(v, 0)]


def link(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    prepared(vectors)
    linked = reduce(DataFrame.union, [_linked(rows) for rows in usable(vectors, id_col, vec_col)])
    everyone = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].alias("embedding")).withColumn("node", node())
    out = everyone.select("vec_id", "node").join(linked, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(rows: DataFrame) -> DataFrame:
    """node, n_links, least (smallest id of its component) of vectors of one
    length."""
    spark = rows.sparkSession
    nodes = materialise(rows.groupBy("node").agg(F.first("embedding").alias("embedding"), F.count("*").alias("mult"), F.min("vec_id").alias("least")), "rangejoin-nodes")
    n = nodes.count()
    many = int(np.clip(-(-n // CELL), 1, PIVOTS))
    head = nodes.orderBy(F.xxhash64("node"), "node").limit(many).select("embedding").toArrow()
    if not n:
        return spark.createDataFrame([], "node long, n_links long, least long")
    pivots = spark.sparkContext.broadcast(unit(matrix(head["embedding"])))
    radius = spark.sparkContext.broadcast(_radii(nodes, pivots))
    return _joined(_placed(nodes, pivots, radius), nodes)


def _joined(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n_links, least (smallest id of its component) of every node."""
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.when(F.col("own"), 1)) / OWN).cast("int").alias("a"), F.ceil(F.count(F.when(~F.col("own"), 1)) / OTHER).cast("int").alias("b"))
    sizes = materialise(sizes, "rangejoin-sizes")  # PIVOTS rows at most
    dealt = placed.join(F.broadcast(sizes), "cell")
    spot = lambda k: f"cast(pmod(xxhash64(node), {k}) as int)"
    dealt = dealt.withColumn("at", F.expr(f"if(own, array({spot('a')}), sequence(0, a - 1))")).withColumn("by", F.expr(f"if(own, sequence(0, b - 1), array({spot('b')}))"))
    dealt = dealt.withColumn("at", F.explode("at")).withColumn("by", F.explode("by")).select("cell", "at", "by", "own", "home", "node", "mult", "embedding")
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy()
        got = block_links(table.filter(pa.array(own)), table.filter(pa.array(~own))) if own.any() and not own.all() else []
        return pa.table([pa.array(c, t) for c, t in zip(zip(*got) if got else ((), (), ()), schema.types)], schema=schema)

    found = materialise(dealt.groupBy("cell", "at", "by").applyInArrow(run, "node long, links long, root long"), "rangejoin-links")
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    all_ = nodes.select("node", "mult", "least").join(counts, "node", "left").join(labels, "node", "left")
    all_ = all_.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    first = all_.groupBy("root").agg(F.min("least").alias("first"))
    return all_.join(first, "root").select("node", "n_links", F.col("first").alias("least"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "embeddings"))
