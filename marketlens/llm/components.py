"""Connected components of an edge table, by contraction.

Every node hooks to its smallest neighbour, hooks are shortened by pointer
jumping, and edges are rewritten to the hooks until none is left.  All tables
stay distributed; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import materialise

#: Each round at least halves the nodes that have edges.
MAX_ROUNDS = 64


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b (long).  Returns node, root for every node of an
    edge; root is the smallest node of its component.  Self edges and repeated
    edges are harmless; no edges give no rows."""
    labels = None
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for _ in range(MAX_ROUNDS):
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        hook = materialise(hook, "components-hook")
        for _ in range(2):
            nxt = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            hook = hook.join(nxt, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
        hook = materialise(hook, "components-jump")
        at = lambda c: hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        edges = edges.join(at("a"), "a").join(at("b"), "b").where("a_up <> b_up")
        edges = materialise(edges.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "components-edges")
        if labels is None:
            labels = hook.withColumnRenamed("up", "root")
        else:
            labels = materialise(
                labels.join(at("root"), "root", "left").select("node", F.coalesce("root_up", "root").alias("root")), "components-labels"
            )
        if edges.isEmpty():
            return labels
    raise RuntimeError("components did not settle")
