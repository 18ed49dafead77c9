"""Exact quantiles of many columns for every value of a key, without a sort.

The passes are those of ``global_rank.discrete_quantiles``, once for all keys: an
aggregation with mergeable sketches gives each (key, column, quantile) a bracket,
a second one inside the brackets narrows them to about a millionth of the key's
rows (or one value with many copies), a third counts the values inside.  All
three aggregate before they shuffle, so a key with a third of the rows is split
over the tasks that read them; brackets stay a table, the driver sees nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .global_rank import _ACCURACY, _MARGIN

_STEPS = 200


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def group_quantiles(df: DataFrame, key: str, cols: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """One row per value of ``key`` (null is one): ``key`` and
    ``<col>__<prob name>``, linearly interpolated; null where a group has no
    value of the column."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).persist(StorageLevel.MEMORY_AND_DISK)
    grid = sorted({min(1.0, max(0.0, p + d)) for p in probs.values() for d in (-_MARGIN, _MARGIN)})
    targets = [(f"t{i}_{j}", f"v{i}", f"{c}__{name}", p) for i, c in enumerate(cols) for j, (name, p) in enumerate(probs.items())]

    stats = rows.groupBy("_key").agg(
        *[f(f"v{i}").alias(f"v{i}_{n}") for i in range(len(cols)) for n, f in (("n", F.count), ("min", F.min), ("max", F.max))],
        *[F.percentile_approx(f"v{i}", grid, _ACCURACY).alias(f"v{i}_q") for i in range(len(cols))],
    )
    first: list[Column] = []
    for t, v, _, p in targets:
        near = lambda q, v=v: F.element_at(f"{v}_q", grid.index(q) + 1)
        first += [
            ((F.col(f"{v}_n") - 1) * F.lit(p)).alias(f"{t}_pos"),
            (near(p - _MARGIN) if p > _MARGIN else F.col(f"{v}_min")).alias(f"{t}_lo"),
            (near(p + _MARGIN) if p < 1 - _MARGIN else F.col(f"{v}_max")).alias(f"{t}_hi"),
        ]
    brackets = _written(stats.select("_key", *first), "quantile-brackets")

    def bracketed(table: DataFrame) -> DataFrame:
        named = table.withColumnRenamed("_key", "_k")
        return rows.join(named, F.col("_key").eqNullSafe(F.col("_k"))).drop("_k")

    steps = [i / _STEPS for i in range(_STEPS + 1)]
    counts: list[Column] = []
    for t, v, _, _ in targets:
        x, lo, hi = F.col(v), F.col(f"{t}_lo"), F.col(f"{t}_hi")
        counts += [
            F.count(F.when(x < lo, 1)).alias(f"{t}_below"),
            F.max(F.when(x < lo, x)).alias(f"{t}_under"),
            F.min(F.when(x > hi, x)).alias(f"{t}_over"),
            F.count(F.when(x.between(lo, hi), 1)).alias(f"{t}_n"),
            F.percentile_approx(F.when(x.between(lo, hi), x), steps, _ACCURACY).alias(f"{t}_q"),
        ]
    inside = bracketed(brackets).groupBy("_key").agg(*counts).withColumnRenamed("_key", "_k")
    inside = brackets.join(inside, F.col("_key").eqNullSafe(F.col("_k"))).drop("_k")
    narrow: list[Column] = []
    for t, _, _, _ in targets:
        share, n = F.col(f"{t}_pos") - F.col(f"{t}_below"), F.nullif(F.col(f"{t}_n"), F.lit(0))
        low = F.floor(F.greatest(F.lit(0.0), F.floor(share) / n - _MARGIN) * _STEPS).cast("int")
        high = F.ceil(F.least(F.lit(1.0), (F.ceil(share) + 1) / n + _MARGIN) * _STEPS).cast("int")
        narrow += [
            F.col(f"{t}_pos"),
            F.col(f"{t}_under"),
            F.col(f"{t}_over"),
            F.when(low > 0, F.get(f"{t}_q", low)).otherwise(F.col(f"{t}_lo")).alias(f"{t}_lo"),
            F.when(high < _STEPS, F.get(f"{t}_q", high)).otherwise(F.col(f"{t}_hi")).alias(f"{t}_hi"),
        ]
    brackets = _written(inside.select("_key", *narrow), "quantile-brackets")

    least = F.lit(float("-inf"))
    picked = []
    for t, v, _, _ in targets:
        value = F.when(F.col(v) < F.col(f"{t}_lo"), least).when(F.col(v) <= F.col(f"{t}_hi"), F.col(v))
        picked.append(F.struct(F.lit(t).alias("t"), value.alias("v"), F.floor(f"{t}_pos").alias("lo"), F.ceil(f"{t}_pos").alias("hi")))
    values = bracketed(brackets).select("_key", F.explode(F.array(*picked)).alias("r")).select("_key", "r.*").where("v is not null")
    counted = values.groupBy("_key", "t", "lo", "hi", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.withColumn("end", F.sum("n").over(Window.partitionBy("_key", "t").orderBy("v")))  # the values of a bracket
    held = lambda at, t: F.max(F.when((F.col("t") == t) & (F.col(at) >= F.col("end") - F.col("n")) & (F.col(at) < F.col("end")), F.col("v")))
    found = placed.groupBy("_key").agg(*[held(at, t).alias(f"{t}_{at}v") for t, _, _, _ in targets for at in ("lo", "hi")]).withColumnRenamed("_key", "_k")
    whole = brackets.join(found, F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k")
    out = []
    for t, _, name, _ in targets:
        a = F.coalesce(F.nullif(F.col(f"{t}_lov"), least), F.col(f"{t}_under"))
        b = F.when(F.col(f"{t}_hiv").isNull(), F.col(f"{t}_over")).when(F.col(f"{t}_hiv") == least, a).otherwise(F.col(f"{t}_hiv"))
        out.append((a + (b - a) * (F.col(f"{t}_pos") - F.floor(f"{t}_pos"))).alias(name))
    result = _written(whole.select(F.col("_key").alias(key), *out), "group-quantiles")
    rows.unpersist()
    return result
