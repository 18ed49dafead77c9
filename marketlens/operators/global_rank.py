"""Global ROW_NUMBER / RANK / DENSE_RANK / NTILE / PERCENT_RANK and exact
quantiles without a single-partition window.

A window with an empty PARTITION BY plans as ``Exchange SinglePartition``:
one task sorts every row.  At customer, order or seller grain that does not
scale, so these helpers use the classic distributed ranking recipe:

1. ``repartitionByRange`` on the full ordering (value columns + unique
   tie-break).  Range bounds are sampled on the composite key, so even a value
   shared by a third of all rows is split over many partitions by its
   tie-break.
2. ``sortWithinPartitions`` and tag each row with its partition id and its
   position inside the partition (``monotonically_increasing_id`` encodes both).
3. Cut lineage with a reliable ``checkpoint`` (shared checkpoint folder) so the
   sampled bounds cannot change if a stage is recomputed after executor loss.
4. Per-partition counts (one row per partition — bounded by the partition
   count) → prefix offsets → broadcast join → global row number.

RANK is ``min(row_number)`` per distinct value (partial aggregation, so hot
values are combined map-side), DENSE_RANK is the row number over distinct
values, NTILE and PERCENT_RANK are arithmetic on row number / rank and N.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root

# (column name, ascending) pairs
OrderSpec = Sequence[tuple[str, bool]]


def _sort_cols(spec: OrderSpec) -> list[Column]:
    # MySQL/Spark convention: NULLs first ascending, last descending.
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in spec]


def global_row_number(
    df: DataFrame, order: OrderSpec, out: str = "_rn", num_partitions: int | None = None, count_out: str | None = None
) -> DataFrame:
    """Append ``out`` = ROW_NUMBER() OVER (ORDER BY order) (1-based), and the
    total row count as ``count_out`` if given.

    ``order`` must be a total order (end it with a unique key) for the result
    to be deterministic.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    sort_cols = _sort_cols(order)
    # Without an explicit count the exchange uses the cluster's shuffle
    # partition count and AQE may merge adjacent (small) ranges; partition ids
    # stay in range order either way and are frozen by the checkpoint below.
    ranged = df.repartitionByRange(num_partitions, *sort_cols) if num_partitions else df.repartitionByRange(*sort_cols)
    ranged = (
        ranged.sortWithinPartitions(*sort_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # One row per partition: a single-partition window here is bounded by the
    # partition count, not by the data.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        *([F.sum("_cnt").over(Window.partitionBy()).alias(count_out)] if count_out else []),
    )
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(out, (F.col("_off") + local + 1).cast("long"))
        .drop("_pid", "_mid", "_off")
    )


def add_rank(df: DataFrame, rn: str, values: Sequence[str], out: str = "_rank") -> DataFrame:
    """RANK() = smallest row number among rows with equal ordering values."""
    renamed = {v: f"_k{i}" for i, v in enumerate(values)}
    firsts = df.groupBy(*[F.col(v).alias(renamed[v]) for v in values]).agg(F.min(rn).alias(out))
    cond = [F.col(v).eqNullSafe(F.col(renamed[v])) for v in values]
    return df.join(firsts, cond, "inner").drop(*renamed.values())


def add_dense_rank(df: DataFrame, order: OrderSpec, out: str = "_dense_rank") -> DataFrame:
    """DENSE_RANK() = row number over the distinct ordering values."""
    values = [c for c, _ in order]
    renamed = {v: f"_k{i}" for i, v in enumerate(values)}
    distinct = df.select(*[F.col(v).alias(renamed[v]) for v in values]).distinct()
    numbered = global_row_number(distinct, [(renamed[c], asc) for c, asc in order], out=out)
    cond = [F.col(v).eqNullSafe(F.col(renamed[v])) for v in values]
    return df.join(numbered, cond, "inner").drop(*renamed.values())


def ntile(rn: Column, n: Column, buckets: int) -> Column:
    """NTILE(buckets) from a 1-based row number and the row count."""
    q = F.call_function("div", n, F.lit(buckets))
    r = n % buckets
    big = r * (q + 1)  # rows covered by the first r (larger) buckets
    return (
        F.when(rn <= big, F.call_function("div", rn - 1, q + 1) + 1)
        .otherwise(r + F.call_function("div", rn - big - 1, q) + 1)
        .cast("long")
    )


# ---------------------------------------------------------------- quantiles without a sort

_ACCURACY = 10000
_MARGIN = 4.0 / _ACCURACY


def discrete_quantiles(df: DataFrame, cols: Sequence[str], probs: dict[str, float], lower: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles of numeric columns (with ``lower`` the
    value at the position rounded down) by distributed selection, without a
    sort.

    Two aggregations with mergeable quantile sketches narrow each target rank
    down to a bracket of values that holds about a millionth of the rows (or one
    value with many copies).  A third pass counts, per target, the values of the
    bracket, with all smaller ones as one, and picks the order statistics from
    their running total.  Equal values are counted before they are shuffled, so
    a value of a third of all rows is no hot key; the driver sees the brackets
    and the result only.

    Returns one row with columns ``<col>__<prob name>``.
    """
    spark = df.sparkSession
    # the passes read only these columns: keep the narrow projection (memory,
    # spilling to disk) instead of recomputing the upstream joins
    df = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    grid = sorted({min(1.0, max(0.0, p + d)) for p in probs.values() for d in (-_MARGIN, _MARGIN)})
    stats = df.agg(
        *[F.count(c).alias(f"{c}__n") for c in cols],
        *[F.percentile_approx(c, grid, _ACCURACY).alias(f"{c}__q") for c in cols],
        *[f(c).alias(f"{c}__{f.__name__}") for c in cols for f in (F.min, F.max)],
    ).first()

    targets = {}  # key: (column, position, bracket)
    for c in cols:
        if not stats[f"{c}__n"]:
            continue
        at = dict(zip(grid, stats[f"{c}__q"]))
        for name, p in probs.items():
            lo = at[p - _MARGIN] if p > _MARGIN else stats[f"{c}__min"]
            hi = at[p + _MARGIN] if p < 1 - _MARGIN else stats[f"{c}__max"]
            targets[f"{c}__{name}"] = (c, (stats[f"{c}__n"] - 1) * p, lo, hi)

    result: dict[str, float] = {}
    if targets:
        steps = [i / 200 for i in range(201)]
        inside = df.agg(
            *[F.count(F.when(F.col(c) < lo, 1)).alias(f"{k}__below") for k, (c, _, lo, _) in targets.items()],
            *[F.max(F.when(F.col(c) < lo, F.col(c))).alias(f"{k}__under") for k, (c, _, lo, _) in targets.items()],
            *[F.min(F.when(F.col(c) > hi, F.col(c))).alias(f"{k}__over") for k, (c, _, _, hi) in targets.items()],
            *[F.count(F.when(F.col(c).between(lo, hi), 1)).alias(f"{k}__n") for k, (c, _, lo, hi) in targets.items()],
            *[F.percentile_approx(F.when(F.col(c).between(lo, hi), F.col(c)), steps, _ACCURACY).alias(f"{k}__q") for k, (c, _, lo, hi) in targets.items()],
        ).first()
        rows = []
        for k, (c, pos, lo, hi) in targets.items():
            n, share = inside[f"{k}__n"], pos - inside[f"{k}__below"]
            first = math.floor(max(0.0, math.floor(share) / n - _MARGIN) * 200)
            last = math.ceil(min(1.0, (math.ceil(share) + 1) / n + _MARGIN) * 200)
            lo, hi = inside[f"{k}__q"][first] if first else lo, inside[f"{k}__q"][last] if last < 200 else hi
            value = F.when(F.col(c) < lo, F.lit(float("-inf"))).when(F.col(c) <= hi, F.col(c))
            rows.append(F.struct(F.lit(k).alias("k"), value.alias("v"), F.lit(math.floor(pos)).alias("lo"), F.lit(math.ceil(pos)).alias("hi")))
        values = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("v is not null")
        counted = values.groupBy("k", "lo", "hi", "v").agg(F.count(F.lit(1)).alias("n"))
        running = F.sum("n").over(Window.partitionBy("k").orderBy("v"))  # the values of a bracket
        placed = counted.withColumn("end", running)
        held = lambda at: F.max(F.when((F.col(at) >= F.col("end") - F.col("n")) & (F.col(at) < F.col("end")), F.col("v")))
        for r in placed.groupBy("k").agg(held("lo").alias("a"), held("hi").alias("b")).collect():  # a row per target
            pos = targets[r["k"]][1]
            # in few rows the margin is less than a rank: the neighbours of the first bracket
            a = inside[f"{r['k']}__under"] if r["a"] in (None, float("-inf")) else r["a"]
            b = inside[f"{r['k']}__over"] if r["b"] is None else a if r["b"] == float("-inf") else r["b"]
            result[r["k"]] = a if lower else a + (b - a) * (pos - math.floor(pos))
    df.unpersist()
    fields = [f"{c}__{name}" for c in cols for name in probs]
    return spark.createDataFrame([tuple(result.get(f) for f in fields)], ", ".join(f"`{f}` double" for f in fields))
