"""K-Means in whole numbers, the same for any partitioning.

Features become integers: standardised, in millionths of a standard deviation.
Start centres are quantiles, all features at once (a feature that is better when
low turned round), so they do not depend on the rows' order.  Lloyd's rounds are
exact: squared distances, sums and counts are integers, centres are rounded,
ties go to the lower centre, an empty cluster keeps its centre.  A round is one
aggregation for all numbers of clusters that are tried; it ends when no centre moves.  SQL runs the
same rounds as CTEs (``sql_kmeans``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .global_rank import discrete_quantiles

#: A standard deviation in units, and most rounds.
UNIT, ROUNDS = 10**6, 40


def _rounded(total: int, n: int) -> int:
    """total / n, half away from zero."""
    q = (2 * abs(total) + n) // (2 * n)
    return -q if total < 0 else q


def standardised(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    """``df`` with z0, z1, ...: the features (integer columns) less their mean, in
    millionths of their standard deviation (0 for a constant)."""
    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c.cast("decimal(38,0)")).alias(f"{k}_{i}") for i, c in enumerate(features.values()) for k, f in (("s", F.sum), ("q", lambda c: F.sum(c * c)))],
    ).first()
    n = sums["n"]
    cols = {}
    for i, c in enumerate(features.values()):
        total, square = int(sums[f"s_{i}"] or 0), int(sums[f"q_{i}"] or 0)
        spread = math.sqrt(float(n * square - total * total) / float(n * (n - 1))) if n > 1 else 0.0
        mean = total / n if n else 0.0
        cols[f"z{i}"] = F.rint((c.cast("double") - mean) / spread * float(UNIT)).cast("long") if spread > 0 else F.lit(0).cast("long")
    return df.withColumns(cols)


def starts_of(z: DataFrame, ks: Sequence[int], turned: Sequence[bool]) -> dict[int, list[tuple[int, ...]]]:
    """For every k its centres at the quantiles (2j + 1) / 2k of every z column,
    found together."""
    cols = [f"z{i}" for i in range(len(turned))]
    at = lambda k, j: (2 * j + 1) / (2 * k)
    probs = {p: str(n) for n, p in enumerate(sorted({at(k, j) for k in ks for j in range(k)}))}
    q = discrete_quantiles(z, cols, {name: p for p, name in probs.items()}, lower=True).first()
    return {k: [tuple(int(q[f"{c}__{probs[at(k, k - 1 - j if t else j)]}"] or 0) for c, t in zip(cols, turned)) for j in range(k)] for k in ks}


def nearest(centres: list[tuple[int, ...]]) -> Column:
    """The number of the nearest centre, the lower one of equals."""
    far = [sum(((F.col(f"z{i}") - F.lit(v)) * (F.col(f"z{i}") - F.lit(v)) for i, v in enumerate(c)), F.lit(0)) for c in centres]
    return (F.array_position(F.array(*far), F.least(*far) if len(far) > 1 else far[0]) - 1).cast("int")


def fit_all(z: DataFrame, ks: Sequence[int], turned: Sequence[bool], rounds: int = ROUNDS) -> dict[int, list[tuple[int, ...]]]:
    """The centres for every k.  ``z`` is read once a round for all that still
    move; write it before."""
    centres = starts_of(z, ks, turned)
    sums = [F.sum(F.col(f"z{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(len(turned))]
    moving = list(ks)
    for _ in range(rounds):
        # a row per combination of clusters, which hold all of the rounds' sums
        found = z.groupBy(*[nearest(centres[k]).alias(f"c{k}") for k in moving]).agg(F.count(F.lit(1)).alias("n"), *sums).collect()
        still = []
        for k in moving:
            n, total = [0] * k, [[0] * len(turned) for _ in range(k)]
            for r in found:
                if (c := r[f"c{k}"]) is not None:
                    n[c] += r["n"]
                    total[c] = [t + int(r[f"s{i}"]) for i, t in enumerate(total[c])]
            moved = [tuple(_rounded(t, n[j]) for t in total[j]) if n[j] else c for j, c in enumerate(centres[k])]
            if moved != centres[k]:
                still.append(k)
            centres[k] = moved
        moving = still
        if not moving:
            break
    return centres


def fit(z: DataFrame, k: int, turned: Sequence[bool], rounds: int = ROUNDS) -> list[tuple[int, ...]]:
    """The centres for one k."""
    return fit_all(z, [k], turned, rounds)[k]


# ---------------------------------------------------------------- the same in SQL


def sql_kmeans(source: str, features: Sequence[str], k: int, turned: Sequence[bool], rounds: int = ROUNDS) -> str:
    """CTEs over ``source`` (with integer columns ``features``); the last one,
    ``clustered``, is the source with z columns and cluster.  More rounds than
    the centres need change nothing."""
    dims = range(len(features))
    stats = ", ".join(f"CAST(sum(CAST({f} AS HUGEINT)) AS HUGEINT) AS s{i}, CAST(sum(CAST({f} AS HUGEINT) * {f}) AS HUGEINT) AS q{i}" for i, f in enumerate(features))
    spread = lambda i: f"sqrt(CAST(n * q{i} - s{i} * s{i} AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE))"
    z = ", ".join(
        f"CASE WHEN n > 1 AND n * q{i} > s{i} * s{i} THEN CAST(round_even((CAST({f} AS DOUBLE) - CAST(s{i} AS DOUBLE) / CAST(n AS DOUBLE)) / {spread(i)} * CAST({UNIT} AS DOUBLE), 0) AS BIGINT) ELSE 0 END AS z{i}"
        for i, f in enumerate(features)
    )
    at = lambda i, j: f"(SELECT z{i} FROM zranked{i} WHERE place = CAST(floor((n - 1) * CAST({(2 * j + 1) / (2 * k)} AS DOUBLE)) AS BIGINT))"
    ctes = [
        f"zsums AS MATERIALIZED (SELECT CAST(count(*) AS HUGEINT) AS n, {stats} FROM {source})",
        f"zs AS MATERIALIZED (SELECT {source}.*, {z} FROM {source}, zsums)",
        *[f"zranked{i} AS MATERIALIZED (SELECT z{i}, row_number() OVER (ORDER BY z{i}) - 1 AS place, count(*) OVER () AS n FROM zs)" for i in dims],
    ]
    first = " UNION ALL ".join(f"SELECT {j} AS c, {', '.join(f'{at(i, k - 1 - j if t else j)} AS c{i}' for i, t in enumerate(turned))}" for j in range(k))
    ctes.append(f"centres0 AS MATERIALIZED ({first})")
    far = " + ".join(f"(z{i} - c{i}) * (z{i} - c{i})" for i in dims)
    for r in range(rounds):
        mean = lambda i: f"CAST(sign(sum(z{i})) * ((2 * abs(sum(z{i})) + count(*)) // (2 * count(*))) AS BIGINT)"
        near = f"SELECT {', '.join(f'any_value(z{i}) AS z{i}' for i in dims)}, arg_min(c, struct_pack(d := {far}, c := c)) AS c FROM znumbered, centres{r} GROUP BY nr"
        ctes.append(f"moved{r + 1} AS (SELECT c, {', '.join(f'{mean(i)} AS c{i}' for i in dims)} FROM ({near}) GROUP BY c)")
        ctes.append(f"centres{r + 1} AS MATERIALIZED (SELECT o.c, {', '.join(f'coalesce(m.c{i}, o.c{i}) AS c{i}' for i in dims)} FROM centres{r} o LEFT JOIN moved{r + 1} m ON m.c = o.c)")
    ctes.insert(2 + len(features), "znumbered AS MATERIALIZED (SELECT *, row_number() OVER () AS nr FROM zs)")
    ctes.append(f"znearest AS MATERIALIZED (SELECT nr, arg_min(c, struct_pack(d := {far}, c := c)) AS cluster FROM znumbered, centres{rounds} GROUP BY nr)")
    ctes.append("clustered AS MATERIALIZED (SELECT z.*, CAST(cluster AS INTEGER) AS cluster FROM znumbered z JOIN znearest USING (nr))")
    return ",\n".join(ctes)
