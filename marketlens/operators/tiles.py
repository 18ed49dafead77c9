"""NTILE over a whole table without sorting it.

The last row of every tile but the last one is a cut: a (value, key) pair.  Cuts
are found by selection and rows are labelled by comparing with them, so nothing
is sorted or shuffled by row:

1. the value at each cut's place, by ``discrete_quantiles``;
2. how many rows lie below that value, so which of those that share it is the
   cut: its place among their keys;
3. the key at that place by descent over prefixes: keys that begin with the
   prefix so far are counted by their next characters, those counts (aggregated
   before they are shuffled) tell the next prefix, until few keys are left.

A value shared by a third of all rows, or nearly all of them, takes a few more
counting passes; its rows stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .global_rank import discrete_quantiles

#: Characters by which a prefix grows, and keys few enough to be ranked.
GROWTH, FEW = 3, 4096


@dataclass
class _Cut:
    order: str  # column of the value, ascending
    tile: int
    place: int  # 1-based among all rows, then among the rows that share the value and prefix
    value: float = 0.0
    prefix: str = ""
    key: str | None = None


def _ends(n: int, buckets: int) -> list[tuple[int, int]]:
    """(tile, place of its last row) of the tiles before the last row."""
    q, r = divmod(n, buckets)
    return [(t, t * q + min(t, r)) for t in range(1, buckets) if 0 < t * q + min(t, r) < n]


def cuts(rows: DataFrame, values: list[str], key: str, buckets: int) -> list[_Cut]:
    """The last (value, key) of every tile by each of ``values``, ascending,
    equal ones by ``key`` (a string).  ``rows`` is read several times; write it
    before."""
    n = rows.count()
    ends = _ends(n, buckets)
    if not ends:
        return []
    at = discrete_quantiles(rows, values, {str(t): (end - 0.5) / (n - 1) for t, end in ends}, lower=True).first()
    found = [_Cut(v, t, end, at[f"{v}__{t}"]) for v in values for t, end in ends]
    below = rows.agg(*[F.count(F.when(F.col(c.order) < c.value, 1)).alias(str(i)) for i, c in enumerate(found)]).first()
    for i, c in enumerate(found):
        c.place -= below[str(i)]
    open_ = found
    while open_:
        # keys that share the value and the prefix, by their next characters
        wanted = F.array_compact(F.array(*[
            F.when((F.col(c.order) == c.value) & F.startswith(F.col(key), F.lit(c.prefix)), F.struct(F.lit(i).alias("i"), F.substring(key, 1, len(c.prefix) + GROWTH).alias("p")))
            for i, c in enumerate(open_)
        ]))
        counted = rows.select(F.explode(wanted).alias("w")).groupBy("w.i", "w.p").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("p"))  # prefixes of a few characters more
        place = F.create_map(*[x for i, c in enumerate(open_) for x in (F.lit(i), F.lit(c.place))])[F.col("i")]
        held = counted.withColumn("end", upto).where((F.col("end") >= place) & (F.col("end") - F.col("n") < place)).collect()  # a row per cut
        few = []
        for r in held:
            c = open_[r["i"]]
            c.place -= r["end"] - r["n"]
            if len(r["p"]) < len(c.prefix) + GROWTH:  # a whole key
                c.key = r["p"]
            elif r["n"] <= FEW:
                few.append(c)
            c.prefix = r["p"]
        if few:
            match = F.array_compact(F.array(*[F.when((F.col(c.order) == c.value) & F.startswith(F.col(key), F.lit(c.prefix)), F.lit(i)) for i, c in enumerate(few)]))
            left = rows.select(F.explode(match).alias("i"), F.col(key).alias("k"))
            place = F.create_map(*[x for i, c in enumerate(few) for x in (F.lit(i), F.lit(c.place))])[F.col("i")]
            ranked = left.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("k"))).where(F.col("r") == place)
            for r in ranked.collect():
                few[r["i"]].key = r["k"]
        open_ = [c for c in open_ if c.key is None]
    return found


def tiles(rows: DataFrame, out: dict[str, str], key: str, buckets: int) -> DataFrame:
    """``rows`` with NTILE(buckets) by each value ascending, equal ones by
    ``key``; ``out``: value column to name of the result."""
    found = cuts(rows, list(out), key, buckets)

    def tile(value: str) -> Column:
        later = [(F.col(value) > c.value) | ((F.col(value) == c.value) & (F.col(key) > c.key)) for c in found if c.order == value]
        return sum((after.cast("long") for after in later), F.lit(1).cast("long"))

    return rows.withColumns({name: tile(v) for v, name in out.items()})
