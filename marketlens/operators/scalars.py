"""Grand totals and side-by-side KPIs without joins.

Three shapes, chosen by where the total comes from:

* ``with_group_totals`` — a share-of-total over a grouped result whose size is
  bounded by its key domain (statuses, scores, tiers, categories, months):
  the total is a window aggregate over that small result, so it reuses the
  aggregation instead of scanning the input again.
* ``one_row`` — several 1-row aggregates of different inputs side by side:
  their rows are unioned (each carrying only its own columns) and folded by
  one global aggregate, so all parts run in one plan and share exchanges.
* ``with_scalars`` — a value from an independent aggregate attached to many
  rows (e.g. a reference date or a fence): an uncorrelated scalar subquery.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_group_totals(grouped: DataFrame, **totals: Column) -> DataFrame:
    """Append ``name = aggregate OVER ()`` for a grouped result of bounded size."""
    whole = Window.partitionBy()  # rows = distinct keys of a small domain
    return grouped.select("*", *[agg.over(whole).alias(name) for name, agg in totals.items()])


def one_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Side-by-side columns of several 1-row aggregates, as one row."""
    frames = (first, *others)
    columns = [c for f in frames for c in f.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    # each column is non-null in at most one of the stacked rows
    return stacked.agg(*[F.max(c).alias(c) for c in columns])


def with_scalars(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Append every column of the independent 1-row aggregate ``totals`` to each row of ``df``."""
    return df.select("*", *[totals.select(c).scalar().alias(c) for c in totals.columns])
