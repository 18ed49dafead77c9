"""Loads of the star schema in versions: write, verify, publish.

A load writes all tables below ``root`` in a folder of its own, counts what can
be read back, and holds that against the expected counts (given, or counted in
the source).  Only if all agree is it published: its verdict is written as
``verdict`` and the marker of that write makes the version the current one.  A
load that fails is removed, and the version before stays the current one, for
readers that have it open as well; ``retire`` removes those that nobody needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import Star
from .kept import _listed, _removed
from .sinks import LOAD_ORDER, write_star

VERDICT = "table_name string, load_order int, expected_count long, row_count long, ok boolean"


class LoadFailed(RuntimeError):
    """A load whose tables don't hold what was expected; ``verdict`` has the
    rows of the report."""

    def __init__(self, verdict: list):
        self.verdict = verdict
        super().__init__("; ".join(f"{r['table_name']}: {r['row_count']} rows, expected {r['expected_count']}" for r in verdict if not r["ok"]))


def versions(spark: SparkSession, root: str) -> list[str]:
    """Folders of the published versions, oldest first."""
    return [p.removesuffix("/verdict/_SUCCESS") for p in _listed(spark, f"{root.rstrip('/')}/v*/verdict/_SUCCESS")]


def current(spark: SparkSession, root: str) -> Star:
    """The star as last published."""
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"no load has been published below {root}")
    return Star(**{name: spark.read.parquet(f"{found[-1]}/{name}") for name in LOAD_ORDER}, session=spark)


def _counts(frames: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table, in one job over all of them."""
    each = [df.select(F.lit(name).alias("t")) for name, df in frames.items()]
    return {r["t"]: r["n"] for r in reduce(DataFrame.unionByName, each).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def load_version(st: Star, root: str, expected: dict[str, int] | None = None) -> DataFrame:
    """Load the star's tables as a new version and return its verdict
    (``VERDICT``); ``LoadFailed`` if a table's count differs."""
    spark, root = st.spark, root.rstrip("/")
    numbers = [int(p.rsplit("/v", 1)[1]) for p in _listed(spark, f"{root}/v*")]
    folder = f"{root}/v{max(numbers, default=0) + 1:08d}"
    try:
        loaded = _counts(write_star(spark, st, folder))
        wanted = _counts({name: getattr(st, name) for name in LOAD_ORDER}) if expected is None else expected
        rows = [(name, i + 1, wanted.get(name, 0), loaded.get(name, 0), wanted.get(name, 0) == loaded.get(name, 0)) for i, name in enumerate(LOAD_ORDER)]
        verdict = spark.createDataFrame(rows, VERDICT).coalesce(1)
        if not all(r[-1] for r in rows):
            raise LoadFailed(verdict.collect())
        verdict.write.parquet(f"{folder}/verdict")
    except Exception:
        _removed(spark, folder)
        raise
    return spark.read.parquet(f"{folder}/verdict")


def retire(spark: SparkSession, root: str, leave: int = 1) -> int:
    """Remove all published versions but the last ``leave``; returns how many."""
    old = versions(spark, root)[: -leave or None]
    for folder in old:
        _removed(spark, folder)
    return len(old)
