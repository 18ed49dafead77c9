"""Report registry: key → (DataFrame builder, oracle SQL or None).

Builders take a :class:`~marketlens.sources.adapter.Star` and return a lazy
DataFrame.  Oracle SQL strings run on DuckDB over the driver's raw views with
the star-schema CTEs prepended (``oracle.adapter_sql.with_star``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.adapter import Star


@dataclass
class Report:
    key: str
    build: Callable[[Star], DataFrame]
    oracle: str | None
    note: str = ""


REPORTS: dict[str, Report] = {}


def report(key: str, oracle: str | None = None, note: str = ""):
    def deco(fn: Callable[[Star], DataFrame]):
        if key in REPORTS:
            raise ValueError(f"duplicate report key {key}")
        REPORTS[key] = Report(key, fn, oracle, note)
        return fn

    return deco


def all_reports() -> dict[str, Report]:
    # Import for side effects: each module registers its reports.
    from . import advanced, basic, eda, insights, intermediate, pipeline, refresh, service  # noqa: F401
    from ..operators import anomalies, forecast, segments  # noqa: F401
    from ..sources import ingest, quarantine  # noqa: F401

    return REPORTS
