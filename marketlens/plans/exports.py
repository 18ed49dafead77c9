"""The pipeline's file hand-over: cleaned tables and analytical datasets as
header CSV under one folder (phases 2–3 and 8–10 of the pipeline), the
inputs the file-backed reports are served from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.anomalies import monthly_iqr, order_anomalies
from ..operators.forecast import forecast_results
from ..operators.segments import kept_segments
from ..session import scratch_path
from ..sources.adapter import Star
from ..sources.outputs import write_csv
from .pipeline import customer_features, monthly_sales, order_totals, star_frames


def analytical_frames(st: Star) -> dict[str, DataFrame]:
    return {
        "order_totals": order_totals(st),
        "monthly_sales": monthly_sales(st),
        "customer_features": customer_features(st),
        "customer_segments": kept_segments(st),
        "forecast_results": forecast_results(st),
        "anomalies": order_anomalies(st),
        "monthly_anomalies": monthly_iqr(st),
    }


def write_outputs(st: Star, root: str | None = None, analytical: bool = True) -> dict[str, str]:
    """Write the cleaned star tables (and the analytical datasets) as CSV; return name → folder."""
    base = root or scratch_path(st.orders.sparkSession, "outputs")
    frames = {f"cleaned/{k}": v for k, v in star_frames(st).items()}
    if analytical:
        frames.update(analytical_frames(st))
    return {name: write_csv(df, f"{base}/{name}") for name, df in frames.items()}
