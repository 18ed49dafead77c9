"""File outputs of the pipeline and the insights report read-back.

The pipeline hands its results over as files: cleaned and analytical tables
as header CSV (NULL written as an empty field), and the insights report as
JSON next to its raw metrics and a plain-text rendering.  The insights
endpoint serves the JSON report without the raw metrics.

Every writer is a distributed ``DataFrame.write``; paths default to the
shared checkpoint folder (``scratch_path``), never a machine-local one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CSV_WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}
REPORT_SCHEMA = "section string, ord int, text string"


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**CSV_WRITE_OPTIONS).csv(path)
    return path


def read_output_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.options(**CSV_WRITE_OPTIONS).schema(schema).csv(path)


def write_insights_report(rows: DataFrame, metrics: DataFrame, root: str) -> str:
    """``rows`` = (section, ord, text); ``metrics`` = the one-row raw metrics."""
    rows.select("section", F.col("ord").cast("int").alias("ord"), "text").write.mode("overwrite").json(f"{root}/report")
    metrics.write.mode("overwrite").json(f"{root}/raw_metrics")
    # Text rendering, one line per rule row; the global sort writes the part
    # files in (section, ord) order.
    (
        rows.orderBy("section", "ord")
        .select(F.format_string("[%s] %s", F.col("section"), F.col("text")).alias("value"))
        .write.mode("overwrite")
        .text(f"{root}/report_txt")
    )
    return root


def read_insights_report(spark: SparkSession, root: str) -> DataFrame:
    """The endpoint's view of the report: the rule rows, raw metrics left out."""
    return spark.read.schema(REPORT_SCHEMA).json(f"{root}/report")
