"""File outputs: CSV hand-over tables read back equal, insights JSON/TXT report."""

from pyspark.sql import functions as F

from marketlens.plans.exports import write_outputs
from marketlens.plans.insights import endpoint_rows, metrics
from marketlens.plans.pipeline import order_totals
from marketlens.session import scratch_path
from marketlens.sources.adapter import load_star
from marketlens.sources.outputs import read_insights_report, read_output_csv, write_csv, write_insights_report

SF = "/root/testdata/sf0.001"


def test_cleaned_tables_and_order_totals_round_trip(spark):
    st = load_star(spark, SF)
    paths = write_outputs(st, analytical=False)
    for name in ("customers", "orders", "order_items", "payments", "reviews"):
        back = spark.read.options(header="true", multiLine="true", escape='"').csv(paths[f"cleaned/{name}"])
        assert back.count() == getattr(st, name).count(), name
    ot = order_totals(st)
    back = read_output_csv(spark, write_csv(ot, scratch_path(spark, "ot")), ot.schema)
    assert back.count() == ot.count()
    assert back.exceptAll(ot).count() == 0 and ot.exceptAll(back).count() == 0


def test_insights_report_json_and_text(spark):
    st = load_star(spark, SF)
    m = metrics(st)
    rows = endpoint_rows(m)
    root = write_insights_report(rows, m, scratch_path(spark, "insights"))
    back = read_insights_report(spark, root)
    assert "raw_metrics" not in back.columns
    assert back.exceptAll(rows.select("section", F.col("ord").cast("int"), "text")).count() == 0
    lines = [r.value for r in spark.read.text(f"{root}/report_txt").collect()]
    assert len(lines) == back.count() and all(line.startswith("[") for line in lines)
    raw = spark.read.json(f"{root}/raw_metrics").collect()
    assert len(raw) == 1 and raw[0]["n_orders"] > 0
