"""Totals without joins, and broadcasts by size."""

from pyspark.sql import functions as F

from marketlens.operators.scalars import one_row, with_group_totals, with_scalars
from marketlens.sources.adapter import load_star


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_row_folds_independent_aggregates(spark):
    a = spark.range(10).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    b = spark.range(5).agg(F.max("id").alias("m"))
    c = spark.createDataFrame([(None,)], "q double")  # a NULL-valued 1-row aggregate stays NULL
    out = one_row(a, b, c)
    assert out.columns == ["n", "s", "m", "q"]
    assert tuple(out.collect()[0]) == (10, 45, 4, None)
    assert "Join" not in _plan(out) and "CartesianProduct" not in _plan(out)


def test_group_totals_equal_grand_total(spark):
    g = spark.range(100).groupBy((F.col("id") % 4).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    out = with_group_totals(g, _t=F.sum("c")).collect()
    assert {r._t for r in out} == {100} and sum(r.c for r in out) == 100
    assert "Join" not in _plan(with_group_totals(g, _t=F.sum("c")))


def test_with_scalars_attaches_every_column(spark):
    rows = spark.range(3)
    ref = spark.range(7).agg(F.max("id").alias("hi"), F.min("id").alias("lo"))
    out = with_scalars(rows, ref).orderBy("id").collect()
    assert [(r.id, r.hi, r.lo) for r in out] == [(0, 6, 0), (1, 6, 0), (2, 6, 0)]
    assert "Join" not in _plan(with_scalars(rows, ref))


def test_dimensions_are_broadcast_by_size_alone(spark):
    """The star asks for no broadcast; a small dimension gets one from its
    statistics, and none once the threshold is below its size."""
    star = lambda: load_star(spark, "/root/testdata/sf0.001").sellers
    assert "broadcast" not in star()._jdf.queryExecution().analyzed().toString().lower()
    assert "BroadcastHashJoin" in _plan(star())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
        assert "SortMergeJoin" in _plan(star())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
