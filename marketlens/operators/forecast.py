"""Sales forecasting: linear and quadratic trend, simple exponential smoothing.

Fitting is closed-form.  A handful of exact sums (Σt^k, Σt^k·y with y in cents)
are taken as window aggregates over each series, so the same code fits one
series or a million, with one shuffle of months by series.  Determinants of the normal equations are formed in
DECIMAL(38,0) — exact — and only the final coefficients are doubles.
Predictions are rounded to cents before the error metrics, which are then
computed from integers.

Exponential smoothing runs a left fold (``aggregate``) over the series'
month-ordered array: one row per (series, alpha); the array length is the
number of months, which is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import ratio_round
from ..functions.exact import sql_ratio_round as R
from ..oracle.adapter_sql import with_star
from ..plans.pipeline import MONTHLY_SALES_SQL, monthly_sales
from ..plans.registry import report
from ..sources.adapter import Star

HORIZON = 3
TEST_SHARE_DIV = 5  # last T div 5 months are the test split
SES_ALPHAS = [round(0.1 * i, 1) for i in range(1, 10)]

D = "decimal(38,0)"


def revenue_series(st: Star) -> DataFrame:
    """Monthly revenue (cents) of every month with a delivered order, with the
    months since the first one as t and the train/test split."""
    month = F.split("year_month", "-")
    m = monthly_sales(st).select(
        "year_month",
        F.round(F.col("revenue") * 100, 0).cast("bigint").alias("y"),
        (month[0].cast("bigint") * 12 + month[1].cast("bigint")).alias("_m"),
    )
    everything = Window.partitionBy()  # month grain: bounded
    m = m.select(
        "year_month",
        "y",
        (F.col("_m") - F.min("_m").over(everything)).alias("t"),
        (F.row_number().over(Window.orderBy("year_month")) - 1).alias("_i"),
        F.count(F.lit(1)).over(everything).alias("_T"),
    )
    n_test = F.call_function("div", F.col("_T"), F.lit(TEST_SHARE_DIV))
    return m.withColumn("split", F.when(F.col("_i") >= F.col("_T") - n_test, F.lit("test")).otherwise(F.lit("train"))).drop(
        "_i", "_T"
    )


def _d(c: str) -> Column:
    return F.col(c).cast(D)


def with_trends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append linear (a1, b1) and quadratic (a2, b2, c2) coefficients fitted on
    the train rows of each series.

    The normal-equation moments are exact DECIMAL(38,0) sums taken as window
    aggregates over the series (partition = series key, rows = its months, a
    calendar-bounded count), so the coefficients reach every row of the
    series, forecast months included, without a join or a second pass.
    """
    series = Window.partitionBy(*keys)
    train = F.col("split") == "train"
    t, y = _d("t"), _d("y")

    def moment(x: Column) -> Column:
        return F.sum(F.when(train, x)).over(series)

    n = F.count(F.when(train, F.lit(1))).over(series).cast(D)
    st, st2, st3, st4 = moment(t), moment(t * t), moment(t * t * t), moment(t * t * t * t)
    sy, sty, st2y = moment(y), moment(t * y), moment(t * t * y)
    m = rows.select("*", n.alias("_n0"), st.alias("_st"), st2.alias("_st2"), st3.alias("_st3"), st4.alias("_st4"),
                    sy.alias("_sy"), sty.alias("_sty"), st2y.alias("_st2y"))
    n, st, st2, st3, st4, sy, sty, st2y = (F.col(c) for c in ("_n0", "_st", "_st2", "_st3", "_st4", "_sy", "_sty", "_st2y"))
    m11 = st2 * st4 - st3 * st3
    det = n * m11 - st * (st * st4 - st3 * st2) + st2 * (st * st3 - st2 * st2)
    det_a = sy * m11 - st * (sty * st4 - st3 * st2y) + st2 * (sty * st3 - st2 * st2y)
    det_b = n * (sty * st4 - st3 * st2y) - sy * (st * st4 - st3 * st2) + st2 * (st * st2y - sty * st2)
    det_c = n * (st2 * st2y - sty * st3) - st * (st * st2y - sty * st2) + sy * (st * st3 - st2 * st2)
    b1 = (n * sty - st * sy).cast("double") / (n * st2 - st * st).cast("double")
    fitted = m.select(
        *rows.columns,
        b1.alias("b1"),
        det.cast("double").alias("_det"),
        det_a.cast("double").alias("_da"),
        det_b.cast("double").alias("_db"),
        det_c.cast("double").alias("_dc"),
        sy.cast("double").alias("_syd"),
        st.cast("double").alias("_std"),
        n.cast("double").alias("_nd"),
    )
    return fitted.select(
        *rows.columns,
        ((F.col("_syd") - F.col("b1") * F.col("_std")) / F.col("_nd")).alias("a1"),
        "b1",
        (F.col("_da") / F.col("_det")).alias("a2"),
        (F.col("_db") / F.col("_det")).alias("b2"),
        (F.col("_dc") / F.col("_det")).alias("c2"),
    )


def _cents(x: Column) -> Column:
    # round half away from zero on the exact double value (same in both engines)
    return F.round(x, 0).cast("bigint")


def forecast_results(st: Star) -> DataFrame:
    series = revenue_series(st)
    last = series.agg(F.max("t").alias("_tmax"), F.max("year_month").alias("_ym"))
    future = last.select(F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("h"), "_tmax", "_ym").select(
        F.date_format(F.add_months(F.to_date(F.concat("_ym", F.lit("-01"))), F.col("h")), "yyyy-MM").alias("year_month"),
        F.lit(None).cast("bigint").alias("y"),
        (F.col("_tmax") + F.col("h")).alias("t"),
        F.lit("forecast").alias("split"),
    )
    allrows = with_trends(series.unionByName(future), [])  # one series
    t = F.col("t").cast("double")
    lin = F.col("a1") + F.col("b1") * t
    poly = F.col("a2") + F.col("b2") * t + F.col("c2") * t * t
    return allrows.select(
        "year_month",
        "t",
        "split",
        "y",
        (F.col("y").cast("double") / 100).alias("actual_revenue"),
        _cents(lin).alias("lin_c"),
        _cents(poly).alias("poly_c"),
    )


FORECAST_SQL = (
    MONTHLY_SALES_SQL
    + f""",
series AS (
    SELECT year_month, CAST(round(revenue * 100) AS BIGINT) AS y,
        CAST(left(year_month, 4) AS BIGINT) * 12 + CAST(right(year_month, 2) AS BIGINT) AS month_no,
        row_number() OVER (ORDER BY year_month) - 1 AS i,
        count(*) OVER () AS months
    FROM monthly_sales
),
series_s AS (
    SELECT year_month, y, month_no - (SELECT min(month_no) FROM series) AS t,
        CASE WHEN i >= months - months // {TEST_SHARE_DIV} THEN 'test' ELSE 'train' END AS split
    FROM series
),
sums AS (
    SELECT CAST(count(*) AS HUGEINT) AS n, CAST(sum(t) AS HUGEINT) AS st, CAST(sum(t * t) AS HUGEINT) AS st2,
        CAST(sum(t * t * t) AS HUGEINT) AS st3, CAST(sum(t * t * t * t) AS HUGEINT) AS st4,
        CAST(sum(y) AS HUGEINT) AS sy, CAST(sum(CAST(t AS HUGEINT) * y) AS HUGEINT) AS sty,
        CAST(sum(CAST(t * t AS HUGEINT) * y) AS HUGEINT) AS st2y
    FROM series_s WHERE split = 'train'
),
dets AS (
    SELECT CAST(n * sty - st * sy AS DOUBLE) / CAST(n * st2 - st * st AS DOUBLE) AS b1,
        CAST(n * (st2 * st4 - st3 * st3) - st * (st * st4 - st3 * st2) + st2 * (st * st3 - st2 * st2) AS DOUBLE) AS det,
        CAST(sy * (st2 * st4 - st3 * st3) - st * (sty * st4 - st3 * st2y) + st2 * (sty * st3 - st2 * st2y) AS DOUBLE) AS da,
        CAST(n * (sty * st4 - st3 * st2y) - sy * (st * st4 - st3 * st2) + st2 * (st * st2y - sty * st2) AS DOUBLE) AS db,
        CAST(n * (st2 * st2y - sty * st3) - st * (st * st2y - sty * st2) + sy * (st * st3 - st2 * st2) AS DOUBLE) AS dc,
        CAST(sy AS DOUBLE) AS sy_d, CAST(st AS DOUBLE) AS st_d, CAST(n AS DOUBLE) AS n_d
    FROM sums
),
coef AS (
    SELECT (sy_d - b1 * st_d) / n_d AS a1, b1, da / det AS a2, db / det AS b2, dc / det AS c2 FROM dets
),
future AS (
    SELECT strftime(CAST(ym || '-01' AS DATE) + to_months(CAST(h AS INTEGER)), '%Y-%m') AS year_month,
        CAST(NULL AS BIGINT) AS y, tmax + h AS t, 'forecast' AS split
    FROM (SELECT max(t) AS tmax, max(year_month) AS ym FROM series_s) l, range(1, {HORIZON + 1}) r(h)
),
forecast AS (
    SELECT s.year_month, s.t, s.split, s.y, CAST(s.y AS DOUBLE) / 100 AS actual_revenue,
        CAST(round(a1 + b1 * CAST(s.t AS DOUBLE)) AS BIGINT) AS lin_c,
        CAST(round(a2 + b2 * CAST(s.t AS DOUBLE) + c2 * CAST(s.t AS DOUBLE) * CAST(s.t AS DOUBLE)) AS BIGINT) AS poly_c
    FROM (SELECT * FROM series_s UNION ALL SELECT * FROM future) s CROSS JOIN coef
)"""
)


@report(
    "p12_forecast",
    with_star(
        """SELECT year_month, split, actual_revenue, CAST(lin_c AS DOUBLE) / 100 AS pred_linear,
            CAST(poly_c AS DOUBLE) / 100 AS pred_poly FROM forecast ORDER BY year_month""",
        FORECAST_SQL,
    ),
    note="linear + quadratic OLS on the month index, trained on the first 80% of months, 3-month horizon",
)
def p12(st: Star) -> DataFrame:
    f = forecast_results(st)
    return f.select(
        "year_month",
        "split",
        "actual_revenue",
        (F.col("lin_c").cast("double") / 100).alias("pred_linear"),
        (F.col("poly_c").cast("double") / 100).alias("pred_poly"),
    ).orderBy("year_month")


def _metric_columns(pred: str, over: Window | None = None) -> list[Column]:
    """MAE / RMSE / MAPE over the test rows, as aggregates or (``over``) as
    window aggregates attached to every row of the series."""
    test = F.col("split") == "test"
    e = F.abs(F.col("y") - F.col(pred)).cast(D)  # squares of cents pass 64 bits

    def agg(c: Column) -> Column:
        return c.over(over) if over is not None else c

    n = agg(F.count(F.when(test, F.lit(1))))
    abs_err = agg(F.sum(F.when(test, e)))
    sq_err = agg(F.sum(F.when(test, e * e)))
    pct_err = agg(F.sum(F.when(test, ratio_round(e * 1000000, F.col("y"), 0).cast(D))))
    return [
        n.alias("test_months"),
        ratio_round(abs_err, n * 100, 2).alias("mae"),
        (F.round(F.sqrt(sq_err.cast("double") / n.cast("double")), 0) / 100).alias("rmse"),
        ratio_round(pct_err * 100, n * 1000000, 2).alias("mape"),
    ]


def _metrics(f: DataFrame, pred: str, model: str) -> DataFrame:
    return f.agg(F.lit(model).alias("model"), *_metric_columns(pred))


def _metrics_sql(pred: str, model: str) -> str:
    e = f"abs(y - {pred})"
    return f"""SELECT '{model}' AS model, count(*) AS test_months,
        {R(f'sum({e})', 'count(*) * 100', 2)} AS mae,
        round(sqrt(CAST(sum(CAST({e} AS HUGEINT) * {e}) AS DOUBLE) / CAST(count(*) AS DOUBLE))) / 100 AS rmse,
        {R(f"sum(CAST({R(f'{e} * 1000000', 'y', 0)} AS BIGINT)) * 100", 'count(*) * 1000000', 2)} AS mape
    FROM forecast WHERE split = 'test'"""


@report(
    "p12d_forecast_metrics",
    with_star(_metrics_sql("lin_c", "linear") + "\nUNION ALL\n" + _metrics_sql("poly_c", "poly2"), FORECAST_SQL),
    note="MAE / RMSE / MAPE computed on the test split (not constants)",
)
def p12d(st: Star) -> DataFrame:
    f = forecast_results(st)
    return _metrics(f, "lin_c", "linear").unionByName(_metrics(f, "poly_c", "poly2"))


@report(
    "s09_forecast",
    with_star(
        """SELECT f.year_month, f.split, f.actual_revenue, CAST(f.lin_c AS DOUBLE) / 100 AS pred_linear,
            CAST(f.poly_c AS DOUBLE) / 100 AS pred_poly, m.mae AS mae_poly, m.rmse AS rmse_poly, m.mape AS mape_poly
        FROM forecast f CROSS JOIN (""" + _metrics_sql("poly_c", "poly2") + """) m ORDER BY f.year_month""",
        FORECAST_SQL,
    ),
)
def s09(st: Star) -> DataFrame:
    f = forecast_results(st)
    m = _metric_columns("poly_c", Window.partitionBy())  # month grain: bounded
    return f.select("*", *m).withColumnsRenamed({"mae": "mae_poly", "rmse": "rmse_poly", "mape": "mape_poly"}).select(
        "year_month",
        "split",
        "actual_revenue",
        (F.col("lin_c").cast("double") / 100).alias("pred_linear"),
        (F.col("poly_c").cast("double") / 100).alias("pred_poly"),
        "mae_poly",
        "rmse_poly",
        "mape_poly",
    ).orderBy("year_month")


@report(
    "e05_forecast_residuals",
    with_star(
        """SELECT year_month, split, actual_revenue, CAST(poly_c AS DOUBLE) / 100 AS predicted,
            CAST(y - poly_c AS DOUBLE) / 100 AS residual
        FROM forecast WHERE split <> 'forecast' ORDER BY year_month""",
        FORECAST_SQL,
    ),
)
def e05(st: Star) -> DataFrame:
    f = forecast_results(st).filter(F.col("split") != "forecast")
    return f.select(
        "year_month",
        "split",
        "actual_revenue",
        (F.col("poly_c").cast("double") / 100).alias("predicted"),
        ((F.col("y") - F.col("poly_c")).cast("double") / 100).alias("residual"),
    ).orderBy("year_month")


# ---------------------------------------------------------------- SES


def ses_forecast(series: DataFrame, keys: list[str]) -> DataFrame:
    """Simple exponential smoothing per series; alpha chosen on train SSE."""
    arr = series.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("t", F.col("y").cast("double").alias("y"), "split", "year_month"))).alias("pts")
    )
    grid = arr.select("*", F.explode(F.array(*[F.lit(a) for a in SES_ALPHAS])).alias("alpha"))
    train = F.filter("pts", lambda p: p["split"] == "train")

    def step(acc, p):
        # acc = (level, sse, started)
        err = p["y"] - acc["level"]
        return F.struct(
            F.when(acc["started"], F.col("alpha") * p["y"] + (1 - F.col("alpha")) * acc["level"]).otherwise(p["y"]).alias("level"),
            (acc["sse"] + F.when(acc["started"], err * err).otherwise(F.lit(0.0))).alias("sse"),
            F.lit(True).alias("started"),
        )

    init = F.struct(F.lit(0.0).alias("level"), F.lit(0.0).alias("sse"), F.lit(False).alias("started"))
    fitted = grid.select(*keys, "alpha", "pts", F.aggregate(train, init, step).alias("fit"))
    best_w = Window.partitionBy(*keys).orderBy(F.col("fit.sse"), "alpha")  # 9 rows per series
    best = fitted.withColumn("_r", F.row_number().over(best_w)).filter("_r = 1")
    rows = best.select(*keys, "alpha", F.col("fit.level").alias("level"), F.explode("pts").alias("p"))
    return rows.select(
        *keys,
        F.col("p.year_month").alias("year_month"),
        F.col("p.split").alias("split"),
        (F.col("p.y") / 100).alias("actual_revenue"),
        F.when(F.col("p.split") == "test", F.round(F.col("level"), 0) / 100).alias("pred_ses"),
        "alpha",
    )


SES_SQL = (
    FORECAST_SQL
    + """,
alphas AS (SELECT alpha FROM (VALUES """ + ", ".join(f"(CAST({a!r} AS DOUBLE))" for a in SES_ALPHAS) + """) v(alpha)),
train AS (
    SELECT CAST(y AS DOUBLE) AS y, row_number() OVER (ORDER BY t) AS i FROM series_s WHERE split = 'train'
),
fold AS (
    SELECT a.alpha, tr.i, tr.y AS level, CAST(0.0 AS DOUBLE) AS sse FROM alphas a JOIN train tr ON tr.i = 1
    UNION ALL
    SELECT f.alpha, tr.i, f.alpha * tr.y + (1 - f.alpha) * f.level, f.sse + (tr.y - f.level) * (tr.y - f.level)
    FROM fold f JOIN train tr ON tr.i = f.i + 1
),
best AS (
    SELECT alpha, level FROM fold WHERE i = (SELECT max(i) FROM train) ORDER BY sse, alpha LIMIT 1
)"""
)


@report(
    "p12c_forecast_ses",
    with_star(
        """SELECT 'total' AS series, s.year_month, s.split, CAST(s.y AS DOUBLE) / 100 AS actual_revenue,
            CASE WHEN s.split = 'test' THEN round(b.level, 0) / 100 END AS pred_ses, b.alpha
        FROM series_s s JOIN best b ON TRUE ORDER BY s.year_month""",
        SES_SQL,
        recursive=True,
    ),
    note="fold over the train months per alpha (same double arithmetic, in order, as a recursive CTE)",
)
def p12c(st: Star) -> DataFrame:
    s = revenue_series(st).withColumn("series", F.lit("total"))
    return ses_forecast(s, ["series"]).orderBy("year_month")


@report(
    "p12a_forecast_linear",
    with_star(
        """SELECT year_month, split, actual_revenue, CAST(lin_c AS DOUBLE) / 100 AS pred_linear
        FROM forecast ORDER BY year_month""",
        FORECAST_SQL,
    ),
    note="linear trend component of p12_forecast",
)
def p12a(st: Star) -> DataFrame:
    f = forecast_results(st)
    return f.select("year_month", "split", "actual_revenue", (F.col("lin_c").cast("double") / 100).alias("pred_linear")).orderBy(
        "year_month"
    )


@report(
    "p12b_forecast_poly2",
    with_star(
        """SELECT year_month, split, actual_revenue, CAST(poly_c AS DOUBLE) / 100 AS pred_poly
        FROM forecast ORDER BY year_month""",
        FORECAST_SQL,
    ),
    note="quadratic trend component of p12_forecast",
)
def p12b(st: Star) -> DataFrame:
    f = forecast_results(st)
    return f.select("year_month", "split", "actual_revenue", (F.col("poly_c").cast("double") / 100).alias("pred_poly")).orderBy(
        "year_month"
    )
