"""Ingest that sets bad records aside instead of failing or guessing (p01b).

A file is read permissively, every column as text.  A record is bad if it has
more or fewer columns than the table, if a value can't become its column's type,
or if a required column is empty; each fault is a row of the quarantine (file,
column, value, reason, record).  Records without a fault become typed rows.  Both
come from the same parse, so a record is in one of the two, and neither reads
anything outside its own record.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..oracle.adapter_sql import with_star
from ..plans.registry import report
from ..session import is_scratch, scratch_path
from .adapter import Star
from .ingest import CSV_OPTIONS, MULTI_LINE, _as_text

REJECTS = "file_name string, column_name string, value string, reason string, record string"

COUNT, TYPE, MISSING = "column count", "not of type {}", "missing"


def read_records(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, header: bool = True) -> DataFrame:
    """The columns as text, and _malformed: the record, where it has another
    number of columns."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField("_malformed", T.StringType())])
    options = CSV_OPTIONS | {"header": str(header).lower(), "multiLine": str(multi_line).lower(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed", "columnPruning": "false"}
    return spark.read.options(**options).schema(text).csv(path)


def _faults(schema: T.StructType, required: Sequence[str]) -> Column:
    """An array of (column_name, value, reason)."""
    fault = lambda c, v, reason: F.struct(F.lit(c).cast("string").alias("column_name"), v.alias("value"), F.lit(reason).alias("reason"))
    found = []
    for f in schema.fields:
        value = F.nullif(F.col(f.name), F.lit(""))
        found.append(F.when(value.isNotNull() & value.try_cast(f.dataType).isNull(), fault(f.name, value, TYPE.format(f.dataType.simpleString()))))
        if f.name in required:
            found.append(F.when(value.isNull(), fault(f.name, value, MISSING)))
    whole = F.col("_malformed").isNotNull()
    return F.when(whole, F.array(fault(None, F.lit(None).cast("string"), COUNT))).otherwise(F.array_compact(F.array(*found)))


def parse(records: DataFrame, schema: T.StructType, file_name: str, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects) of what ``read_records`` returns."""
    columns = [f.name for f in schema.fields]
    judged = records.withColumn("_faults", _faults(schema, required))
    good = judged.where(F.size("_faults") == 0).select(*[F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    record = F.coalesce("_malformed", F.to_csv(F.struct(*columns), {"quote": '"', "escape": '"'}))
    bad = judged.where(F.size("_faults") > 0).select(record.alias("record"), F.explode("_faults").alias("f"))
    return good, bad.select(F.lit(file_name).alias("file_name"), "f.column_name", "f.value", "f.reason", "record")


def ingest(spark: SparkSession, path: str, schema: T.StructType, file_name: str, quarantine: str, required: Sequence[str] = (), header: bool = True) -> DataFrame:
    """The typed rows of a file; its rejects are added to the table below
    ``quarantine``."""
    good, bad = parse(read_records(spark, path, schema, file_name in MULTI_LINE, header), schema, file_name, required)
    bad.write.mode("append").parquet(quarantine)
    return good


# ---------------------------------------------------------------- exports with faults

#: file, column, what its value is replaced by in a copy of every n-th row, n
#: (column None: a column too many, or all but two missing)
FAULTS = [
    ("orders", "order_purchase_timestamp", "2017-02-30 10:00:00", 40),
    ("orders", "order_id", "", 90),
    ("payments", "payment_value", "n/a", 50),
    ("payments", "payment_installments", "3.5", 70),
    ("payments", None, "surplus", 60),
    ("reviews", "review_score", "five", 30),
    ("reviews", None, "short", 80),
]
_EXPORTS: dict[tuple[str, str, str], str] = {}


def export_with_faults(st: Star, name: str) -> str:
    """The raw export ``name`` (without a header) and, beside its good rows, a
    faulty copy of every n-th order's rows for each of FAULTS; returns its
    folder."""
    spark = st.spark
    known = (spark.sparkContext.applicationId, st.source or "", name)
    if st.source is not None and is_scratch(spark, _EXPORTS.get(known, "")):
        return _EXPORTS[known]
    frame = getattr(st, name)
    text = _as_text(frame)
    line = lambda cols: F.to_csv(F.struct(*cols), {"quote": '"', "escape": '"'})
    lines = [text.select(line(text.columns).alias("value"))]
    for file, column, value, n in FAULTS:
        if file != name:
            continue
        rows = text.where(F.col("order_id").cast("bigint") % n == 0)
        if column:
            whole = line([F.lit(value).alias(c) if c == column else F.col(c) for c in text.columns])
        else:
            whole = F.concat(line(text.columns), F.lit(",surplus")) if value == "surplus" else line(text.columns[:2])
        lines.append(rows.select(whole.alias("value")))
    path = scratch_path(spark, f"faulty-{name}")
    reduce(DataFrame.unionByName, lines).write.text(path)
    if st.source is not None:
        _EXPORTS[known] = path
    return path


def quarantined(st: Star, name: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects) of the export with faults."""
    from ..plans.pipeline import NOT_NULL

    schema = getattr(st, name).schema
    records = read_records(st.spark, export_with_faults(st, name), schema, name in MULTI_LINE, header=False)
    return parse(records, schema, name, NOT_NULL[name])


_TABLE = {"orders": "orders_en", "payments": "payments", "reviews": "reviews"}
_TYPES = {"order_purchase_timestamp": "timestamp_ntz", "payment_value": "decimal(10,2)", "payment_installments": "int", "review_score": "int"}


def _reason(column: str | None, value: str) -> str:
    return COUNT if column is None else MISSING if value == "" else TYPE.format(_TYPES[column])


_BY_FAULT = " UNION ALL ".join(
    f"SELECT '{f}' AS file_name, {repr(c) if c else 'NULL'} AS column_name, '{_reason(c, v)}' AS reason, count(*) AS records FROM {_TABLE[f]} WHERE CAST(order_id AS BIGINT) % {n} = 0"
    for f, c, v, n in FAULTS
)


@report(
    "p01b_quarantine",
    with_star(
        f"""SELECT file_name, column_name, reason, CAST(sum(records) AS BIGINT) AS records FROM ({_BY_FAULT}) GROUP BY ALL HAVING sum(records) > 0
        UNION ALL {' UNION ALL '.join(f"SELECT '{f}', NULL, 'accepted', count(*) FROM {t}" for f, t in _TABLE.items())}"""
    ),
    note="records of three exports with planted faults: accepted, and rejected by column and reason",
)
def p01b(st: Star) -> DataFrame:
    parts = []
    for name in _TABLE:
        good, bad = quarantined(st, name)
        parts.append(bad.groupBy("file_name", "column_name", "reason").agg(F.count(F.lit(1)).alias("records")))
        parts.append(good.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("file_name"), F.lit(None).cast("string").alias("column_name"), F.lit("accepted").alias("reason"), "records"))
    return reduce(DataFrame.unionByName, parts)


@report(
    "p05e_accepted_payments",
    with_star("SELECT * FROM payments"),
    note="what is left of the payments' export with planted faults: the table itself",
)
def p05e(st: Star) -> DataFrame:
    return quarantined(st, "payments")[0]
