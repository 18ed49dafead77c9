"""Records with faults are set aside, all others read."""

import pytest
from pyspark.sql import types as T

from marketlens.session import scratch_path
from marketlens.sources.adapter import load_star
from marketlens.sources.quarantine import FAULTS, ingest, parse, quarantined, read_records

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("at", T.TimestampNTZType()), T.StructField("amount", T.DecimalType(10, 2)),
    T.StructField("n", T.IntegerType()), T.StructField("ok", T.BooleanType()), T.StructField("note", T.StringType()),
])

GOOD = [
    'a,2017-01-31 10:00:00,12.50,3,True,"two\nlines, and ""quotes"""',
    "b,,,,,",
    "c,2016-02-29 00:00:00,-1,0,False,x",
]
BAD = {
    "d,2017-02-29 10:00:00,1,1,True,x": [("at", "2017-02-29 10:00:00", "not of type timestamp_ntz")],
    "e,yesterday,abc,1.5,maybe,x": [
        ("at", "yesterday", "not of type timestamp_ntz"), ("amount", "abc", "not of type decimal(10,2)"), ("n", "1.5", "not of type int"), ("ok", "maybe", "not of type boolean"),
    ],
    "f,,123456789012,99999999999,,": [("amount", "123456789012", "not of type decimal(10,2)"), ("n", "99999999999", "not of type int")],
    "g,,1": [(None, None, "column count")],
    "h,,1,1,True,x,surplus": [(None, None, "column count")],
    ",,1,1,True,x": [("id", None, "missing")],
}


def _file(spark, lines, header=True):
    path = scratch_path(spark, "records")
    text = ([",".join(SCHEMA.names)] if header else []) + list(lines)
    spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.text(path)
    return path


@pytest.mark.parametrize("multi", [True, False])
def test_every_record_is_in_one_place(spark, multi):
    good = GOOD if multi else [g.replace("\n", " ") for g in GOOD]
    path = _file(spark, [*good, *BAD])
    rows, rejects = parse(read_records(spark, path, SCHEMA, multi), SCHEMA, "f", ["id"])
    assert rows.schema.simpleString() == SCHEMA.simpleString()
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {"a", "b", "c"} and tuple(got["b"])[1:] == (None,) * 5
    assert got["a"].note == ('two\nlines, and "quotes"' if multi else 'two lines, and "quotes"')
    assert str(got["a"].at) == "2017-01-31 10:00:00" and str(got["a"].amount) == "12.50" and got["a"].n == 3 and got["a"].ok is True
    want = sorted((("f", *f) for fs in BAD.values() for f in fs), key=str)
    assert sorted((tuple(r)[:4] for r in rejects.collect()), key=str) == want
    assert all(r.record for r in rejects.collect())


def test_quarantine_grows(spark):
    quarantine = scratch_path(spark, "quarantine")
    for lines in (GOOD + list(BAD), GOOD, list(BAD)[:1]):
        ingest(spark, _file(spark, lines), SCHEMA, "reviews", quarantine, ["id"]).count()
    assert spark.read.parquet(quarantine).count() == 11


def test_only_faults(spark):
    rows, rejects = parse(read_records(spark, _file(spark, BAD), SCHEMA, False), SCHEMA, "f", ["id"])
    assert rows.count() == 0 and rejects.select("record").distinct().count() == len(BAD)
    rows, rejects = parse(read_records(spark, _file(spark, []), SCHEMA, False), SCHEMA, "f")
    assert rows.count() == 0 == rejects.count()


@pytest.mark.parametrize("name", ["orders", "payments", "reviews"])
def test_exports_with_faults(spark, name):
    st = load_star(spark, SF)
    rows, rejects = quarantined(st, name)
    table = getattr(st, name)
    assert rows.exceptAll(table).count() == 0 == table.exceptAll(rows).count()
    ids = [int(r.order_id) for r in table.select("order_id").collect()]
    assert rejects.count() == sum(i % n == 0 for f, _, _, n in FAULTS if f == name for i in ids) > 0
