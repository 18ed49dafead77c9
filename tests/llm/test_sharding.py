"""Sharding against one sort of all records, with few and many ranges."""

import hashlib
import re
import zlib

import duckdb
import pytest
from marketlens.llm import sharding


def plainly(rows, n_shards):
    """(doc_id, size, crc, shard, slot) of (doc_id, text) rows, sorted."""
    recs = []
    for i, t in rows:
        grp = -1 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
        recs.append((grp, i is not None, i or 0, len((t or "").encode()) + 8, i, zlib.crc32((t or "").encode())))
    recs.sort()
    total, n = sum(r[3] for r in recs), len(recs)
    size, count = {}, {}
    for r in recs:
        size[r[0]] = size.get(r[0], 0) + r[3]
        count[r[0]] = count.get(r[0], 0) + 1
    out, upto, start, slots = [], 0, {}, {}
    for r in recs:
        start.setdefault(r[0], upto)
        upto += r[3]
        split = count[r[0]] > 1 and (size[r[0]] * 100 * n_shards > total or count[r[0]] * 100 * n_shards > n)
        mid = 2 * upto - r[3] if split else 2 * start[r[0]] + size[r[0]]
        shard = min(n_shards - 1, mid * n_shards // (2 * total))
        out.append((r[4], r[3], r[5], shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
    return out


def found(df, n_shards):
    return [tuple(r) for r in sharding.shards(df, n_shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[3], r[4]))


@pytest.mark.parametrize("rows, pieces, over", [(2048, 1024, 32), (4, 3, 2), (1, 2, 1), (3, 1024, 8)])
@pytest.mark.parametrize("n_shards", [1, 5, 24])
def test_documents(spark, docs, doc_rows, n_shards, rows, pieces, over, monkeypatch):
    """The ranges divide the work, not the result."""
    monkeypatch.setattr(sharding, "ROWS", rows)
    monkeypatch.setattr(sharding, "PIECES", pieces)
    monkeypatch.setattr(sharding, "OVER", over)
    assert ordered(found(docs, n_shards)) == plainly([r[:2] for r in doc_rows], n_shards)


def hot_rows():
    rows = [(i, f"text {i} " + "x" * (i % 97)) for i in range(900)]
    rows += [(10_000 + i, "the same text") for i in range(700)]  # a group of a third
    rows += [(5, None)] * 300  # one row many times
    rows += [(20_000 + i, "") for i in range(200)]
    return rows


def test_hot_groups_spread(spark, monkeypatch):
    """A group of a third of all rows and a row repeated 300 times are sorted
    in many ranges, and the shards are equal up to a record or a small group."""
    monkeypatch.setattr(sharding, "ROWS", 16)
    monkeypatch.setattr(sharding, "PIECES", 8)
    rows = hot_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = found(df, 12)
    assert ordered(got) == plainly(rows, 12)
    by = {}
    for r in got:
        by[r[3]] = by.get(r[3], 0) + r[1]
    mean = sum(by.values()) / 12
    assert len(by) == 12 and max(by.values()) - min(by.values()) <= 2 * max(r[1] for r in got) + mean / 50

    kept = []
    real = sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda d, name: kept.append((name, out := real(d, name))) or out)
    sharding.shards(df, 12)
    placed = dict(kept)["sharding-placed"]
    most = placed.groupBy("cell", "sub").count().agg({"count": "max"}).first()[0]
    assert most <= 150, most  # of 2,100 rows


def test_same_for_any_partitioning(spark, docs):
    assert sorted(found(docs, 24), key=str) == sorted(found(docs.repartition(3), 24), key=str)


def test_copies_lie_together(spark, docs, doc_rows):
    """The documents' groups of copies, small beside a shard of two."""
    rows = [(i, f"one of many texts {i // 2} ") for i in range(2000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert got.groupBy("text_crc32").agg({"shard": "max", "slot": "max"}).count() == 1000
    assert got.selectExpr("doc_id div 2 as pair", "shard").distinct().count() == 1000


def test_write(spark, docs, doc_rows, tmp_path):
    sharding.write(docs, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.drop("shard").columns == docs.columns
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, docs.collect()))
    assert {r.shard for r in back.select("shard").distinct().collect()} == {r[3] for r in plainly([r[:2] for r in doc_rows], 5)}
    clash = docs.withColumnRenamed("key", "shard")
    sharding.write(clash, f"{tmp_path}/clash", 5)
    assert "_shard" in spark.read.parquet(f"{tmp_path}/clash").columns


def test_empty_and_small(spark, no_docs):
    assert found(no_docs, 24) == []
    one = spark.createDataFrame([(7, "a")], "doc_id long, text string")
    assert found(one, 24) == plainly([(7, "a")], 24)


def test_native(spark, docs, monkeypatch):
    """No plan of any step runs Python."""
    plans = []
    real = sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda d, name: plans.append(d) or real(d, name))
    plans.append(sharding.shards(docs))
    assert len(plans) > 5
    for d in plans:
        assert not re.search("Python|Pandas|Arrow", d._jdf.queryExecution().toString())


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert sorted(tuple(r) for r in sharding.query(spark, sf).collect()) == sorted(con.execute(sharding.ORACLE_SQL).fetchall())
