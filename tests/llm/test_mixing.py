"""Mixing against iterated water-filling and a plain prefix sum."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import pytest

from marketlens.llm import mixing
from marketlens.llm.registry import ORACLE_SQL


def filled(words):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(words.values())
    while True:
        rest = total - sum(3 * words[s] for s in full)
        open_ = [s for s in names if s not in full]
        got = {s: weight[s] * rest / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if got[s] > 3 * words[s]]
        if not above:
            return {s: got.get(s, 3.0 * words[s]) for s in names}
        full.update(above)


@pytest.mark.parametrize("words", [{"a": 10, "b": 1000, "c": 5, None: 400}, {"a": 0, "b": 7}, {"x": 3}, {str(i): 10**i for i in range(8)}, {}])
def test_targets(spark, words):
    df = spark.createDataFrame([(s, w, 1) for s, w in words.items()], "source string, words long, docs long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = filled(words) if words else {}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_words(spark):
    texts = [None, "", " \t\n", "a", " a  b\x0bc ", "a b c", "\x1ca"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(mixing.words(df.text).alias("n")).collect()] == [len((t or "").encode().split()) for t in texts]


def quality_of(spark, pairs):
    return mixing.qualities(spark.createDataFrame(pairs, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("slot", [2000, 2])
def test_documents(spark, docs, doc_rows, slot, monkeypatch):
    """The two-level prefix sum equals one over each source."""
    monkeypatch.setattr(mixing, "SLOT", slot)
    labels = [(1, 1, 0), (9, 0, 0), (9, 0, 1), (30, 1, 0), (31, 0, None), (None, 1, 1), (40, None, 0)]
    rows = mixing.mix(docs, quality_of(spark, labels)).collect()
    assert len(rows) == len(doc_rows)
    size = lambda t: len((t or "").encode().split())
    own = defaultdict(int)
    for r in doc_rows:
        own[r[3]] += size(r[1])
    target = filled(dict(own))
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == own[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in own:
        assert abs(taken[s] - target[s]) <= max(size(r[1]) for r in doc_rows if r[3] == s) / 2 + 1e-6
    weight = {1: 1.5, 9: 0.5, 30: 1.5, 31: 0.5}
    for s in own:  # who is taken: ascending draws
        known = [r for r in rows if r.source == s and r.doc_id is not None and r.size]
        u = lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        known.sort(key=lambda r: (-math.log(u(r.doc_id)) / weight.get(r.doc_id, 1.0), r.doc_id, r.key))
        copies = [r.copies for r in known]
        assert all(a >= b for a, b in zip(copies, copies[1:]))


def test_mix_repeats_rows(spark, docs, doc_rows):
    quality = quality_of(spark, [])
    out = mixing.mixed(docs, quality)
    assert out.schema == docs.schema
    want = Counter()
    for r in mixing.mix(docs, quality).collect():
        want[(r.doc_id, r.size)] += r.copies
    got = Counter((r.doc_id, len((r.text or "").encode().split())) for r in out.collect())
    assert got == +want


def test_reruns_agree_and_sql_too(spark):
    sf = "/root/testdata/sf0.001"
    a, b = (sorted(tuple(r) for r in mixing.query(spark, sf).collect()) for _ in range(2))
    assert a == b
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    assert a == sorted(con.execute(ORACLE_SQL["op5_mixing"]).fetchall())


def test_empty(spark, no_docs):
    quality = quality_of(spark, [])
    assert mixing.mix(no_docs, quality).count() == 0 and mixing.mixed(no_docs, quality).count() == 0
