"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from marketlens.llm import nra

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plainly(docs, items, top=10):
    """(item_id, rank, doc_id, score), sorted; docs and items are (id, text)."""
    bags = [(i, Counter(t)) for i, text in docs if (t := terms_of(text))]
    if not bags:
        return []
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    held = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for doc, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * n_docs) // total
            score = 0
            for t in set(terms_of(text)):
                if tf := bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return sorted(out, key=str)


def found(docs, items):
    return sorted((tuple(r) for r in nra.search(docs, items).collect()), key=str)


def asked(doc_rows):
    texts = [r[1] for r in doc_rows if r[1]]
    items = [(i, texts[i * 3 % len(texts)][: 20 + 9 * i]) for i in range(24)]
    items += [(50, None), (51, ""), (52, " .,;!"), (53, "nothing holds qqqqqq"), (54, "THE the The"), (54, "river"), (54, "river"), (None, "stone light"), (55, "schön ÜBER über")]
    return items


ITEMS = "item_id long, text string, rank int, score long, doc_id long"


def frame(spark, items):
    return spark.createDataFrame([(*i, 1, 2, 3) for i in items], ITEMS)


@pytest.mark.parametrize("postings, documents, block", [(1 << 20, 1 << 15, 1 << 17), (40, 1 << 15, 1 << 17), (1 << 20, 16, 60)])
def test_documents(spark, docs, doc_rows, postings, documents, block, monkeypatch):
    """Segments and blocks of any size."""
    monkeypatch.setattr(nra, "POSTINGS", postings)
    monkeypatch.setattr(nra, "DOCUMENTS", documents)
    monkeypatch.setattr(nra, "BLOCK_TERMS", block)
    items = asked(doc_rows)
    assert found(docs, frame(spark, items)) == plainly([r[:2] for r in doc_rows], items)


def segment(rows, vocabulary, n_docs, total, held):
    table = pa.table({
        "doc_id": pa.array([i for i, _ in rows], pa.int64()),
        "n": pa.array([sum(b.values()) for _, b in rows], pa.int64()),
        "terms": pa.array([[vocabulary.index(t) for t in b] for _, b in rows], pa.list_(pa.int32())),
        "tfs": pa.array([list(b.values()) for _, b in rows], pa.list_(pa.int32())),
    })
    return nra.Segment(table, nra.weights(np.array([held[t] for t in vocabulary]), n_docs), n_docs, total)


@pytest.mark.parametrize("read", [1, 2, 64])
@pytest.mark.parametrize("seed", range(6))
def test_reads_resolve_everything(read, seed, monkeypatch):
    """The intervals close on the same ten, whatever is read at a time; ties in
    thousands of copies go by doc_id; a bound from before loses none above it."""
    monkeypatch.setattr(nra, "READ", read)
    rnd = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(30)]
    rows = [(i, Counter(rnd.choices(vocabulary, [1 / (k + 1) for k in range(30)], k=rnd.randint(1, 40)))) for i in range(300)]
    copy = Counter(rnd.choices(vocabulary, k=12))
    rows += [(1000 - i, copy) for i in range(200)]
    rnd.shuffle(rows)
    n_docs, total = len(rows), sum(sum(b.values()) for _, b in rows)
    held = Counter(t for _, b in rows for t in b)
    part = segment(rows, vocabulary, n_docs, total, held)
    docs = [(i, " ".join(b.elements())) for i, b in rows]
    for text in [" ".join(rnd.sample(vocabulary, k)) for k in (1, 2, 5, 12, 30)] + [" ".join(copy)]:
        want = [(d, s) for _, _, d, s in sorted(plainly(docs, [(1, text)]), key=lambda r: r[1])]
        for least in (1, want[0][1], want[-1][1], want[-1][1] + 1, want[0][1] + 1):
            got, score = part.best(np.array([vocabulary.index(t) for t in text.split()]), least)
            assert list(zip((part.ids[int(g)].as_py() for g in got), score.tolist())) == [x for x in want if x[1] >= least]


def test_reads_stop_early(monkeypatch):
    """A rare term decides: the frequent term's list isn't read to its end."""
    rows = [(i, Counter({"common": 1, f"x{i}": 30 + i % 7})) for i in range(5000)] + [(9000 + i, Counter({"rare": 3, "common": 9})) for i in range(12)]
    vocabulary = ["common", "rare"]
    bags = [(i, Counter({t: n for t, n in b.items() if t in vocabulary})) for i, b in rows]
    held = Counter(t for _, b in rows for t in b)
    part = segment(bags, vocabulary, len(rows), sum(sum(b.values()) for _, b in rows), held)
    sums = []
    monkeypatch.setattr(nra, "READ", 16)
    real = np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: sums.append(1) or real(x))
    got, _ = part.best(np.array([0, 1]), 1)
    assert [part.ids[int(g)].as_py() for g in got] == list(range(9000, 9010)) and len(sums) <= 2


def test_long_products():
    n = np.array([10**7, 3], np.int64)
    assert nra.lengths(n, 3 * 10**10, 10**13).tolist() == [10 + 90 * int(x) * 3 * 10**10 // 10**13 for x in n]


def test_empty(spark, docs, no_docs, doc_rows):
    items = frame(spark, asked(doc_rows))
    assert found(no_docs, items) == [] and found(docs, items.limit(0)) == []
    assert nra.search(docs, items.limit(0)).columns == nra.search(no_docs, items).columns


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = sorted(tuple(r) for r in nra.query(spark, sf).collect())
    assert got and got == sorted(con.execute(nra.ORACLE_SQL).fetchall())
