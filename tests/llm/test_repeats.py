"""Repeated passages against all windows, and the suffix array against sorting."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import repeats
from marketlens.llm.gsaca import suffix_array


def test_suffix_array():
    rnd = random.Random(1)
    for _ in range(3000):
        s = [rnd.randint(1, rnd.randint(1, 5)) for _ in range(rnd.randint(0, 30))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    s = list(b"abracadabra" * 200)
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(texts):
    count = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()


def found(df):
    rows = repeats.remove(df).select("*", F.sha2("kept", 256).alias("h")).collect()
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.h) for r in rows)


def expected(rows):
    return Counter((d, *x) for (d, _), x in zip(rows, brute([(t or "").encode() for _, t in rows])))


def test_documents(docs, doc_rows):
    assert found(docs) == expected([(r[0], r[1]) for r in doc_rows])


@pytest.mark.parametrize("most", [1000, 3])
def test_passages(spark, most, monkeypatch):
    """Small cores by suffix sorting; beyond MOST members by counting."""
    monkeypatch.setattr(repeats, "MOST", most)
    rnd = random.Random(4)
    text = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    base = text("abcdefgh ", 3000)
    texts = [text("xyz ", rnd.randint(0, 300)) + base[a : a + rnd.randint(300, 900)] + text("xyz ", rnd.randint(0, 300)) for a in (rnd.randint(0, 2000) for _ in range(40))]
    texts += ["a" * 1500, "ab" * 900, "abc" * 150, "q" * 399, "q" * 400, "q" * 401, "", None, "é" * 500, "z" + base[:420], "y" + base[:420], base[:399] + "!", texts[0]]
    texts += [base[100 + k : 500 + k + rnd.randint(0, 3)] + str(k) for k in range(30)]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == expected(rows)


def shared_words(rows):
    """Of each row: words in runs of 50 that a row of other id or text has."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for _, t in rows]
    holders = defaultdict(set)
    for row, w in zip(rows, split):
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(row)
    out = []
    for (d, _), w in zip(rows, split):
        again = [i for i in range(len(w) - 49) if len(holders[tuple(w[i : i + 50])]) > 1]
        out.append((d, len({j for i in again for j in range(i, i + 50)})))
    return Counter(out)


def found_words(df):
    return Counter((r.doc_id, r.n_shared_words) for r in repeats.remove(df).collect())


def test_shared_words_of_documents(docs, doc_rows):
    want = shared_words([(r[0], r[1]) for r in doc_rows])
    assert sum(n > 0 for _, n in want) > 3
    assert found_words(docs) == want


@pytest.mark.parametrize("most", [1000, 3])
def test_short_passages(spark, most, monkeypatch):
    """Passages of over 50 words and under 400 bytes stay, and are told."""
    monkeypatch.setattr(repeats, "MOST", most)
    rnd = random.Random(6)
    words = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(n)]
    base = words(600)
    texts = []
    for _ in range(60):
        a = rnd.randint(0, 540)
        texts.append(rnd.choice((" ", "\n", " \t")).join(words(rnd.randint(0, 90)) + base[a : a + rnd.randint(45, 90)] + words(rnd.randint(0, 90))))
    planted = words(51)
    assert len(" ".join(planted)) < 400
    texts += [" ".join(words(30) + planted + words(30)), " ".join(words(7) + planted).upper(), "\n".join(planted)]
    texts += [" ".join(words(5) + planted[:50]), " ".join(words(5) + planted[:49])]  # one word less than a run
    twice = words(60)
    texts += [" ".join(twice + words(3) + twice), "x " * 300, "", None, " ".join(words(500))]  # repeats within a document only
    texts += [" ".join(base[100 + k : 160 + k] + words(2)) for k in range(30)]
    rows = [*enumerate(texts), (60, texts[60]), (7000, texts[63]), (61, None)]  # a row twice, a text twice
    rows += [(8000, " ".join(twice[:49])), (8001, "own " + " ".join(words(60))), (8001, "own " + " ".join(words(60)))]
    want = shared_words(rows)
    assert want[60, 51] == 2 and want[62, 51] == 1 and want[65, 0] == 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_words(df) == want
    assert found(df) == expected(rows)


def test_query_tells_shared_words(spark, tmp_path):
    rnd = random.Random(7)
    text = lambda n: " ".join(str(rnd.randint(100, 99999)) for _ in range(n))
    passage = text(55)
    rows = [(1, f"{text(20)} {passage} {text(20)}"), (2, f"{text(9)} {passage}"), (3, text(200))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = repeats.query(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_removed, r.n_shared_words) for r in got} == {1: (0, 55), 2: (0, 55), 3: (0, 0)}


def test_hashes_of_a_text_longer_than_a_piece(monkeypatch):
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, repeats.PIECE * 2 + 500).astype(np.uint8)
    buf[-400:] = buf[:400]
    h = repeats.Hashes(buf)
    a = np.array([0, len(buf) - 400, repeats.PIECE - 7])
    x = h.of(a, a + 400)
    assert x[0] == x[1] != x[2]
    part = repeats.Hashes(buf[repeats.PIECE - 7 : repeats.PIECE + 393])
    assert part.of(np.array([0]), np.array([400]))[0] == x[2]


def test_empty(no_docs):
    assert repeats.remove(no_docs).count() == 0
