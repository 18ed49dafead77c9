"""Collocations against counts of all sequences."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from marketlens.llm import collocations as co

DOCS = "text string, lang string, rank long, phrase string, n long, f long"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def counted(rows):
    """lang: counts of the sequences of one to five words."""
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return f


def plainly(rows, least, first):
    out = []
    for lang, f in counted(rows).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            longer = (h for h in f if len(h) > len(g) and f[h] >= a and any(h[i : i + len(g)] == g for i in range(len(h))))
            if any(True for _ in longer):
                continue
            score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:first])]
    return sorted(out)


def texts(seed=3, n=60):
    rnd = random.Random(seed)
    words = ["a", "b", "c", "d", "The", "é", "of"]
    rows = []
    for i in range(n):
        t = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]) for _ in range(rnd.randint(0, 30)))
        rows.append((t, rnd.choice(["en", "de", None, "und"])))
    passage = " ".join(f"p{i}" for i in range(23))
    rows += [(f"x{i} {passage} y{i}. tail", "en") for i in range(5)] + [(passage, "en"), (passage + " a b", "de")] * 4
    rows += [("go go go go go go go go", "en"), ("go " * 40, "en"), ("left alone here\x0bagain", "en")]
    rows += [(None, "en"), ("", None), (" .;!? \n", "en"), ("one", "en"), ("ein langes " * 3000, "de")]
    return rows + rows[:3]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCS).repartition(5)


def found(df, first=2000):
    return sorted(tuple(r) for r in co.collocations(df, first=first).collect())


@pytest.mark.parametrize("least, first, held", [(3, 2000, 1 << 20), (2, 7, 50), (5, 1, 1)])
def test_texts(spark, least, first, held, monkeypatch):
    monkeypatch.setattr(co, "LEAST", least)
    monkeypatch.setattr(co, "HELD", held)
    rows = texts()
    got = found(frame(spark, rows), first)
    assert got == plainly(rows, least, first) and len(got) >= 3


def test_without_cuts(spark, monkeypatch):
    """The bit tables cut pieces and change nothing else."""
    monkeypatch.setattr(co, "LEAST", 3)
    rows = texts(5)
    monkeypatch.setattr(co, "has_bit", lambda table, x: x == x)
    assert found(frame(spark, rows)) == plainly(rows, 3, 2000)


def test_paths(spark, monkeypatch):
    """Each frequent sequence of five lies in one path, whose parts have its
    weight; a passage of 23 words is one path."""
    monkeypatch.setattr(co, "LEAST", 4)
    rows = texts()
    paths = co.passages(frame(spark, rows)).collect()
    seen = Counter()
    f = counted(rows)
    for p in paths:
        ws = tuple(p.phrase.split(" "))
        for i in range(len(ws) - 4):
            assert f[p.lang][ws[i : i + 5]] == p.a
            seen[p.lang, ws[i : i + 5]] += 1
    assert set(seen.values()) == {1}
    assert set(seen) == {(lang, g) for lang, c in f.items() for g, n in c.items() if len(g) == 5 and n >= 4}
    whole = " ".join(f"p{i}" for i in range(23))
    assert [(p.phrase, p.a) for p in paths if p.lang == "en" and "p3" in p.phrase.split()] == [(whole, f["en"][tuple(whole.split()[:5])])]


def test_large_products(spark):
    """Products beyond 64 bits are exact."""
    big = 3_000_000_000
    grams = spark.createDataFrame([([1], big, "en", "a"), ([2], big + 1, "en", "b"), ([1, 2], big - 1, None, None)], "gram array<long>, f long, lang string, word string")
    totals = spark.createDataFrame([("en", 7 * 10**15)], "lang string, total long")
    got = co._scored(grams.where("size(gram) = 2").select("gram", "f"), grams, totals).first()
    assert got.score == 1000 * (big - 1) * 7 * 10**15 // (big * (big + 1))


def test_empty(spark, monkeypatch):
    assert found(frame(spark, texts()).limit(0)) == []
    assert found(frame(spark, [("a few words only", "en"), (None, None)])) == []


def test_sql(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(co, "LEAST", 20)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.execute(co.ORACLE_SQL.replace("f >= 100", "f >= 20")).fetchall()
    got = sorted(tuple(r) for r in co.query(spark, sf).collect())
    assert len(got) > 50 and got == sorted(want)
