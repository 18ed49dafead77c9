"""Language model: counts and base against plain ones, a proper distribution,
held-out perplexity and the seating scheme."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import pitmanyor as P


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def trains(d):
    return d is None or zlib.crc32(str(d).encode()) % 7 != 2


def train_column():
    return P._training(F.col("doc_id"), 7, 2)


def test_counts_and_base(docs, doc_rows):
    c = Counter()
    for r in doc_rows:
        if trains(r[0]):
            c.update(tokens(r[1]))
    total, types = sum(c.values()), len(c)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in P.score(docs, train_column()).collect()), key=str)
    want = []
    for r in doc_rows:
        t = tokens(r[1])
        base = sum(math.log10((c[w] + 1) / (total + types + 1)) for w in t)
        want.append((r[0], len(t), sum(c[w] > 0 for w in t), total, round(base, 6)))
    assert got == sorted(want, key=str)


def test_rare_words_by_the_join(docs, monkeypatch):
    """Scores don't depend on how many words are broadcast."""
    key = lambda r: (str(r[0]), r[1], round(r[2], 9), round(r[3], 9))
    rows = lambda: sorted(key((r.doc_id, r.n_known, r.base_score, r.score)) for r in P.score(docs, train_column()).collect())
    whole = rows()
    monkeypatch.setattr(P, "HEAD", 3)
    assert rows() == whole


def test_proper_distribution_and_held_out_perplexity(spark):
    src = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("train", train_column())
    table = P._word_table(src)
    model = P.fit(table)
    words = P._scored_words(table, model)
    known = words.where("known = 1").agg(F.sum(F.pow(F.lit(10.0), "lm"))).first()[0]
    unknown = words.where("known = 0").agg(F.max(F.pow(F.lit(10.0), "lm")), F.min(F.pow(F.lit(10.0), "lm"))).first()
    assert unknown[0] == unknown[1] and known + unknown[0] == pytest.approx(1, abs=1e-9)
    held = P.score(src.select("doc_id", "text"), train_column()).where("not train").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert held[2] > held[1]
    np.testing.assert_allclose(model.sweeps[0].after.p2.sum(axis=-1)[:-1, :-1].max(), 1, atol=0.05)


def test_seating_agrees_with_customers_one_by_one():
    """Mean tables of the block scheme against a plain simulation."""
    rng = np.random.default_rng(3)
    n, base, total, d = 400, 0.02, 500.0, 0.6
    a = (P.STRENGTH + d * total) * base
    plain = []
    for _ in range(60):
        t = 1
        for i in range(1, n):
            t += rng.random() * (i - d * t + a) < a
        plain.append(t)
    ids = np.arange(4000, dtype=np.uint64)
    t = P.seat(np.full(4000, float(n)), np.full(4000, base), total, d, ids, 0)
    assert abs(t.mean() - np.mean(plain)) < 0.08 * np.mean(plain)
    assert (t >= 1).all() and (t <= n).all()
    assert (P.seat(np.full(4000, float(n)), np.full(4000, base), total, d, ids, 0) == t).all()


def test_poisson():
    u = (np.arange(20000) + 0.5) / 20000
    v = np.random.default_rng(0).random(20000)
    for mean in (0.0, 0.3, 4.0, 60.0):
        x = P._poisson(np.full(20000, mean), np.random.default_rng(1).permutation(u), v)
        assert abs(x.mean() - mean) < 0.15 and abs(x.var() - mean) < 0.05 * mean + 0.05


def test_nothing_to_learn(spark, no_docs):
    assert P.score(no_docs, train_column()).count() == 0
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = P.score(df, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in rows)


def test_preceding_words_are_contexts(spark):
    """The order of the words counts, and a word pair that was seen is likelier
    than the same words in another order."""
    rows = [(i, "red stone blue river red stone blue river") for i in range(40)] + [(100, "red stone blue river"), (101, "river blue stone red")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in P.score(df, F.col("doc_id") < 100).collect()}
    assert got[100] > got[101] + 1


def test_every_context_sums_to_one(spark, doc_rows, monkeypatch):
    """Scores of one-word texts, as differences, against a whole distribution:
    what may follow the end token, by texts of every type."""
    monkeypatch.setattr(P, "HEAD", 6)
    rows = [(r[0], r[1]) for r in doc_rows]
    src = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", train_column())
    table = P._word_table(src)
    names = P._head(table)
    model = P.fit(table, P._pair_table(src, names, table.agg(F.sum("n")).first()[0]), names)
    scored = {r.word: r for r in P._scored_words(table, model).collect()}
    gains = {r.pair: r.gain for r in P._gains(model, P._scored_words(table, model), names).collect()}
    c = Counter()
    for d, t in rows:
        if trains(d):
            w = tokens(t)
            c.update(zip([None, *w], w))
    hashes = {None: P.END}
    for w in {w for p in c for w in p if w is not None}:
        hashes[w] = int(P.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0].view(np.int64)[0])
    unknown = 1 - sum(10**scored[h].lm for h in hashes.values())
    for u in (None, b"the", b"tail", b"und"):
        total, s = 0.0, scored[hashes[u]]
        for w, h in hashes.items():
            pair = int(P._pair(np.array([hashes[u]]), np.array([h])).view(np.int64)[0])
            lm = scored[h].lm
            gain = gains.get(pair, float(model.gain(1.0, 1.0, s.context, s.back, lm))) if c[u, w] else 0.0
            assert c[u, w] < 2 or pair in gains
            total += 10 ** (s.back + lm + gain)
        assert total + 10**s.back * unknown == pytest.approx(1, abs=1e-9)


def test_scores_by_tokens_one_by_one(spark, monkeypatch):
    """Every text's score, with a hot context and in many units and buckets, is the
    sum of its tokens' own; pairs meet texts in packed rows, a few for a unit."""
    rnd = np.random.default_rng(5)
    few = ["the", "of", "and", "river", "stone"]
    rows = [(i, " ".join("the W%d" % rnd.integers(400) if rnd.random() < 0.6 else few[rnd.integers(5)] for _ in range(40))) for i in range(150)]
    rows += [(500, None), (501, ""), (501, "the"), (502, "unseen words the river"), (None, "the w1 the w1"), rows[3]]
    src = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    for name, value in (("HEAD", 20), ("UNIT", 2000), ("BUCKET", 1000), ("WORD_BUCKET", 100)):
        monkeypatch.setattr(P, name, value)
    found = P.score(src, train_column())
    plan = found._jdf.queryExecution().toString()
    assert "Generate" not in plan and "FlatMapCoGroupsInArrow" in plan
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in found.collect())

    marked = src.withColumn("train", train_column())
    table = P._word_table(marked)
    names, n = P._head(table), table.agg(F.sum("n")).first()[0]
    pairs = P._pair_table(marked, names, n)
    assert 1 < pairs.count() <= -(-n // P.BUCKET)
    model = P.fit(table, pairs, names)
    words = P._scored_words(table, model)
    scored = {r.word: r for r in words.collect()}
    gains = {r.pair: r.gain for r in P._gains(model, words, names).collect()}
    c = Counter(p for d, t in rows if trains(d) for p in zip([None, *tokens(t)], tokens(t)))
    key = lambda w: P.END if w is None else int(P.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0].view(np.int64)[0])
    want = []
    for d, t in rows:
        w = tokens(t)
        total = 0.0
        for u, v in zip([None, *w], w):
            a, b = scored[key(u)], scored[key(v)]
            pair = int(P._pair(np.array([a.word]), np.array([b.word])).view(np.int64)[0])
            assert (c[u, v] > 1) == (pair in gains)
            total += a.back + b.lm + (gains[pair] if c[u, v] > 1 else float(model.gain(1.0, 1.0, a.context, a.back, b.lm)) if c[u, v] else 0.0)
        known = [scored[key(x)] for x in w]
        want.append((str(d), len(w), sum(r.known for r in known), round(sum(r.base for r in known), 6), round(total, 6)))
    assert got == sorted(want)
