"""Jaccard join against all pairs."""

import random

from marketlens.llm import jaccard
from marketlens.llm.components import connected_components


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    """(doc_id, n, component id) of each (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(d, ids.get(top(i), d))
    return sorted(((d, len(sets[i]), ids.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(df).collect()), key=str)


def test_awkward_documents(docs, doc_rows):
    assert found(docs) == brute([(r[0], r[1]) for r in doc_rows])


def near_copies(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for length in (8, 20, 60, 100, 130, 200):
        base = [word() for _ in range(length)]
        for _ in range(n):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, length // 16))):
                w[rnd.randrange(length)] = word()
            if rnd.random() < 0.3:
                w += passage[: rnd.randint(5, 60)]
            rows.append(" ".join(w))
    return list(enumerate(rows))


def test_near_copies_of_all_sizes(spark):
    rows = near_copies(3, 25)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_frequent_classes_and_large_buckets(spark, monkeypatch):
    """With every shared token frequent and every bucket large, pairs of tokens
    and carried signatures do the work."""
    monkeypatch.setattr(jaccard, "_excess", lambda counts: (counts > 1).astype("int64") * counts)
    monkeypatch.setattr(jaccard, "LARGE", 2)
    rows = near_copies(4, 20)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_keep_one_of_each_group(docs, doc_rows):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    comp = {}
    for d, n, c in brute([(r[0], r[1]) for r in doc_rows]):
        comp.setdefault((c if n else ("empty", d)), []).append((d, n))
    assert kept.count() == sum(1 for c in comp if not isinstance(c, tuple)) + sum(len(v) for c, v in comp.items() if isinstance(c, tuple))


def test_empty(no_docs):
    assert jaccard.link(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, i) for i in range(501, 600)] + [(rnd.randint(1000, 1400), rnd.randint(1000, 1400)) for _ in range(150)] + [(7, 7)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges for x in (a, b) if a != b}
