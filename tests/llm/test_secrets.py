"""Secret scan against plain regular expressions, and planted random keys."""

import hashlib
import random
import re
import string
import time
from collections import Counter

from marketlens.llm import secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def test_base_spans_match_plain_regexes(docs, doc_rows):
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digests(secrets.spans(docs)).collect())
    want = Counter()
    for r in doc_rows:
        b = base(r[1])
        want[(r[0], *(sum(x[1] == k for x in b) for k in range(3)), digest(b))] += 1
    assert got == want


def test_positions_of_many_matches(spark):
    text = "é " + " x ".join("%016x" % (i * 7919) for i in range(1500))
    (row,) = secrets.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.start, s.end) for s in row.base] == [(a, b) for a, _, b, _ in base(text)]


def test_battery_reports_random_runs_only(spark):
    rnd = random.Random(5)
    alphabets = [string.ascii_letters + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/"]
    key = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    rows = [(i, f"see {key(rnd.choice(alphabets), rnd.choice([32, 40, 64]))} end") for i in range(150)]
    rows += [(i, "see " + "".join(rnd.choice(["the", "tion", "and", "er1", "2on", "Of", "ing"]) for _ in range(12)) + " end") for i in range(150, 300)]
    rows += [(300, "a" * 40 + "1"), (301, "12" * 20 + "a"), (302, "report-2024-01-01-final-version")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == ["random"] for i in range(150)) >= 140
    assert not any("random" in got[i] for i in range(150, 303))


def test_redaction_keeps_rows_and_other_columns(docs, doc_rows):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(doc_rows)
    assert not any(base(r.text) for r in rows)
    clean = {r[0] for r in doc_rows if not base(r[1])}
    assert Counter((r.doc_id, r.text) for r in rows if r.doc_id in clean) == Counter((r[0], r[1]) for r in doc_rows if r[0] in clean)


def test_long_runs_and_many_spans_take_time_in_proportion(spark):
    """Work on a run grew with the square of its length (20,000 characters: more
    than a minute), that on overlaps and cuts with the square of their number."""
    rnd = random.Random(6)
    key = lambda n: "".join(rnd.choices(string.ascii_letters + string.digits + "+/", k=n))
    many = "é\U0001f642 " + " ".join(rnd.choice([f"token={key(24)}", key(40), "%032x" % rnd.getrandbits(128), "word"]) for _ in range(3000))
    df = spark.createDataFrame([(0, f"see {key(40000)} end"), (1, many), (2, "nothing")], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r for r in secrets.spans(df).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert time.time() - began < 60
    assert [tuple(s) for s in found[1].base] == base(many)
    assert any(s.kind == "random" for s in found[1].spans)
    assert not any(s.kind == "random" and any(b.start < s.end and s.start < b.end for b in found[1].base) for s in found[1].spans)
    for i, text in ((0, df.first().text), (1, many), (2, "nothing")):
        want, end = "", 0
        for s in found[i].spans:  # overlapping and touching ones as one
            if s.start > end or not want:
                want += text[end : s.start] + "[SECRET]"
            end = max(end, s.end)
        assert clean[i] == want + text[end:]


def test_native_plan(docs):
    plan = secrets.redact(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(no_docs):
    assert secrets.digests(secrets.spans(no_docs)).count() == 0
