"""Personal data against plain regular expressions."""

import hashlib
import random
import re
from collections import Counter

from marketlens.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def test_scan_equals_plain_regexes():
    rnd = random.Random(2)
    for _ in range(20_000):
        t = "".join(rnd.choice("ab1.9@@_. -+x é25()0") for _ in range(rnd.randint(0, 40)))
        assert [s[:3] for s in pii.find(t) if s[2] in pii.BASE] == [(a, b, k) for a, _, b, k in base(t)], t


def test_documents(docs, doc_rows):
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digests(pii.spans(docs)).collect())
    want = Counter()
    for r in doc_rows:
        b = base(r[1])
        text = ",".join(f"{k}:{a}:{e}" for a, _, e, k in b)
        want[(r[0], *(sum(x[1] == k for x in b) for k in range(4)), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE88 3704 0044 0532 0130 00")
    kinds = lambda t: [s[2] for s in pii.find(t)]
    assert kinds("account DE89370400440532013000") == ["iban"]
    assert kinds("ssn 123-45-6789") == ["natid"] and kinds("part 123-45-6789") == []
    near, far = pii.find("card 4111 1111 1111 1111")[0], pii.find("thing 4111 1111 1111 1111")[0]
    assert near[3] > far[3]


def test_long_runs_stay_linear():
    assert pii.find("1" * 200_000) == [] and pii.find("a" * 200_000 + "@") == [] and pii.find("+1" * 100_000) is not None


def test_empty(no_docs):
    assert pii.digests(pii.spans(no_docs)).count() == 0
