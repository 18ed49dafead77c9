"""Personal data in texts (operator 3).

Regular expressions propose spans, validators confirm them (Luhn for cards,
part range for IP addresses, mod 97 for IBANs, digit counts for phones), and
context words near a span adjust its score.  A base span that its validator
confirms is always reported; the score grades it.  The method adds IBANs, and
national identity numbers (ddd-dd-dddd) where a context word lifts them over
the threshold.

Patterns are scanned only around what they need ('@', '+', a digit), with the
leftmost non-overlapping matches of a scan over the whole text.  Work is linear
in the text.

Cases: a null text is an empty text without spans; empty table, no rows; very
long texts are scanned whole; repeated rows give repeated results; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marketlens.llm.common import arrow_rows, blocks, prepared, read_table, text_bytes

KINDS = ("email", "ip", "card", "phone", "iban", "natid")
BASE = KINDS[:4]

#: Score of a confirmed span before its context, and what a context word adds.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "natid": 0.3}
BOOST = 0.25
#: Added kinds are reported from this score on.
THRESHOLD = 0.5
#: Code points before and after a span in which context words count.
WINDOW = 48

# Words that speak for a kind, in any case.
CONTEXT = {
    "email": "email mail e-mail contact courriel correo kontakt",
    "ip": "ip address host server adresse",
    "card": "card credit visa mastercard amex payment karte carte tarjeta",
    "phone": "phone tel telephone call mobile fax telefon téléphone teléfono",
    "iban": "iban bank account konto compte cuenta",
    "natid": "ssn social security identity passport ausweis",
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# A later start in a run of digits matches only if the run's first digit does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CONTEXT = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v.split())) + r")(?!\w)", re.I) for k, v in CONTEXT.items()}

Span = tuple[int, int, str, float]


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        # what an earlier '@' has scanned in vain can't start a match here: it ends before that '@'
        done = m.end() if m else at + 1
        if m:
            yield begin, done
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield m.span()


def _natids(text: str) -> Iterator[tuple[int, int]]:
    for m in _NATID.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


#: kind -> (characters of which one must occur, proposer and validator)
_FIND = {"email": ("@", _emails), "ip": (".", _ips), "card": ("", _cards), "phone": ("+", _phones), "iban": ("", _ibans), "natid": ("-", _natids)}
_DIGIT = re.compile(r"[0-9]")


def find(text: str) -> list[Span]:
    """All spans: (start, end, kind, score) in code points, end exclusive, by
    start and then kind as listed."""
    out: list[Span] = []
    digits = _DIGIT.search(text) is not None
    for kind, (needs, spans) in _FIND.items():
        if (needs and needs not in text) or (kind != "email" and not digits):
            continue
        for a, b in spans(text):
            around = text[max(0, a - WINDOW) : a] + "\n" + text[b : b + WINDOW]
            score = PRIOR[kind] + (BOOST if _CONTEXT[kind].search(around) else 0)
            if kind in BASE or score >= THRESHOLD:
                out.append((a, b, kind, min(1.0, score)))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and its spans, an array of (kind,
    start, end, score, text)."""
    prepared(docs)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches):
        for b in arrow_rows(batches):
            _, off = text_bytes(b.column(1))
            for lo, hi in blocks(off):
                found = []
                for t in b.column(1).slice(lo, hi - lo).to_pylist():
                    found.append([{"kind": k, "start": s, "end": e, "score": round(p, 4), "text": t[s:e]} for s, e, k, p in find(t or "")])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(found, item)], ["doc_id", "spans"])

    return src.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double,text:string>>")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``spans``' rows."""
    text = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = f"filter(spans, s -> s.kind in ({', '.join(repr(k) for k in BASE)}))"
    return found.selectExpr(
        "doc_id",
        *(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) as n_{k}" for k in BASE),
        f"sha2({text.format(base)}, 256) as base_sha256",
        f"{text.format('spans')} as spans",
        "array_join(transform(spans, s -> cast(s.score as string)), ',') as scores",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spans(read_table(spark, sf_dir, "documents")))
