"""Byte-level BPE against the tokenizer library, and exact round trips."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from marketlens.llm import bpe


@pytest.fixture(scope="module")
def codec():
    with open(bpe.default_vocabulary(), "rb") as f:
        return bpe.Codec(bpe.parse_ranks(f.read()))


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_random_texts(codec, library):
    rnd = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "-", "'s", "日", "x", "\U0001f642", "\x1c", "́", "\xa0", " "]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        ids, spans = codec.encode(t)
        assert ids == library.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()
        assert "".join(t[a:b] for a, b in spans) == t


def test_texts_laid_end_to_end_do_not_see_each_other(codec, library):
    texts = ["don'", "t", " ", " x", "'re", "", "a ", "\n", "b", "'", "ll"]
    got = [x[0] for x in codec.digests(texts)]
    assert got == [len(library.encode_ordinary(t)) for t in texts]


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000 + " x", "日本語" * 300, "x" * 65, " " * 500 + "y", "9" * 400])
def test_long_pieces(codec, library, text):
    assert codec.encode(text)[0] == library.encode_ordinary(text)


def test_slices_merged_together(codec, library, monkeypatch):
    """A block's unseen slices merge together, with the ids of one at a time, whatever
    the cache holds; also where the vocabulary lacks some byte or pair."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéstrn日0") for _ in range(rnd.randint(1, 40))) for _ in range(3000)] + ["x" * 64, "x" * 65]
    pieces = [w.encode() for w in words]
    assert codec.merge_many(pieces) == [codec.merge(p) for p in pieces]
    assert codec.merge_many([]) == []
    small = bpe.Codec({b"a": 0, b"b": 1, b"ab": 2, b"abab": 3, b"ba": 9})
    some = [b"ab" * n + b"a" * k for n in range(6) for k in range(3) if n + k]
    assert small.merge_many(some) == [small.merge(p) for p in some]

    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    monkeypatch.setattr(bpe.Codec, "merge", lambda self, p: 1 / 0 if 1 < len(p) <= bpe.LONG_PIECE and p not in self.ranks else merge(self, p))
    texts = [" ".join(words[k : k + 50]) for k in range(0, 400, 50)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(len(i), sha(" ".join(map(str, i)).encode()), sha(t.encode())) for t, i in ((t, library.encode_ordinary(t)) for t in texts)]
    for _ in range(2):
        assert [x for k in range(0, 8, 2) for x in codec.digests(texts[k : k + 2])] == want


merge = bpe.Codec.merge


def test_scan_equals_one_by_one():
    """The blocked scan over the monoid equals stepping through the rules."""
    import numpy as np

    rnd = random.Random(3)
    for _ in range(200):
        texts = ["".join(rnd.choice("a1! '\nst") for _ in range(rnd.randint(0, 40))) for _ in range(4)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        want, at = [], 0
        symbols = bpe._symbols(points, ends) if len(points) else []
        for t in texts:
            state = bpe.CLOSED
            for k in range(len(t)):
                state, new = bpe._step(state, int(symbols[at + k]))
                if new or k == 0:
                    want.append(at + k)
            at += len(t)
        assert bpe.token_starts(points, ends).tolist() == want


def test_documents(docs, doc_rows, library):
    got = Counter(tuple(r) for r in bpe.encode_digests(docs, bpe.default_vocabulary()).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in doc_rows:
        t = r[1] or ""
        ids = library.encode_ordinary(t)
        want[(r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))] += 1
    assert got == want


def test_empty(no_docs):
    assert bpe.encode_digests(no_docs, bpe.default_vocabulary()).count() == 0
