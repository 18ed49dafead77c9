"""Word and shingle hashes of whole texts, computed on Arrow buffers.

Words are the maximal runs outside white space (space, tab to carriage
return) of the text with A-Z lower-cased.  A word's hash is a polynomial over
its bytes modulo 2^64, from prefix sums, so a block costs a few numpy passes.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse
#: Bytes whose powers are held at a time.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte codes with A-Z lowered, and which bytes are white space."""
    code = mix(np.arange(1, 257, dtype=np.uint64) * _R)
    code[65:91] = code[97:123]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x9, 0xE)]] = True
    return code, space


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    r_inv = _U(pow(int(_R), -1, 1 << 64))

    def powers(base):
        out = np.full(PIECE + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    with np.errstate(over="ignore"):
        return powers(_R), powers(r_inv)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end (bytes) of every word of texts laid end to end, and
    the first word of each text (n + 1 positions)."""
    code, space = _tables()
    white = space[buf]
    inside = np.ones(len(buf) + 2, bool)
    inside[1:-1] = white
    inside = ~inside
    edge = offsets[1:-1]
    starts = inside[1:-1] & ~inside[:-2]
    if len(edge):  # a word ends with its text
        e = edge[edge < len(buf)]
        starts[e] = inside[1:-1][e]
    begin = np.flatnonzero(starts)
    stop = np.append(begin[1:], len(buf))
    gaps = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1  # ends before white space
    k = np.searchsorted(gaps, begin, side="right")
    own = np.where(k < len(gaps), gaps[np.minimum(k, len(gaps) - 1)] if len(gaps) else len(buf), len(buf))
    stop = np.minimum(stop, own)
    if len(offsets) > 1:
        stop = np.minimum(stop, offsets[np.searchsorted(offsets, begin, side="right")])
    first = np.searchsorted(begin, offsets)
    return _hash(buf, begin, stop, code), begin, stop, first


def _hash(buf: np.ndarray, begin: np.ndarray, stop: np.ndarray, code: np.ndarray) -> np.ndarray:
    power, inverse = _powers()
    out = np.empty(len(begin), np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(begin):
            hi = max(lo + 1, int(np.searchsorted(stop, begin[lo] + PIECE, side="right")))
            a, b = int(begin[lo]), int(stop[hi - 1])
            if b - a > PIECE:  # one word longer than the table
                out[lo] = _long(buf[a:b], code)
            else:
                sums = np.zeros(b - a + 1, np.uint64)
                np.cumsum(code[buf[a:b]] * power[: b - a], out=sums[1:])
                s, e = begin[lo:hi] - a, stop[lo:hi] - a
                out[lo:hi] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            lo = hi
    return out


def _long(word: np.ndarray, code: np.ndarray) -> np.uint64:
    """The same polynomial in pieces."""
    power, _ = _powers()
    total, scale = 0, 1
    for k in range(0, len(word), PIECE):
        part = word[k : k + PIECE]
        total += scale * int(np.sum(code[part] * power[: len(part)], dtype=np.uint64))
        scale = scale * int(power[len(part)]) % (1 << 64)
    return mix(np.array([(total + len(word)) % (1 << 64)], np.uint64))[0]


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each text, ascending within it, and
    each text's offset into them.  A text of fewer words has its whole
    sequence as one; without words, none."""
    h, _, _, first = words(buf, offsets)
    n = np.diff(first)
    short = (n > 0) & (n < width)
    with np.errstate(over="ignore"):
        total = max(0, len(h) - width + 1)
        s = np.zeros(total, np.uint64)
        for k in range(width):
            s = mix(s * _R + h[k : k + total]) if k else mix(h[:total] + _U(width))
        valid = np.zeros(len(h), bool)
        doc = np.repeat(np.arange(len(n)), n)
        left = first[1:][doc] - np.arange(len(h))
        valid[left >= width] = True
        keep = np.flatnonzero(valid)
        s, doc = s[keep], doc[keep]
        if short.any():
            more_s, more_d = [], np.flatnonzero(short)
            for d in more_d:
                acc = _U(n[d])
                for x in h[first[d] : first[d + 1]]:
                    acc = mix(np.array([acc * _R + x]))[0]
                more_s.append(acc)
            s, doc = np.concatenate((s, np.array(more_s, np.uint64))), np.concatenate((doc, more_d))
    order = np.lexsort((s, doc)) if len(s) else np.zeros(0, np.int64)
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(n) + 1))
