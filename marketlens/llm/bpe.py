"""Byte-level BPE encoding and decoding (operator 7).

Pre-tokenisation runs without regular expressions.  Every code point maps to a
class, classes and one to three code points of look-ahead give a symbol, and
each symbol is a transition function over six states.  The functions compose
associatively, so a blocked prefix scan over the elements of the monoid that
they generate yields the state at every code point, and with it the token
starts.  The resulting slices go through pair merging by rank, all unseen ones of
a block of texts at a time, behind a cache with a fixed bound.  Offsets of the slices are kept, so a decoded piece can be
traced to its place.

The split agrees with the pattern of the public byte-level vocabularies
(contractions; optional space + letters, digits or others; white space), which
the tests check against the tokenizer library.

Cases: a null text is an empty text (no ids, digest of zero bytes); empty
table, no rows; a very long text or piece is encoded whole (pieces merge in
n log n); equal rows give equal rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marketlens.llm.common import arrow_rows, blocks, prepared, read_table, text_bytes

#: Slices whose merges a task remembers, before those of one more block of texts.
CACHE_PIECES = 200_000
#: Slices that are merged together.
TOGETHER = 1 << 13
#: Pieces of more bytes are merged with a heap.
LONG_PIECE = 64

# Unicode White_Space code points, as the pattern's \s has them.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols: what the scan reads.
LETTER, DIGIT, OTHER, SPACE_IN, SPACE_JOIN, SPACE_LAST, SHORT, LONG, RESET = range(9)
# States: the kind of token that the last code point stands in.
IN_L, IN_N, IN_O, IN_S, JOIN, CLOSED, TAKE_1, TAKE_2 = range(8)

#: state after reading a symbol, and whether a token starts at it
_RULES: dict[int, tuple[int, set[int]]] = {
    # symbol: (state it leads to, states that it continues)
    LETTER: (IN_L, {IN_L, JOIN}),
    DIGIT: (IN_N, {IN_N, JOIN}),
    OTHER: (IN_O, {IN_O, JOIN}),
    SPACE_IN: (IN_S, {IN_S}),
    SPACE_JOIN: (JOIN, set()),
    SPACE_LAST: (CLOSED, set()),
    SHORT: (TAKE_1, set()),
    LONG: (TAKE_2, set()),
    RESET: (CLOSED, set()),
}


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """State after ``symbol`` and whether it starts a token."""
    if symbol == LETTER and state in (TAKE_1, TAKE_2):  # letters of a contraction
        return (CLOSED if state == TAKE_1 else TAKE_1), False
    if symbol in (SHORT, LONG) and state in (IN_O, JOIN):  # the apostrophe belongs to a run
        return IN_O, False
    to, goes_on = _RULES[symbol]
    return to, state not in goes_on


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the symbols' transition functions: the element of
    each symbol, the product table (first, then), each element's state when it
    starts from CLOSED, and the token-start table (state, symbol)."""
    gens = [tuple(_step(s, y)[0] for s in range(8)) for y in range(9)]
    identity = tuple(range(8))
    found, todo = {identity: 0}, [identity]
    while todo:
        f = todo.pop()
        for g in gens:
            if (h := tuple(g[s] for s in f)) not in found:
                found[h] = len(found)
                todo.append(h)
    elems = list(found)
    product = np.array([[found[tuple(g[s] for s in f)] for g in elems] for f in elems], np.uint16)
    state = np.array([f[CLOSED] for f in elems], np.uint8)
    starts = np.array([[_step(s, y)[1] for y in range(9)] for s in range(8)])
    return np.array([found[g] for g in gens], np.uint16), product, state, starts


@cache
def _classes() -> np.ndarray:
    """LETTER, DIGIT, OTHER or SPACE_IN of every code point."""
    kinds = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE_IN
    return out


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The scan's symbols of texts laid end to end; ``ends``: each one's end."""
    kind = _classes()[points]
    last = np.zeros(len(points), bool)
    last[ends[ends > 0] - 1] = True

    def ahead(x: np.ndarray, by: int, none: int) -> np.ndarray:
        out = np.full(len(x), none, x.dtype)
        out[:-by] = x[by:]
        for k in range(1, by + 1):  # nothing beyond a text's end
            out[: len(x) - k + 1][last[k - 1 :]] = none
        return out

    space = kind == SPACE_IN
    to_space = ahead(kind, 1, SPACE_IN) == SPACE_IN  # the end of the text counts as white space here
    out = kind.copy()
    out[space & ~to_space] = SPACE_LAST
    out[(points == 0x20) & ~to_space] = SPACE_JOIN
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        one, two = ahead(points, 1, 0)[quotes], ahead(points, 2, 0)[quotes]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        long = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        out[quotes[long]] = LONG
    return out


def token_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where tokens start in texts laid end to end (code points)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    element, product, state_of, starts = _monoid()
    sym = _symbols(points, ends)
    elem = element[sym]
    first = np.zeros(n, bool)
    first[0] = True
    first[ends[(ends > 0) & (ends < n)]] = True
    elem[first] = product[element[RESET], elem[first]]  # a text doesn't see the one before it
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)  # 0: the identity
    grid[:n] = elem
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for j in range(1, width):  # within blocks, all blocks at once
        grid[j] = product[grid[j - 1], grid[j]]
    carry = np.zeros(rows, np.uint16)
    totals = grid[-1].tolist()
    acc = 0
    for b in range(1, rows):  # over the blocks' products
        acc = int(product[acc, totals[b - 1]])
        carry[b] = acc
    state = state_of[product[carry[None, :], grid]].T.reshape(-1)[:n]
    before = np.empty(n, np.uint8)
    before[0] = CLOSED
    before[1:] = state[:-1]
    before[first] = CLOSED
    return np.flatnonzero(starts[before, sym] | first)


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """token bytes -> rank, of a file with one base64 token and rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.name = {r: str(r) for r in self.token}
        self.width = max(self.token, default=0) + 1
        self.seen: dict[str, tuple[str, bytes]] = {}
        self.pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the pair of lowest rank merges first, the
        leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > LONG_PIECE:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = ranks.get
        none = len(ranks) + 1
        pair = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pair and (low := min(pair)) != none:
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts at i
        left, alive = list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heap.append((r, i, end[j])) if not ready else heapq.heappush(heap, (r, i, end[j]))

        ready = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                left[stop] = i
                offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id of every single byte (-1: none), and the pairs of ids that merge:
        sorted keys (first id * width + second) with the ids that they make."""
        if self.pairs is None:
            ranks, width = self.ranks, self.width
            found = {}
            for t, r in ranks.items():
                for k in range(1, len(t)):
                    if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                        found[a * width + b] = r
            keys = np.fromiter(found, np.int64, len(found))
            order = np.argsort(keys)
            made = np.fromiter(found.values(), np.int64, len(found))[order]
            single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
            # beyond all keys: what no pair finds
            self.pairs = single, np.append(keys[order], np.iinfo(np.int64).max), np.append(made, width)
        return self.pairs

    def _ranks_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """What pairs of ids merge into; ``width`` where they don't."""
        _, keys, made = self._pairs()
        want = first * self.width + second
        at = np.searchsorted(keys, want)
        return np.where(keys[at] == want, made[at], self.width)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """``merge`` of many slices: those of one length advance together, by one
        pair each at a time."""
        out: list[list[int] | None] = [None] * len(pieces)
        single, none = self._pairs()[0], self.width
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > LONG_PIECE or p in self.ranks or len(p) < 2:
                out[i] = self.merge(p)
            else:
                by_length.setdefault(len(p), []).append(i)
        for length, at in by_length.items():
            for k in range(0, len(at), TOGETHER):
                own = np.array(at[k : k + TOGETHER])
                ids = single[np.frombuffer(b"".join([pieces[i] for i in own]), np.uint8)].reshape(len(own), length)
                if (ids < 0).any():  # a vocabulary without some byte
                    for i in own:
                        out[i] = self.merge(pieces[i])
                    continue
                pair = self._ranks_of(ids[:, :-1], ids[:, 1:])
                while len(own):
                    low = pair.argmin(axis=1)  # the leftmost of equals
                    made = pair[np.arange(len(own)), low]
                    on = made < none
                    if not on.all():
                        for i, got in zip(own[~on].tolist(), ids[~on].tolist()):
                            out[i] = got
                        own, ids, pair, low, made = own[on], ids[on], pair[on], low[on], made[on]
                    if not len(own):
                        break
                    n, m, row = len(own), ids.shape[1] - 1, np.arange(len(own))
                    ids[row, low] = made
                    left = np.ones((n, m + 1), bool)
                    left[row, low + 1] = False
                    ids = ids[left].reshape(n, m)
                    if m == 1:
                        for i, got in zip(own.tolist(), ids.tolist()):
                            out[i] = got
                        break
                    left = np.ones((n, m), bool)
                    left[row, low] = False
                    pair = pair[left].reshape(n, m - 1)
                    some = np.flatnonzero(low < m - 1)
                    pair[some, low[some]] = self._ranks_of(ids[some, low[some]], ids[some, low[some] + 1])
                    some = np.flatnonzero(low)
                    pair[some, low[some] - 1] = self._ranks_of(ids[some, low[some] - 1], ids[some, low[some]])
        return out

    def learn(self, pieces: list[str]) -> None:
        """Remember each slice's ids as decimal text, and the bytes that the ids
        decode to."""
        name = self.name
        for p, ids in zip(pieces, self.merge_many([p.encode() for p in pieces])):
            self.seen[p] = " ".join([name[i] for i in ids]), self.decode(ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def slices(self, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """For each text its pieces and their offsets in code points."""
        big = "".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer(big.encode("utf-32-le"), np.uint32)
        starts = token_starts(points, ends)
        cut = np.searchsorted(starts, np.concatenate(([0], ends)))
        at = starts.tolist()
        at.append(len(big))
        for k, end in enumerate(ends.tolist()):
            own = at[cut[k] : cut[k + 1]]
            stops = own[1:]
            stops.append(end)
            begin = end - len(texts[k])
            yield ([big[a:b] for a, b in zip(own, stops)] if own else []), [a - begin for a in own]

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids of a text, and each slice's (start, end) in code points."""
        ((pieces, at),) = self.slices([text])
        return [i for p in pieces for i in self.merge(p.encode())], list(zip(at, [*at[1:], len(text)]))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: tokens, digest of its ids, digest of what they
        decode to."""
        seen = self.seen
        if len(seen) >= CACHE_PIECES:
            seen.clear()
        cut = [pieces for pieces, _ in self.slices(texts)]
        self.learn([p for p in set().union(*cut) if p not in seen])
        for pieces in cut:
            got = [seen[p] for p in pieces]
            ids = " ".join([g[0] for g in got])
            whole = b"".join([g[1] for g in got])
            yield (ids.count(" ") + 1 if ids else 0), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(whole).hexdigest()


_CODECS: dict[str, Codec] = {}


def _codec(raw: bytes) -> Codec:
    """One codec a worker and vocabulary, parsed once."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(parse_ranks(raw))
    return _CODECS[key]


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256,
    decoded_sha256.  ``vocabulary``: path of the rank file on the driver; its
    bytes (a fixed vocabulary of about a megabyte) are broadcast."""
    spark = prepared(docs)
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = _codec(raw.value)
        for b in arrow_rows(batches):
            _, off = text_bytes(b.column(1))
            for lo, hi in blocks(off):
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                n, ids, back = zip(*codec.digests(texts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.seen.clear()  # the worker lives on beside others

    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"), default_vocabulary())
