"""Language-model scores from a hierarchical Pitman-Yor model (operator 8).

Tokens are words (A-Z lower-cased) and one end per document; a token's context
is the token before it, a document's first token has the end as context.  The
model nests restaurants: one for each context, whose new tables draw the word
from a word restaurant that all contexts share; its new tables draw from a
spelling model of byte restaurants, one for each context of two bytes; contexts
that end in the same byte share the parent restaurant of that byte, and those
share the root over a uniform byte.

* Texts are read once, into units of some UNIT bytes: tokens as places among the
  unit's words.  Word pairs are counted in buckets by their hash, so a hot context
  is spread over all of them and a hot pair is one entry a unit.  Pairs that occur
  once have one table; a context's tables and a word's customers follow from the
  other pairs' excess of customers over tables.
* Seating is sampled by Gibbs sweeps.  The first sweeps of the word restaurant
  take one table for each dish of a context; then all contexts are seated anew
  for each sweep that is kept, given the words' probabilities so far.  A sweep
  seats the customers of every word anew, given the other tables' number and the
  spelling model of the sweep before; the words' tables are the byte customers,
  which are seated by context, then by their parents.  Seatings of different
  words are independent given those totals, so a sweep is one pass over the word
  table.
* Frequent words are seated in blocks: tables that open while the customers grow
  by a quarter are drawn as one Poisson number.  Draws are hashes of (word,
  sweep, step), so a lost task repeats its own.
* Predictive probabilities of the last KEPT sweeps are averaged, each level's
  over the mean of its parent's, so they sum to one in every context.  The events
  are the training tokens' types and one unknown type, as in the add-one base: an
  unknown word has the probability of any new word, i.e. what the spelling model
  leaves beside the known ones; an unknown context has no customers and passes
  on the word restaurant's.  A text's score is the sum of its tokens' log10
  probabilities; perplexity follows.
* A token whose pair was not seen has probability back(context) * p(word), so the
  two are summed by word; a seen pair adds its gain over that.  A bucket answers
  each unit with its pairs' customers, in the order of their hashes; the unit has
  the words' values and adds up its documents.

Counts cover all training documents.  Only byte counts (at most 256^3 cells) and
the HEAD most frequent words' values meet on the driver; other words' meet the
units and buckets that hold them in joins.

Cases: a null or empty text is one end token; a null doc_id counts as training;
repeated rows train as often as they occur and get equal scores; nothing to
learn from: uniform spelling; very long texts are scored whole; empty table: no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import arrow_rows, blocks, discard, materialise, prepared, read_table, text_bytes
from marketlens.llm.shingles import mix, words

BURN_IN, KEPT = 2, 3
#: Strength of every restaurant; discounts are estimated, within these bounds.
STRENGTH = 1.0
DISCOUNT = (0.05, 0.95)
#: Words whose scores are broadcast, about.
HEAD = 1 << 19
#: Bytes of text whose tokens one row holds; a longer text has its own row.
UNIT = 8 << 20
#: Customers that are seated one by one.
SINGLY = 24
#: Entries of a bucket of words, and of one of pairs, in expectation.
WORD_BUCKET, BUCKET = 1 << 19, 1 << 21

_U = np.uint64
_EDGE = 0x20  # a byte that no word holds: before a word, and after it
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Columns of ``_units``.
_UNIT = "unit long, tokens long, size int, word binary, letters binary, spelled binary, c binary, n binary, seq binary"
#: The end token: a word without bytes.
END = 0


def _draw(ids: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on the arguments only."""
    with np.errstate(over="ignore"):
        x = mix(ids + _U(((sweep << 20) + step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return ((x >> _U(11)).astype(float) + 0.5) * 2.0**-53


def _poisson(mean: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion; a normal number from means of 30 on."""
    out = np.maximum(0, np.rint(mean + np.sqrt(mean) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)))
    small = np.flatnonzero(mean < 30)
    m, left = mean[small], u[small]
    term = np.exp(-m)
    total, k = term.copy(), np.zeros(len(small))
    for step in range(1, 120):
        more = left > total
        if not more.any():
            break
        k[more] = step
        term = term * m / step
        total = total + term
    out[small] = k
    return out


def seat(c: np.ndarray, base: np.ndarray, total: np.ndarray | float, d: np.ndarray | float, ids: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish: ``c`` customers sit down one after another at its
    tables or open one, with weight (STRENGTH + d * total) * base."""
    a = (STRENGTH + d * total) * base
    d = np.broadcast_to(np.asarray(d, float), c.shape)
    t = (c > 0).astype(float)
    at = np.flatnonzero(c > 1)
    for i in range(1, SINGLY):
        at = at[c[at] > i]
        if not len(at):
            return t
        t[at] += _draw(ids[at], sweep, i) * (i - d[at] * t[at] + a[at]) < a[at]
    at = at[c[at] > SINGLY]
    i = np.full(len(at), float(SINGLY))
    step = SINGLY
    while len(at):
        j = np.minimum(c[at], np.ceil(i * 1.25))
        free = np.maximum(i - d[at] * t[at], 1e-9)
        mean = a[at] * np.log((free + j - i + a[at]) / (free + a[at]))
        new = _poisson(mean, _draw(ids[at], sweep, 2 * step), _draw(ids[at], sweep, 2 * step + 1))
        t[at] += np.minimum(new, j - i)
        step += 1
        more = j < c[at]
        at, i = at[more], j[more]
    return t


def discount(counts: np.ndarray) -> float:
    """Estimate from how many dishes have one and two customers."""
    one, two = float((counts == 1).sum()), float((counts == 2).sum())
    return float(np.clip(one / (one + 2 * two) if one else 0, *DISCOUNT))


class Spelling:
    """Byte restaurants; ``alphabet``: the bytes that occur, the edge among
    them.  Probabilities of the bytes outside share the root's uniform part."""

    def __init__(self, alphabet: np.ndarray):
        self.code = np.full(256, len(alphabet), np.int64)  # others have one code, and its probability is a byte's
        self.code[alphabet] = np.arange(len(alphabet))
        self.size = len(alphabet) + 1
        n = self.size
        self.p0 = np.full(n, 1 / 256)
        self.p1 = np.tile(self.p0, (n, 1))
        self.p2 = np.tile(self.p0, (n, n, 1))
        self.log = np.log(self.p2).ravel()

    def __getstate__(self):
        """Tasks spell by logarithms."""
        return {"code": self.code, "size": self.size, "log": self.log}

    @staticmethod
    def _predict(c: np.ndarray, t: np.ndarray, d: float, parent: np.ndarray) -> np.ndarray:
        total = c.sum(axis=-1, keepdims=True)
        return (np.maximum(c - d * t, 0) + (STRENGTH + d * t.sum(axis=-1, keepdims=True)) * parent) / (STRENGTH + total)

    def learn(self, c2: np.ndarray, sweep: int) -> None:
        """One sweep over all byte restaurants: customers ``c2`` by context."""
        n = self.size
        ids = np.arange(n**3, dtype=np.uint64)
        d2 = discount(c2)
        at = np.flatnonzero(c2.ravel() > 0)
        # tables of a restaurant so far: its dishes, for lack of a former seating
        dishes = np.broadcast_to((c2 > 0).sum(axis=-1, keepdims=True), c2.shape).ravel()
        t2 = np.zeros(n**3)
        t2[at] = seat(c2.ravel()[at], np.broadcast_to(self.p1[None], c2.shape).ravel()[at], dishes[at], d2, ids[at], sweep)
        t2 = t2.reshape(c2.shape)
        c1 = t2.sum(axis=0)
        d1 = discount(c1)
        t1 = seat(c1.ravel(), np.broadcast_to(self.p0, c1.shape).ravel(), np.broadcast_to((c1 > 0).sum(axis=-1, keepdims=True), c1.shape).ravel(), d1, ids[: n * n] + _U(n**3), sweep).reshape(c1.shape)
        c0 = t1.sum(axis=0)
        d0 = discount(c0)
        t0 = seat(c0, np.full(n, 1 / 256), (c0 > 0).sum(), d0, ids[:n] + _U(n**3 + n**2), sweep)
        self.p0 = self._predict(c0, t0, d0, np.full(n, 1 / 256))
        self.p1 = self._predict(c1, t1, d1, self.p0[None, :])
        self.p2 = self._predict(c2, t2, d2, self.p1[None, :, :])
        self.log = np.log(self.p2).ravel()

    def cells(self, letters: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of words (binary): the cell of each spelled byte, edge included,
        and where each word's cells start."""
        buf, off = text_bytes(letters)
        n = len(off) - 1
        end = off[1:] + np.arange(1, n + 1)  # each word and its edge
        edge = self.code[_EDGE]
        seq = np.full(len(buf) + n, edge)
        inner = np.ones(len(seq), bool)
        inner[end - 1] = False
        seq[inner] = self.code[buf]
        start = end - np.diff(off) - 1
        one, two = np.roll(seq, 1), np.roll(seq, 2)
        one[start], two[start] = edge, edge
        second = start[np.diff(off) > 0] + 1
        two[second] = edge
        return (two * self.size + one) * self.size + seq, start

    def base(self, cell: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Probability of each word, by its cells."""
        if not len(start):
            return np.zeros(0)
        return np.exp(np.maximum(np.add.reduceat(self.log[cell], start), -700.0))


class Sweep:
    """What a kept sweep needs to predict: tables in all, and its spelling."""

    def __init__(self, number: int, before: Spelling, total_before: float):
        self.number, self.before, self.total_before = number, before, total_before
        self.after: Spelling | None = None
        self.total, self.customers = 0.0, 0.0
        self.known = 0.0  # probability of the known words in the spelling model

    def tables(self, ids: np.ndarray, c: np.ndarray, cells: tuple[np.ndarray, np.ndarray], d: float) -> np.ndarray:
        return seat(c, self.before.base(*cells), self.total_before, d, ids, self.number)


def _training(doc_id: Column, by: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by != fold, F.lit(True))


def _units(docs: DataFrame) -> DataFrame:
    """The texts' tokens, some UNIT bytes of text a row: the documents' doc_id and
    train, the tokens as places among the row's distinct words (``seq``; the end
    token closes a document), and of these the hashes, ascending, the letters with
    their lengths (``spelled``), c (training occurrences) and n (all).  Texts are
    read here only."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for b in arrow_rows(batches):
            buf, off = text_bytes(b.column(2))
            train = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in blocks(off, UNIT):
                text = buf[off[lo] : off[hi]]
                h, start, stop, first = words(text, off[lo : hi + 1] - off[lo])
                row, _, token = _sequence(h, first)
                u, seq = _numbered(token.view(np.uint64))
                at = np.zeros(len(u), np.int64)  # a token of each word
                at[seq] = np.arange(len(seq))
                at -= row[at]  # without the end tokens before it, its place among the words
                spelled = np.where(u == _U(END), 0, (stop - start)[np.minimum(at, len(h) - 1)] if len(h) else 0)
                begin = np.where(spelled > 0, start[np.minimum(at, len(h) - 1)] if len(h) else 0, 0)
                letters = _LOWER[text[np.repeat(begin - np.append(0, np.cumsum(spelled)[:-1]), spelled) + np.arange(spelled.sum())]]
                counts = np.bincount(seq, train[lo:hi][row], len(u)).astype(np.int64), np.bincount(seq, minlength=len(u))
                data = [_packed(u), pa.compress(letters.tobytes(), "zstd", asbytes=True), _packed(spelled), *map(_packed, counts), _packed(seq.astype(np.int32))]
                heads = [pa.array([(part << 40) + made], pa.int64()), pa.array([len(seq)], pa.int64()), pa.array([len(u)], pa.int32())]
                made += 1
                ends = pa.array([0, hi - lo], pa.int32())
                yield pa.RecordBatch.from_arrays([*heads, *[pa.array([x], pa.binary()) for x in data], *[pa.ListArray.from_arrays(ends, c.slice(lo, hi - lo)) for c in b.columns[:2]]], [*[x.split()[0] for x in _UNIT.split(", ")], "doc_id", "train"])

    return materialise(docs.select("doc_id", "train", "text").mapInArrow(run, f"{_UNIT}, doc_id array<{kind}>, train array<boolean>"), "pitmanyor-units")


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and each one's place among them."""
    o = np.argsort(x)
    y = x[o]
    new = np.append(True, y[1:] != y[:-1]) if len(y) else np.zeros(0, bool)
    place = np.empty(len(x), np.int64)
    place[o] = np.cumsum(new) - 1
    return y[new], place


def _slices(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Bucket, start and end of ascending hashes' runs by bucket."""
    bucket = (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
    cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(h))
    return [(int(bucket[i]), int(i), int(j)) for i, j in zip(cut[:-1], cut[1:])]


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket in one task."""
    return df.repartition(buckets, "bucket")


def _rows(batches) -> Iterator[dict]:
    for b in arrow_rows(batches):
        for i in range(b.num_rows):
            yield {k: b.column(j)[i].as_py() for j, k in enumerate(b.schema.names)}


def _word_table(docs: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """word (64-bit hash), letters, c (training occurrences), n (all).  The end
    token has hash END and no letters."""
    units = units or _units(docs)
    buckets = max(1, -(-int(units.agg(F.sum("size")).first()[0] or 0) // WORD_BUCKET))
    names = ["bucket", "size", "word", "letters", "spelled", "c", "n"]

    def deal(batches):
        for r in _rows(batches):
            u = _unpacked(r["word"], r["size"], np.uint64)
            spelled, c, n = (_unpacked(r[k], r["size"], np.int64) for k in ("spelled", "c", "n"))
            ends = np.append(0, np.cumsum(spelled))
            letters = pa.decompress(r["letters"], int(ends[-1]), "zstd", asbytes=True)
            runs = _slices(u, buckets)
            data = [[_packed(x[i:j]) for _, i, j in runs] for x in (u, spelled, c, n)]
            data.insert(1, [letters[ends[i] : ends[j]] for _, i, j in runs])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in runs], pa.int32()), pa.array([j - i for _, i, j in runs], pa.int32()), *[pa.array(x, pa.binary()) for x in data]], names)

    def merge(batches):
        parts: dict[int, list] = {}
        for r in _rows(batches):
            numbers = [_unpacked(r[k], r["size"], np.int64) for k in ("word", "spelled", "c", "n")]
            off = pa.array(np.append(0, np.cumsum(numbers[1])).astype(np.int32)).buffers()[1]
            letters = pa.Array.from_buffers(pa.binary(), r["size"], [None, off, pa.py_buffer(r["letters"])])
            parts.setdefault(r["bucket"], []).append((numbers[0], letters, *numbers[2:]))
        for k in list(parts):
            h, letters, c, n = zip(*parts.pop(k))
            u, place = _numbered(np.concatenate(h))
            at = np.zeros(len(u), np.int64)
            at[place] = np.arange(len(place))
            c, n = (np.bincount(place, np.concatenate(x), len(u)).astype(np.int64) for x in (c, n))
            whole = pa.Table.from_arrays([pa.array(u), pa.concat_arrays(letters).take(pa.array(at)), pa.array(c), pa.array(n)], ["word", "letters", "c", "n"])
            yield from whole.to_batches(100_000)

    parts = units.select("size", "word", "letters", "spelled", "c", "n").mapInArrow(deal, "bucket int, size int, word binary, letters binary, spelled binary, c binary, n binary")
    return materialise(_dealt(parts, buckets).mapInArrow(merge, "word long, letters binary, c long, n long"), "pitmanyor-words")


_R = _U(0x9E3779B97F4A7C15)


def _pair(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits of a pair of word hashes."""
    with np.errstate(over="ignore"):
        return mix(mix(prev.view(np.uint64) + _R) * _R + word.view(np.uint64))


def _grid(x: np.ndarray) -> np.ndarray:
    """Multiples of 2^-32: sums of a text's scores are exact in any order."""
    return np.rint(x * 2.0**32) * 2.0**-32


def _sequence(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, context and hash of every token, end tokens among them, in order."""
    n = len(first) - 1
    word = np.full(len(h) + n, END, np.int64)
    inner = np.ones(len(word), bool)
    inner[first[1:] + np.arange(n)] = False
    word[inner] = h.view(np.int64)
    return np.repeat(np.arange(n), np.diff(first) + 1), np.roll(word, 1), word


def _place(names: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of ``h`` in the ascending ``names``; -1: not there."""
    if not len(names):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
    return np.where(names[at] == h, at, -1)


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the high ones (mostly zero) together."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True)


def _unpacked(x: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(x, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


def _most(table: DataFrame, key: str) -> Column:
    """A condition that holds for the HEAD rows of greatest ``n``, about: whole
    classes of n (eight to a doubling), and of the last one a share by hash."""
    kind = F.floor(F.log2("n") * 8).cast("int")
    left = HEAD
    for r in table.groupBy(kind.alias("kind")).count().orderBy(F.desc("kind")).collect():  # 512 rows at most
        if r["count"] > left:
            share = int(left / r["count"] * (1 << 30))
            return (kind > r["kind"]) | ((kind == r["kind"]) & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share))
        left -= r["count"]
    return F.lit(True)


def _head(table: DataFrame) -> np.ndarray:
    """Hashes of the HEAD most frequent words, ascending."""
    return np.sort(table.where(_most(table, "word")).select("word").toArrow()["word"].to_numpy())


def _coded(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hashes, a frequent word's as its place from 1 on."""
    at = _place(names, x)
    return np.where(at >= 0, at + 1, x)


def _decoded(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    frequent = (x >= 1) & (x <= len(names))
    return np.where(frequent, names[np.where(frequent, x - 1, 0)], x) if len(names) else x


def _unit_pairs(u: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A unit's distinct pairs by ascending hash: hash, places of context and word
    among the unit's words ``u``; and each token's place among the pairs.  A first
    token's context is the end token, which closes the unit as well."""
    n, size = len(seq), len(u)
    key = np.roll(seq, 1).astype(np.uint64) * _U(size) + seq.astype(np.uint64)
    if size * size * n < 1 << 63:  # the place beside the key: numbers sort faster than places by key
        key = np.sort(key * _U(n) + np.arange(n, dtype=np.uint64))
        key, o = np.divmod(key, _U(n))
        o = o.astype(np.int64)
    else:
        o = np.argsort(key)
        key = key[o]
    new = np.append(True, key[1:] != key[:-1])
    prev, word = (x.astype(np.int64) for x in np.divmod(key[new], _U(size)))
    pair = _pair(u[prev], u[word])
    by = np.argsort(pair)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    place = np.empty(n, np.int64)
    place[o] = rank[np.cumsum(new) - 1]
    return pair[by], prev[by], word[by], place


#: Columns of a bucket of pairs.
_PAIRS = "bucket int, size int, two long, more long, prev binary, word binary, c binary, units array<long>, sizes array<int>, at binary"


def _pair_table(docs: DataFrame, names: np.ndarray, tokens: int, units: DataFrame | None = None) -> DataFrame:
    """A row for each bucket of pairs, by their hash: prev, word and c (training
    occurrences) of the ``size`` pairs that occur more than once in the training
    texts, how many occur twice, their occurrences; and for the pairs of each unit
    in the bucket, by ascending hash, 0 (not in the training texts), 1 (once), or 2
    and the place of a pair of the row."""
    units = units or _units(docs)
    cast = units.sparkSession.sparkContext.broadcast(names)
    buckets = max(1, -(-tokens // BUCKET))

    def count(batches):
        for r in _rows(batches):
            u, seq = _unpacked(r["word"], r["size"], np.uint64), _unpacked(r["seq"], r["tokens"], np.int32)
            pair, prev, word, place = _unit_pairs(u, seq)
            own = np.repeat(np.array(r["train"], np.int64), np.diff(np.append(-1, np.flatnonzero(u[seq] == _U(END)))))
            c = np.bincount(place, own, len(pair)).astype(np.int64)
            codes = _coded(cast.value, u.view(np.int64))
            prev, word = codes[prev], codes[word]
            runs = _slices(pair, buckets)
            for k in range(0, len(runs), 64):
                some = runs[k : k + 64]
                data = [[_packed(x[i:j]) for _, i, j in some] for x in (prev, word, c)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([r["unit"]] * len(some), pa.int64()), pa.array([j - i for _, i, j in some], pa.int32()), *[pa.array(x, pa.binary()) for x in data]], ["bucket", "unit", "size", "prev", "word", "c"])

    def merge(batches):
        parts: dict[int, list] = {}
        for r in _rows(batches):
            parts.setdefault(r["bucket"], []).append((r["unit"], r["size"], *[r[k] for k in ("prev", "word", "c")]))
        for k in list(parts):
            held = parts.pop(k)
            prev, word, c = (np.concatenate([_unpacked(x[i], x[1], np.int64) for x in held]) for i in (2, 3, 4))
            pair = _pair(_decoded(cast.value, prev), _decoded(cast.value, word))
            o = np.argsort(pair)
            pair = pair[o]
            new = np.append(True, pair[1:] != pair[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(c[o], first)
            many = np.flatnonzero(total > 1)
            code = total.copy()
            code[many] = np.arange(2, len(many) + 2)
            at = np.empty(len(pair), np.int32)
            at[o] = code[np.cumsum(new) - 1]
            of, total = o[first[many]], total[many]
            heads = [pa.array([k], pa.int32()), pa.array([len(many)], pa.int32()), *[pa.array([int(x)], pa.int64()) for x in ((total == 2).sum(), total.sum())]]
            data = [_packed(x) for x in (prev[of], word[of], total)]
            yield pa.RecordBatch.from_arrays([*heads, *[pa.array([x], pa.binary()) for x in data], pa.array([[x[0] for x in held]], pa.list_(pa.int64())), pa.array([[x[1] for x in held]], pa.list_(pa.int32())), pa.array([_packed(at)], pa.binary())], [x.split()[0] for x in _PAIRS.split(", ")])

    parts = units.select("unit", "tokens", "size", "word", "seq", "train").mapInArrow(count, "bucket int, unit long, size int, prev binary, word binary, c binary")
    found = materialise(_dealt(parts, buckets).mapInArrow(merge, _PAIRS), "pitmanyor-pairs")
    cast.destroy()
    return found


def _known_pairs(names: np.ndarray, r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and c of a bucket's pairs."""
    prev, word, c = (_unpacked(r[k], r["size"], np.int64) for k in ("prev", "word", "c"))
    return _decoded(names, prev), _decoded(names, word), c


def _frequent_values(values: DataFrame, names: np.ndarray, columns: list[str]) -> dict[str, np.ndarray]:
    """The frequent words' columns (doubles) of ``values``, as many as there are names."""
    frequent = values.sparkSession.sparkContext.broadcast(names)

    def among(batches):
        for b in arrow_rows(batches):
            yield b.filter(pa.array(_place(frequent.value, b.column(0).to_numpy()) >= 0))

    head = values.select("word", *columns).mapInArrow(among, "word long, " + ", ".join(f"{k} double" for k in columns)).toArrow().sort_by("word")
    frequent.destroy()
    return {k: head[k].to_numpy() for k in ["word", *columns]}


def _looked_up(x: np.ndarray, frequent: dict[str, np.ndarray], others: pa.Table, columns: list[str]) -> list[np.ndarray]:
    """The words' columns, from the frequent words' or from the ``others``' rows."""
    at = _place(frequent["word"], x)
    left = np.flatnonzero(at < 0)
    out = [frequent[c][at] if len(frequent["word"]) else np.zeros(len(x)) for c in columns]
    if len(left):
        others = others.sort_by("word")
        place = np.searchsorted(others["word"].to_numpy(), x[left])
        for v, c in zip(out, columns):
            v[left] = others[c].to_numpy()[place]
    return out


class Model:
    """Totals, discounts and the kept sweeps; its size is that of the byte
    tables.  ``pairs``: the pair table with its excess customers in each."""

    def __init__(self, tokens: int, types: int, d: float, sweeps: list[Sweep], d2: float = 0.0, known: DataFrame | None = None, pairs: DataFrame | None = None):
        self.tokens, self.types, self.d, self.sweeps = tokens, types, d, sweeps
        self.d2, self.known, self.pairs = d2, known, pairs

    def __getstate__(self):
        return self.__dict__ | {"known": None, "pairs": None}

    def pairs_only(self) -> Model:
        """What pairs' gains and the add-one base need."""
        return Model(self.tokens, self.types, self.d, [], self.d2)

    def scores(self, ids: np.ndarray, c: np.ndarray, letters: pa.Array, customers: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word: add-one base, and the word
        restaurant's with its customers in each kept sweep (``c``, if it has no
        contexts above)."""
        base = np.log10((c + 1) / (self.tokens + self.types + 1))
        p, new = np.zeros(len(c)), 0.0
        cells = self.sweeps[0].after.cells(letters) if self.sweeps else None  # all sweeps have one alphabet
        for s, n in zip(self.sweeps, customers or [c] * len(self.sweeps)):
            t = s.tables(ids, n, cells, self.d)
            p += (np.maximum(n - self.d * t, 0) + (STRENGTH + self.d * s.total) * s.after.base(*cells)) / (STRENGTH + s.customers)
            new += (STRENGTH + self.d * s.total) * max(0.0, 1 - s.known) / (STRENGTH + s.customers)
        p = np.where(c > 0, p, new)
        return base, np.log10(np.maximum(p / len(self.sweeps), 1e-300))

    def back(self, c: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """log10 of what contexts with ``c`` customers pass on."""
        return np.log10((STRENGTH + self.d2 * sum(tables) / max(1, len(tables))) / (STRENGTH + c))

    def gain(self, c, tables, context, back, lm) -> np.ndarray:
        """log10 of a seen pair's probability over that of an unseen one."""
        return _grid(np.log10(1 + (c - self.d2 * tables) / (STRENGTH + context) * np.power(10.0, -back - lm)))


def _state(known: DataFrame, pairs: DataFrame, names: np.ndarray, excess: list[str], name: str) -> DataFrame:
    """word, letters, c; customers u0, u1, ... in the word restaurant and tables
    v0, v1, ... in the word's own context, of the seatings with ``excess`` columns;
    none: pairs with one table each."""
    cast = known.sparkSession.sparkContext.broadcast(names)
    marks = [f"{m}{i}" for m in "uv" for i in range(len(excess) or 1)]

    def run(batches):
        for r in _rows(batches):
            prev, word, c = _known_pairs(cast.value, r)
            more = [_unpacked(r[e], r["size"], np.int64) for e in excess] or [c - 1]
            u, place = _numbered(np.concatenate((word, prev)))
            sums = [np.bincount(at, e, len(u)) for at in (place[: len(c)], place[len(c) :]) for e in more]
            yield pa.RecordBatch.from_arrays([pa.array(u), *map(pa.array, sums)], ["word", *marks])

    parts = pairs.select("size", "prev", "word", "c", *excess).mapInArrow(run, "word long, " + ", ".join(f"{m} double" for m in marks))
    sums = parts.groupBy("word").agg(*[F.sum(m).alias(f"less_{m}") for m in marks])
    out = known.select("word", "letters", "c").join(sums, "word", "left")
    found = materialise(out.select("word", "letters", "c", *[F.expr(f"c - coalesce(less_{m}, 0D)").alias(m) for m in marks]), name)
    cast.destroy()
    return found


def _seated(pairs: DataFrame, values: DataFrame, names: np.ndarray, d2: float) -> DataFrame:
    """``pairs`` with their customers beyond one a table, e0, e1, ..., when they
    are seated for each kept sweep: ``values`` has p of a word and v0 of a context,
    the frequent words' are broadcast, others meet their buckets in joins."""
    sc = pairs.sparkSession.sparkContext
    cast = sc.broadcast((names, _frequent_values(values, names, ["p", "v0"])))

    def ask(batches):
        names = cast.value[0]
        for r in _rows(batches):
            x = np.unique(np.concatenate([y[(y < 1) | (y > len(names))] for y in (_unpacked(r[k], r["size"], np.int64) for k in ("prev", "word"))]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r["bucket"], np.int32)), pa.array(x)], ["bucket", "word"])

    def run(key, left, right):
        names, frequent = cast.value
        r = left.drop_columns(["units", "sizes", "at"]).to_pylist()[0]
        prev, word, c = _known_pairs(names, r)
        p, v0 = _looked_up(word, frequent, right, ["p"])[0], _looked_up(prev, frequent, right, ["v0"])[0]
        customers, pair = c.astype(float), _pair(prev, word)
        for k in range(KEPT):
            tables = seat(customers, p, v0, d2, pair, BURN_IN + k)
            left = left.append_column(f"e{k}", pa.array([_packed((customers - tables).astype(np.int64))], pa.binary()))
        return left

    found = pairs.select("bucket", "size", "prev", "word").mapInArrow(ask, "bucket int, word long").join(values, "word").select("bucket", "word", "p", "v0")
    kind = _PAIRS + ", " + ", ".join(f"e{k} binary" for k in range(KEPT))
    out = materialise(pairs.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, kind), "pitmanyor-seated")
    cast.destroy()
    return out


def fit(table: DataFrame, pairs: DataFrame | None = None, names: np.ndarray | None = None, spend: bool = False) -> Model:
    """Gibbs sweeps over the training counts of the word table and of the pair
    table; without the latter, tokens sit in the word restaurant.  ``spend``:
    the pair table is discarded when its pairs are seated."""
    spark = table.sparkSession
    known = table.where("c > 0")
    sums = known.agg(F.sum("c"), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    tokens, types, one, two = (int(x or 0) for x in sums)
    d = float(np.clip(one / (one + 2 * two) if one else 0, *DISCOUNT))

    def alphabet(batches):
        seen = np.zeros(256, bool)
        for b in arrow_rows(batches):
            seen[np.unique(text_bytes(b.column(0))[0])] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32())], ["b"])

    letters = known.select("letters").mapInArrow(alphabet, "b int").distinct().toArrow()["b"].to_numpy()  # 256 rows at most
    spelling, total = Spelling(np.union1d(letters, [_EDGE])), float(types)
    d2, column = 0.0, "c"
    if pairs is not None:
        two, more = (int(x or 0) for x in pairs.agg(F.sum("two"), F.sum("more")).first())
        one = tokens - more  # pairs that occur once
        d2 = float(np.clip(one / (one + 2 * two) if one else 0, *DISCOUNT))
        known = _state(known, pairs, names, [], "pitmanyor-state")
        column = "u0"
    sweeps = []
    for number in range(BURN_IN + KEPT):
        if number == BURN_IN and pairs is not None:
            before = spark.sparkContext.broadcast(Model(tokens, types, d, [sweep]))

            def settled(batches, before=before):
                for b in arrow_rows(batches):
                    c = b.column(2).to_numpy()
                    _, lm = before.value.scores(b.column(0).to_numpy().view(np.uint64), c, b.column(1), [c])
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.power(10.0, lm)), b.column(3)], ["word", "p", "v0"])

            values = materialise(known.select("word", "letters", "u0", "v0").mapInArrow(settled, "word long, p double, v0 double"), "pitmanyor-values")
            before.destroy()
            seated = _seated(pairs, values, names, d2)
            discard(values, *([pairs] if spend else []))
            pairs, earlier = seated, known
            known = _state(earlier, pairs, names, [f"e{k}" for k in range(KEPT)], "pitmanyor-state")
            discard(earlier)
        if pairs is not None:
            column = f"u{max(0, number - BURN_IN)}"
        sweep = Sweep(number, spelling, total)
        cast = spark.sparkContext.broadcast(sweep)

        def run(batches, cast=cast):
            s = cast.value
            cells, tables, customers = np.zeros(s.before.size**3), 0.0, 0.0
            held, size = [], 0
            for b in arrow_rows(batches):
                cell, start = s.before.cells(b.column(1))
                t = s.tables(b.column(0).to_numpy().view(np.uint64), b.column(2).to_numpy().astype(float), (cell, start), d)
                held.append((cell, np.repeat(t, np.diff(np.append(start, len(cell))))))
                size += len(cell)
                if size >= len(cells):
                    cells += np.bincount(*map(np.concatenate, zip(*held)), len(cells))
                    held, size = [], 0
                tables += t.sum()
                customers += b.column(2).to_numpy().sum()
            if held:
                cells += np.bincount(*map(np.concatenate, zip(*held)), len(cells))
            full = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(full, [-1, -2]), pa.int64()), pa.array(np.append(cells[full], [tables, customers]))], ["cell", "n"])

        got = known.select("word", "letters", column).mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 257^3 rows at most
        cell, n = got["cell"].to_numpy(), got["n"].to_numpy()
        sweep.total = total = float(n[cell == -1].sum())
        sweep.customers = float(n[cell == -2].sum())
        counts = np.zeros(spelling.size**3)
        counts[cell[cell >= 0]] = n[cell >= 0]
        after = Spelling(np.union1d(letters, [_EDGE]))
        after.p0, after.p1, after.p2 = spelling.p0, spelling.p1, spelling.p2
        after.learn(counts.reshape((spelling.size,) * 3), number)
        sweep.after = spelling = after
        cast.destroy()
        if number >= BURN_IN:
            sweeps.append(sweep)
    kept = spark.sparkContext.broadcast([s.after for s in sweeps])

    def mass(batches):
        sums = np.zeros(len(kept.value))
        for b in arrow_rows(batches):
            cells = kept.value[0].cells(b.column(0))
            sums += [s.base(*cells).sum() for s in kept.value]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], ["sweep", "p"])

    for r in known.select("letters").mapInArrow(mass, "sweep int, p double").groupBy("sweep").agg(F.sum("p").alias("p")).collect():  # KEPT rows
        sweeps[r["sweep"]].known = r["p"]
    kept.destroy()
    return Model(tokens, types, d, sweeps, d2, known if pairs is not None else None, pairs)


def _scored_words(table: DataFrame, model: Model) -> DataFrame:
    """word, base, lm, back, context (its customers), known, n."""
    cast = table.sparkSession.sparkContext.broadcast(model)
    marks = [f"{m}{k}" for m in "uv" for k in range(KEPT)] if model.known is not None else []

    def run(batches):
        m = cast.value
        for b in arrow_rows(batches):
            c = b.column(2).to_numpy().astype(float)
            more = [x.to_numpy(zero_copy_only=False) for x in b.columns[4:]]
            customers, tables = more[:KEPT], more[KEPT:]
            base, lm = m.scores(b.column(0).to_numpy().view(np.uint64), c, b.column(1), customers)
            back = m.back(c, tables) if tables else np.zeros(len(c))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base), pa.array(_grid(lm)), pa.array(_grid(back)), pa.array(c), pa.array((c > 0).astype(np.int64)), b.column(3)], ["word", "base", "lm", "back", "context", "known", "n"])

    src = table.select("word", "letters", "c", "n")
    if marks:
        src = src.join(model.known.select("word", *marks), "word", "left").select(*src.columns, *[F.coalesce(x, F.lit(0.0)).alias(x) for x in marks])
    found = materialise(src.mapInArrow(run, "word long, base double, lm double, back double, context double, known long, n long"), "pitmanyor-scores")
    cast.destroy()
    return found


def _gains(model: Model, scored: DataFrame, names: np.ndarray) -> DataFrame:
    """pair, gain of the pairs that occur more than once in the training texts."""
    cast = scored.sparkSession.sparkContext.broadcast((model.pairs_only(), names))

    def spread(batches):
        for r in _rows(batches):
            prev, word, c = _known_pairs(cast.value[1], r)
            e = sum(_unpacked(r[f"e{k}"], r["size"], np.int64) for k in range(KEPT)) / KEPT
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (prev, word, _pair(prev, word).view(np.int64), c.astype(float), e)], ["prev", "word", "pair", "c", "e"])

    def run(batches):
        for b in arrow_rows(batches):
            c, e, lm, back, context = (b.column(i).to_numpy() for i in range(1, 6))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cast.value[0].gain(c, c - e, context, back, lm))], ["pair", "gain"])

    pairs = model.pairs.drop("units", "sizes", "at").mapInArrow(spread, "prev long, word long, pair long, c double, e double")
    found = pairs.join(scored.select("word", "lm"), "word").join(scored.select(F.col("word").alias("prev"), "back", "context"), "prev")
    return found.select("pair", "c", "e", "lm", "back", "context").mapInArrow(run, "pair long, gain double")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, train, n_tokens, n_known,
    train_tokens, base_score, score, perplexity.  ``train``: condition on
    column doc_id of the rows to learn from."""
    prepared(docs)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("train", train)
    units = _units(src)
    table = _word_table(src, units)
    names = _head(table)
    model = fit(table, _pair_table(src, names, int(units.agg(F.sum("tokens")).first()[0] or 0), units), names, spend=True)
    scored = _scored_words(table, model)
    discard(table, model.known)
    values = ["context", "lm", "back"]
    cast = docs.sparkSession.sparkContext.broadcast((_frequent_values(scored, names, values), model.pairs_only()))
    kind = src.schema["doc_id"].dataType.simpleString()

    def ask(batches):
        """The words of a unit that are not broadcast."""
        for r in _rows(batches):
            x = _unpacked(r["word"], r["size"], np.int64)
            x = x[_place(cast.value[0]["word"], x) < 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r["unit"])), pa.array(x)], ["unit", "word"])

    def tell(batches):
        """To each unit c and excess customers of its pairs in a bucket."""
        for r in _rows(batches):
            c = np.concatenate(([0, 1], _unpacked(r["c"], r["size"], np.int64)))
            e = np.concatenate(([0, 0], sum(_unpacked(r[f"e{k}"], r["size"], np.int64) for k in range(KEPT))))
            ends = np.append(0, np.cumsum(r["sizes"]))
            at = _unpacked(r["at"], int(ends[-1]), np.int32)
            runs = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            for k in range(0, len(runs), 64):
                some = runs[k : k + 64]
                data = [pa.array([_packed(x[at[i:j]]) for i, j in some], pa.binary()) for x in (c, e)]
                yield pa.RecordBatch.from_arrays([pa.array(r["units"][k : k + 64], pa.int64()), pa.array([r["bucket"]] * len(some), pa.int32()), pa.array([j - i for i, j in some], pa.int32()), *data], ["unit", "bucket", "size", "c", "e"])

    def run(key, left, right):
        """The scores of a unit's documents, from its words' values and its pairs'
        customers."""
        frequent, model = cast.value
        size, tokens, packed, seq = (left[k][0].as_py() for k in ("size", "tokens", "word", "seq"))
        u, seq = _unpacked(packed, size, np.uint64), _unpacked(seq, tokens, np.int32)
        told = right.filter(pc.is_valid(right["bucket"])).sort_by("bucket").select(["size", "c", "e"]).to_pylist()
        others = right.filter(pc.is_null(right["bucket"])).select(["word", *values])
        context, lm, back = _looked_up(u.view(np.int64), frequent, others, values)
        _, prev, word, place = _unit_pairs(u, seq)
        c, e = (np.concatenate([_unpacked(r[k], r["size"], np.int64) for r in told]) for k in ("c", "e"))
        gain, seen = np.zeros(len(c)), np.flatnonzero(c)
        a, b = prev[seen], word[seen]
        gain[seen] = model.gain(c[seen].astype(float), c[seen] - e[seen] / KEPT, context[a], back[a], lm[b])
        last = np.flatnonzero(u[seq] == _U(END))
        first = np.append(0, last[:-1] + 1)
        base = np.log10((context + 1) / (model.tokens + model.types + 1))
        sums = [np.add.reduceat(x, first) for x in (base[seq], (lm + back)[seq] + gain[place], (context > 0)[seq].astype(np.int64))]  # a token is a token and a context once
        lists = [left[k].combine_chunks().flatten() for k in ("doc_id", "train")]
        return pa.Table.from_arrays([*lists, pa.array(last - first + 1), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    asked = units.select("unit", "size", "word").mapInArrow(ask, "unit long, word long").join(scored.select("word", *values), "word")
    told = model.pairs.drop("prev", "word").mapInArrow(tell, "unit long, bucket int, size int, c binary, e binary")
    met = told.unionByName(asked, allowMissingColumns=True)
    heads = units.select("unit", "tokens", "size", "word", "seq", "doc_id", "train")
    out = heads.groupBy("unit").cogroup(met.groupBy("unit")).applyInArrow(run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score").withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _training(F.col("doc_id"), 7, 2)
    found = score(read_table(spark, sf_dir, "documents"), train)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
