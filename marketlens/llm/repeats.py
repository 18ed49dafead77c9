"""Removal of long repeated passages by suffix sorting (operator 9).

A byte goes if some string of SPAN bytes that covers it starts anywhere else as
well.  Strings never cross documents and are judged on the input.

A passage of 50 words may have fewer bytes and then stays.  What repeats between
documents is therefore told in words too: a word is shared if some run of 50
words that covers it is in another document as well (words as in ``shingles``,
whatever white space lies between them; rows that agree in id and text are one
document).  The same steps find both, over bytes and over words as symbols.

* Every string of SPAN bytes has one anchor: the GRAM-byte substring of least
  hash in it, the leftmost of equals.  Equal strings have equal anchors at equal
  places, so comparing strings of the same anchor suffices.  Strings of one
  document with one anchor are a run of starts; their union is its context.
* Anchors that occur once are out (counted by hash; a bit table of bounded size
  spares most of them the way).  A context that occurs again as a whole goes as
  a whole.  Anchors with one context are settled thus.
* Contexts that share an anchor but differ are cut into cores: STEP consecutive
  starts have SPAN - STEP + 1 bytes in common.  Cores that differ share none of
  their strings.  Members of a core are written as a short string (the bytes
  before it, one symbol for the core, the bytes after it).  Twins repeat wholly;
  the distinct ones are suffix-sorted with the rest of the partition
  (``gsaca``), and neighbours in suffix order tell which strings repeat.
* A core of more than MOST members compares its strings by their hashes in a
  grouped count, which no task has to hold.

Passages are identified by 63-bit hashes of content, twice over (anchor and
context or core); their lowest bit tells words from bytes.  Interval and text meet on the row key only for documents that
lose something.

Cases: a null text is an empty text; texts under SPAN bytes keep everything;
repeated rows are repeats of each other; short texts are hashed in blocks, a very
long one by itself, in pieces; empty table: no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import arrow_rows, bit_table, blocks, discard, has_bit, materialise, prepared, read_table, row_key, text_bytes
from marketlens.llm.gsaca import suffix_array
from marketlens.llm.shingles import _R, PIECE, _powers, mix, words

SPAN = 400
GRAM = 64
STEP = 64
#: Members of a core that are sorted in a task.
MOST = 1000
#: Symbols that a task sorts at a time.
SORT = 1 << 15
#: Bytes of short texts that are hashed together.
BLOCK = 1 << 17
#: Anchors in a packed row.
PACK = 1 << 15

_U = np.uint64
_LOW = 24


class Unit(NamedTuple):
    """What strings consist of: symbols in a string, in an anchor, starts in a
    step; the lowest bit of the hashes; bytes of a symbol."""

    span: int
    gram: int
    step: int
    flag: int
    width: int


BYTES = Unit(SPAN, GRAM, STEP, 0, 1)
WORDS = Unit(50, 12, 16, 1, 8)
UNITS = (BYTES, WORDS)


def _by_unit(field: str, hashed: str) -> str:
    """SQL: a field of the unit that a hash belongs to."""
    return f"if({hashed} & 1 = 1, {getattr(WORDS, field)}, {getattr(BYTES, field)})"


@cache
def _code() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _R)


class Hashes:
    """Hashes of any substring of a sequence of bytes or 64-bit symbols, from
    prefix sums in pieces."""

    def __init__(self, buf: np.ndarray):
        power, _ = _powers()
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(0, len(buf), PIECE):
                part = buf[k : k + PIECE]
                code = _code()[part] if buf.dtype == np.uint8 else part
                scale = power[: len(part)] * _U(pow(int(_R), k, 1 << 64)) if k else power[: len(part)]
                np.cumsum(code * scale, out=self.sums[k + 1 : k + 1 + len(part)])
                self.sums[k + 1 : k + 1 + len(part)] += self.sums[k]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [a, b)."""
        _, inverse = _powers()
        with np.errstate(over="ignore"):
            if len(self.sums) <= len(inverse):
                inv = inverse[a]
            else:
                block = np.array([pow(int(_R), -k * PIECE, 1 << 64) for k in range(len(self.sums) // PIECE + 1)], np.uint64)
                inv = inverse[a % PIECE] * block[a // PIECE]
            return mix((self.sums[b] - self.sums[a]) * inv + (b - a).astype(np.uint64) * _R)

    def every(self, w: int) -> np.ndarray:
        """Hashes of all substrings of ``w`` symbols."""
        _, inverse = _powers()
        n = len(self.sums) - w
        if len(self.sums) > len(inverse):
            return self.of(np.arange(n), np.arange(n) + w)
        with np.errstate(over="ignore"):
            return mix((self.sums[w:] - self.sums[:n]) * inverse[:n] + _U(w) * _R)


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` keys."""
    n = len(key)
    a = np.full(-(-n // w) * w, ~_U(0))
    a[:n] = key
    a = a.reshape(-1, w)
    down = np.minimum.accumulate(a, axis=1).reshape(-1)
    up = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(up[: n - w + 1], down[w - 1 : n])


class Anchors(NamedTuple):
    """Each anchor's hash and place, the first and last start of its strings,
    its text, the hash of its context and of the anchor's place in it."""

    anchor: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    context: np.ndarray


def anchors(h: Hashes, offsets: np.ndarray, unit: Unit = BYTES) -> Anchors | None:
    """Of texts laid end to end; None if none has a string."""
    size = np.diff(offsets)
    long = np.flatnonzero(size >= unit.span)
    if not len(long):
        return None
    g = h.every(unit.gram)
    w = unit.span - unit.gram + 1
    found = []
    for lo in range(0, len(g) - w + 1, 1 << (_LOW - 1)):  # places fit the key's low bits
        part = g[lo : lo + (1 << (_LOW - 1)) + w - 1]
        key = (part >> _U(_LOW) << _U(_LOW)) | np.arange(len(part), dtype=np.uint64)
        found.append((_least(key, w) & _U((1 << _LOW) - 1)).astype(np.int64) + lo)
    at = np.concatenate(found)
    edge = np.zeros(len(at) + 1, np.int8)
    edge[offsets[long]] += 1
    edge[offsets[long] + size[long] - unit.span + 1] -= 1
    start = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))  # strings within a text
    at = at[start]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    at, first, last = at[new], start[new], start[np.append(new[1:], len(start)) - 1]
    flag = lambda x: x >> _U(1) << _U(1) | _U(unit.flag)
    with np.errstate(over="ignore"):
        context = mix(h.of(first, last + unit.span) + (at - first).astype(np.uint64))
    return Anchors(flag(g[at]), at, first, last, np.searchsorted(offsets, first, side="right") - 1, flag(context))


def _sequences(b: pa.RecordBatch) -> Iterator[tuple[Unit, np.ndarray, np.ndarray, np.ndarray, Hashes, Anchors]]:
    """For blocks of a batch of (text, key): unit, keys, symbols, offsets,
    hashes and anchors, where there are any."""
    buf, off = text_bytes(b.column(0))
    keys = b.column(1).to_numpy()
    for lo, hi in blocks(off, BLOCK):
        part, edges = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if not len(part):
            continue
        seen, _, _, first = words(part, edges)
        for unit, symbols, offsets in (BYTES, part, edges), (WORDS, seen, first):
            if np.diff(offsets).max() >= unit.span:
                h = Hashes(symbols)
                yield unit, keys[lo:hi], symbols, offsets, h, anchors(h, offsets, unit)


_PACKED = {"anchor": np.uint64, "context": np.uint64, "key": np.int64, "at": np.int32, "first": np.int32, "last": np.int32}


def _packed(docs: DataFrame) -> DataFrame:
    """All anchors, some PACK in a row, each column as bytes; places count
    from the text's start."""

    def run(batches):
        held, n = [], 0
        for b in arrow_rows(batches):
            for _, keys, _, offsets, _, a in _sequences(b):
                base = offsets[a.text]
                held.append((a.anchor, a.context, keys[a.text], a.at - base, a.first - base, a.last - base))
                n += len(base)
                if n >= PACK:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    def pack(held):
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(c).astype(t).tobytes()], pa.binary()) for c, t in zip(zip(*held), _PACKED.values())], list(_PACKED))

    return docs.select("text", "key").mapInArrow(run, ", ".join(f"{c} binary" for c in _PACKED))


def _unpacked(batches) -> Iterator[list[np.ndarray]]:
    for b in arrow_rows(batches):
        for k in range(b.num_rows):
            yield [np.frombuffer(c[k].as_buffer(), _PACKED[name]) for name, c in zip(b.schema.names, b.columns)]


def _counted(packed: DataFrame) -> DataFrame:
    """Hashes of anchors that occur at least twice."""

    def run(batches):
        held, size = [], 0
        for (g,) in _unpacked(batches):
            held.append(g)
            size += len(g)
            if size >= 1 << 18:  # counted in the task first
                yield count(held)
                held, size = [], 0
        if held:
            yield count(held)

    def count(held):
        u, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(_long(u)), pa.array(c, pa.int64())], ["anchor", "n"])

    n = packed.select("anchor").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return n.where("n > 1").select("anchor")


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _contexts(packed: DataFrame, shared: np.ndarray) -> DataFrame:
    """anchor, context, key, at, first, last of the anchors in the bit table."""
    cast = packed.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        for cols in _unpacked(batches):
            keep = np.flatnonzero(has_bit(cast.value, cols[0]))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(c[keep].astype(np.int64)) for c in cols], list(_PACKED))

    return packed.mapInArrow(run, ", ".join(f"{c} long" for c in _PACKED))


def _holders(packed: DataFrame, wanted: np.ndarray) -> DataFrame:
    """key of the texts with a context in the bit table."""
    cast = packed.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for context, key in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[has_bit(cast.value, context)]))], ["key"])

    return packed.select("context", "key").mapInArrow(run, "key long")


def _cut(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the substrings [a, b), and how many each has."""
    n = b - a
    own = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return symbols[own].view(np.uint8), n * symbols.itemsize


def _binary(data: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    n = np.concatenate(sizes)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int32)), pa.py_buffer(np.concatenate(data))])


def _cores(docs: DataFrame, holders: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """For contexts in the bit table, once a task: anchor, context, step,
    core, the context's symbols before and after the core (as bytes)."""
    cast = docs.sparkSession.sparkContext.broadcast((holders, wanted))

    def run(batches):
        holders, wanted = cast.value
        seen: set[int] = set()
        held, n = [], 0
        for b in arrow_rows(batches):
            b = b.filter(pa.array(has_bit(holders, b.column(1).to_numpy().view(np.uint64))))
            if not b.num_rows:
                continue
            for unit, _, symbols, _, h, x in _sequences(b):
                i = np.flatnonzero(has_bit(wanted, x.context))
                u, k = np.unique(x.context[i], return_index=True)
                new = np.array([c not in seen for c in u.tolist()], bool)
                seen.update(u[new].tolist())
                i = i[k[new]]
                if not len(i):
                    continue
                p, lo, hi = x.at[i], x.first[i], x.last[i] + unit.span
                # starts p - step * (s + 1) + 1 .. p - step * s belong to step s
                least = (p - x.last[i]) // unit.step
                many = (p - lo) // unit.step - least + 1
                of = np.repeat(np.arange(len(i)), many)
                s = np.arange(len(of)) - np.repeat(np.cumsum(many) - many - least, many)
                a = p[of] - unit.step * s
                z = a + unit.span - unit.step + 1
                core = h.of(a, z) >> _U(1) << _U(1) | _U(unit.flag)
                before, after = _cut(symbols, np.maximum(lo[of], a - unit.step + 1), a), _cut(symbols, z, np.minimum(hi[of], z + unit.step - 1))
                held.append((x.anchor[i][of], x.context[i][of], s, core, *before, *after))
                n += len(of)
                if n >= 1 << 13:
                    yield batch(held)
                    held, n = [], 0
        if held:
            yield batch(held)

    def batch(held):
        anchor, context, s, core, *cuts = zip(*held)
        column = lambda x: pa.array(_long(np.concatenate(x)))
        columns = [column(anchor), column(context), pa.array(np.concatenate(s), pa.int32()), column(core), _binary(*cuts[:2]), _binary(*cuts[2:])]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "context", "step", "core", "before", "after"])

    return docs.select("text", "key").mapInArrow(run, "anchor long, context long, step int, core long, before binary, after binary")


def repeated_starts(members: list[tuple], step: int = STEP, owners: list[tuple[int, int]] | None = None) -> list[tuple[int, int] | None]:
    """For each member (core, symbols before, symbols after) the first and last
    start, counted from the core's own (0 or less), of its strings that another
    member has as well; None without any.  Members of one core are told from
    others by the core's symbol.  With ``owners`` (a member's least and greatest
    key) only strings of more than one key count."""
    text: list[int] = []
    origin: list[int] = []
    symbol: dict[int, int] = {}
    for core, before, after in members:
        origin.append(len(text) + len(before))
        text.extend([b + 1 for b in before])
        text.append(symbol.setdefault(core, -1 - len(symbol)))
        text.extend([b + 1 for b in after])
        text.append(0)
    # the string that starts d symbols before the core ends step - 1 - d after it
    owner: dict[int, int] = {}
    for m, (_, before, after) in enumerate(members):
        for d in range(max(0, step - 1 - len(after)), len(before) + 1):
            owner[origin[m] - d] = m
    wide = np.array(text, np.int32).tobytes()
    out: list[tuple[int, int] | None] = [None] * len(members)
    run: list[int] = []  # neighbours in suffix order with one string

    def settle():
        if owners and min(owners[owner[x]][0] for x in run) == max(owners[owner[x]][1] for x in run):
            return
        for x in run:
            m = owner[x]
            d = x - origin[m]
            lo, hi = out[m] or (d, d)
            out[m] = min(lo, d), max(hi, d)

    for at in suffix_array(text):
        if at in owner and run and wide[4 * run[-1] : 4 * (run[-1] + step)] == wide[4 * at : 4 * (at + step)]:
            run.append(at)
            continue
        if len(run) > 1:
            settle()
        run = [at] if at in owner else []
    if len(run) > 1:
        settle()
    return out


def _repeated_words(members: list[tuple], owners: list[tuple[int, int]]) -> list[tuple[int, int] | None]:
    """The same for members whose symbols are words, as bytes."""
    ids: dict[int, int] = {}
    ranks = lambda x: [ids.setdefault(w, len(ids)) for w in np.frombuffer(x, np.uint64).tolist()]
    return repeated_starts([(core, ranks(before), ranks(after)) for core, before, after in members], WORDS.step, owners)


def _sorted_cores(strings: DataFrame) -> DataFrame:
    """id, lo, hi: starts of repeated strings relative to the core's start.
    ``strings``: core, before, after, id, least and greatest key."""
    schema = pa.schema([("id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches):
        held: list[tuple] = []
        size = 0

        def settle():
            got = []
            for unit in UNITS:
                own = [r for r in held if r[0] & 1 == unit.flag]
                members = [r[:3] for r in own]
                found = _repeated_words(members, [r[4:] for r in own]) if unit.flag else repeated_starts(members)
                got += [(r[3], *f) for r, f in zip(own, found) if f]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), schema.types)], schema=schema)

        for b in arrow_rows(batches):
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size >= SORT and r[0] != held[-1][0]:  # never within a core
                    yield from settle()
                    held, size = [], 0
                held.append(r)
                size += (len(r[1]) + len(r[2])) // UNITS[r[0] & 1].width + 2
        if held:
            yield from settle()

    return strings.repartition("core").sortWithinPartitions("core").mapInArrow(run, "id long, lo int, hi int")


def _hashed_cores(strings: DataFrame) -> DataFrame:
    """The same for cores of any size, by counting hashes of strings."""

    def run(batches):
        for b in arrow_rows(batches):
            for k in range(0, b.num_rows, 256):  # each row gives up to STEP strings
                rows = []
                for core, before, after, id_, least, greatest in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)):
                    _, _, step, _, width = UNITS[core & 1]
                    for d in range(max(0, step - 1 - len(after) // width), len(before) // width + 1):
                        string = before[len(before) - d * width :] + core.to_bytes(8, "big", signed=True) + after[: (step - 1 - d) * width]
                        rows.append((id_, -d, int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "big", signed=True), core, least, greatest))
                if rows:
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["id", "d", "string", "core", "least", "greatest"])

    cut = strings.mapInArrow(run, "id long, d int, string long, core long, least long, greatest long")
    again = cut.groupBy("core", "string").agg(F.count("*").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    again = again.where(_again("core")).select("core", "string")
    return cut.join(again, ["core", "string"], "left_semi").groupBy("id").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))


def _again(hashed: str) -> str:
    """SQL: what occurs n times, in texts of these keys, repeats: bytes
    anywhere, words in another document."""
    return f"n > 1 and ({hashed} & 1 = 0 or least < greatest)"


def intervals(keyed: DataFrame) -> DataFrame:
    """key, words (boolean), start, end: the bytes that go, the words that
    other documents have, overlaps included; ``keyed``: key and text."""
    packed = materialise(_packed(keyed), "repeats-packed")
    shared = materialise(_counted(packed), "repeats-anchors")
    ctx = materialise(_contexts(packed, bit_table(shared, "anchor")), "repeats-contexts")
    kinds = ctx.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("greatest"))
    kinds = materialise(kinds, "repeats-kinds")
    span, step = _by_unit("span", "anchor"), _by_unit("step", "anchor")
    whole = ctx.join(kinds.where(_again("anchor")), ["anchor", "context"], "left_semi").selectExpr("key", "anchor & 1 = 1 as words", "first as start", f"last + {span} as end")

    mixed = kinds.groupBy("anchor").count().where("count > 1").select("anchor")
    unlike = materialise(kinds.join(mixed, "anchor", "left_semi").select("anchor", "context", "least", "greatest"), "repeats-unlike")
    wanted = bit_table(unlike, "context")
    cores = _cores(keyed, bit_table(materialise(_holders(packed, wanted), "repeats-holders"), "key"), wanted)
    cores = cores.join(unlike, ["anchor", "context"])
    cores = cores.dropDuplicates(["anchor", "context", "step"]).withColumn("id", F.xxhash64("core", "before", "after"))
    cores = materialise(cores, "repeats-cores")
    discard(packed)
    strings = cores.groupBy("core", "before", "after", "id").agg(F.count("*").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    strings = materialise(strings, "repeats-strings")
    many = materialise(strings.groupBy("core").count().where("count > 1"), "repeats-members")
    members = lambda size: strings.join(many.where(size), "core", "left_semi").select("core", "before", "after", "id", "least", "greatest")
    found = _sorted_cores(members(f"count <= {MOST}")).union(_hashed_cores(members(f"count > {MOST}")))
    # a member's twin has all of its strings
    width, steps = _by_unit("width", "core"), _by_unit("step", "core")
    twins = strings.where(f"{_again('core')} and octet_length(before) + octet_length(after) >= {width} * ({steps} - 1)")
    twins = twins.selectExpr("id", f"cast(-octet_length(before) div {width} as int) as lo", f"cast(least(0, octet_length(after) div {width} - {steps} + 1) as int) as hi")
    found = found.union(twins).groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = materialise(cores.select("anchor", "context", "step", "id").join(found, "id"), "repeats-found")
    part = ctx.join(found, ["anchor", "context"])
    part = part.selectExpr("key", "anchor & 1 = 1 as words", f"at - {step} * step + lo as start", f"at - {step} * step + hi + {span} as end")
    return materialise(whole.union(part), "repeats-intervals")


def _union(cuts: list[dict] | None) -> list[dict]:
    """Sorted intervals, those that meet made one."""
    merged: list[dict] = []
    for c in cuts or ():
        if merged and c["start"] <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], c["end"])
        else:
            merged.append(dict(c))
    return merged


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans,
    spans (removed runs as an array of start, end), kept (the remaining bytes,
    binary), n_shared_words (words in runs of 50 that other documents have)."""
    prepared(docs)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    keyed = src.withColumn("key", row_key())
    cut = intervals(keyed)
    of = lambda kind: F.sort_array(F.collect_set(F.when(kind, F.struct("start", "end"))))
    cut = materialise(cut.groupBy("key").agg(of(~F.col("words")).alias("cuts"), of(F.col("words")).alias("shared")), "repeats-cuts")
    cast = docs.sparkSession.sparkContext.broadcast(bit_table(cut, "key"))
    kind = src.schema["doc_id"].dataType.simpleString()

    @F.pandas_udf("boolean")
    def loses(key: pd.Series) -> pd.Series:
        return pd.Series(has_bit(cast.value, key.to_numpy().view(np.uint64)))

    keyed = keyed.withColumn("loses", loses("key"))
    spans = "array<struct<start:bigint,end:bigint>>"
    same = keyed.where(~F.col("loses")).selectExpr("doc_id", "coalesce(octet_length(text), 0) as n_bytes", f"cast(array() as {spans}) as spans", "cast(coalesce(text, '') as binary) as kept", "0L as n_shared_words")
    rest = keyed.where("loses").join(cut, "key", "left").select("doc_id", "text", "cuts", "shared")

    def run(batches):
        for b in arrow_rows(batches):
            buf, off = text_bytes(b.column(1))
            sizes, runs, kept = [], [], []
            for k, cuts in enumerate(b.column(2).to_pylist()):
                text = buf[off[k] : off[k + 1]]
                merged = _union(cuts)
                edges = [0, *(x for m in merged for x in (m["start"], m["end"])), len(text)]
                sizes.append(len(text))
                runs.append(merged)
                kept.append(b"".join(text[i:j].tobytes() for i, j in zip(edges[::2], edges[1::2])))
            shared = [sum(c["end"] - c["start"] for c in _union(x)) for x in b.column(3).to_pylist()]
            item = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, item), pa.array(kept, pa.binary()), pa.array(shared, pa.int64())], ["doc_id", "n_bytes", "spans", "kept", "n_shared_words"])

    cut_rows = rest.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans {spans}, kept binary, n_shared_words long")
    return same.union(cut_rows).selectExpr("doc_id", "cast(n_bytes as long) as n_bytes", "n_bytes - octet_length(kept) as n_removed", "cast(size(spans) as long) as n_spans", "spans", "kept", "n_shared_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words")
