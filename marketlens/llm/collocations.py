"""Phrase collocations from a weighted de Bruijn graph (operator 13).

The graph's nodes are sequences of four words, its edges the sequences of five
that join two of them, weighted by their occurrences.

* Edges are the only sequences counted in the texts, once for each word as their
  first.  Near the end of a piece fewer words follow, so the last ones give
  shorter sequences: the piece-end corrections.
* A node's count is what flows out of it, its edges' weights, plus the pieces
  that end with it.  Taking the nodes as edges, the same gives the sequences of
  three, two and one words, and the number of all words.
* Where all of a node's occurrences come by one edge and go by one edge, the
  path through it is unary.  Unary paths are compacted by pointer doubling: a
  path is a passage with one weight.  Frequent sequences of five are read off
  the paths, and nodes inside a path are the ones that a longer candidate with
  the same count swallows.
* A candidate's cuts are scored in whole numbers of up to 38 digits.

Pieces are cut where a pair of neighbouring words is rarer than LEAST: no
candidate contains such a pair, and counts of sequences without it stay the same
(words left alone by the cuts are corrections, too).  Pairs are known by a bit
table of the hashes of frequent ones (frequent words first, then pairs of them),
without false negatives; where the table is full it cuts less, and nothing else
changes.  Words are 64-bit hashes of word and language, spelled out at the end.

Tasks count their sequences before they shuffle them, and all that is shuffled
is dealt by whole sequences, so neither a frequent word or passage nor a
language gathers in one task but in the last step, which ranks what can be among
a language's first ones.

Cases: a null text is empty; a null language is `und`, together with documents
that say so; punctuation alone gives no words; very long pieces are counted
whole; repeated rows count repeatedly; ties end with the phrase; empty table or
no frequent phrase: no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import arrow_rows, bit_table, blocks, has_bit, materialise, prepared, read_table, text_bytes
from marketlens.llm.shingles import mix
from marketlens.llm.terms import byte_set, hashes, runs

LEAST = 100
WIDTH = 5
FIRST = 2000
#: Words that a task holds before it counts and returns them.
HELD = 1 << 20
UNKNOWN = "und"

# What ends a piece, and what parts its words.
BREAKS = byte_set(".,;:!?", range(0xA, 0xE))
WORD_BYTES = ~(BREAKS | byte_set(" \t"))

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_WORDS = [f"w{k}" for k in range(1, WIDTH + 1)]


class Words:
    """Words of some documents in order: hash (of word and language), whether
    the next one follows in the same piece, language number and place."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: np.ndarray, seeds: np.ndarray):
        self.buf = buf
        self.begin, self.stop, doc = runs(buf, off, WORD_BYTES)
        self.lang = langs[doc]
        with np.errstate(over="ignore"):
            self.hash = mix(hashes(buf, self.begin, self.stop) + seeds[self.lang])
        ended = np.cumsum(BREAKS[buf])[self.begin] if len(self.begin) else self.begin
        self.linked = np.zeros(len(doc), bool)
        self.linked[:-1] = (doc[1:] == doc[:-1]) & (ended[1:] == ended[:-1])

    def text(self, k: int) -> str:
        return self.buf[self.begin[k] : self.stop[k]].tobytes().translate(_LOWER).decode("utf-8", "replace")


_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


def _seed(lang: str) -> np.uint64:
    """64 bits of a language's name."""
    raw = np.frombuffer(lang.encode(), np.uint8)
    with np.errstate(over="ignore"):
        return mix(hashes(raw, np.array([0]), np.array([len(raw)])) + _STEP)[0] if len(raw) else _U(1)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """The words of blocks of (text, lang) rows, and the names of languages."""
    names: list[str] = []
    for b in arrow_rows(batches):
        buf, off = text_bytes(b.column(0))
        lang = b.column(1).fill_null(UNKNOWN).dictionary_encode()
        for name in lang.dictionary.to_pylist():
            if name not in names:
                names.append(name)
        number = np.array([names.index(x) for x in lang.dictionary.to_pylist()], np.int64)[lang.indices.to_numpy()]
        seeds = np.array([_seed(x) for x in names], np.uint64)
        for lo, hi in blocks(off):
            yield Words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], number[lo:hi], seeds), names


def _pairs(h: np.ndarray) -> np.ndarray:
    """64 bits of every two neighbours."""
    with np.errstate(over="ignore"):
        return mix(mix(h[:-1]) * _STEP + h[1:])


def _counted(keys: list[np.ndarray]) -> pa.RecordBatch:
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])


def _frequent(texts: DataFrame, words=None) -> np.ndarray:
    """Bit table of the frequent words, or of the frequent pairs of them."""

    def run(batches):
        keys, held = [], 0
        for w, _ in _read(batches):
            if words is None:
                own = w.hash
            else:
                fine = has_bit(words.value, w.hash)
                own = _pairs(w.hash)[w.linked[:-1] & fine[:-1] & fine[1:]]
            keys.append(own)
            held += len(own)
            if held >= 2 * HELD:
                yield _counted(keys)
                keys, held = [], 0
        if held:
            yield _counted(keys)

    counts = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    return bit_table(materialise(counts.select("key"), "collocations-frequent"), "key")


def _sequences(h: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word, 64 bits of the sequence from it, up to WIDTH words while
    they are linked; its length; and the positions in order of those bits."""
    length = np.ones(len(h), np.int64)
    key = mix(h.copy())
    go = np.ones(len(h), bool)
    with np.errstate(over="ignore"):
        for k in range(1, WIDTH):
            go[: len(h) - k + 1] &= linked[k - 1 :]
            go[len(h) - k :] = False
            at = np.flatnonzero(go)
            key[at] = mix(key[at] * _STEP + h[at + k])
            length[at] += 1
    return key, length, np.argsort(key, kind="stable")


def _edges(texts: DataFrame, words, pairs) -> DataFrame:
    """w1..w5, n, lang, word: how often a sequence starts in the task's texts,
    shorter ones at the ends.  Sequences of one word name language and word, with
    n = 0 if all occurrences begin longer ones; a row without words counts the
    language's other words."""
    columns = [*_WORDS, "n", "lang", "word"]

    def count(held: list[Words], names: list[str]) -> pa.RecordBatch:
        h = np.concatenate([w.hash for w in held])
        lang = np.concatenate([w.lang for w in held])
        linked = np.concatenate([w.linked for w in held])
        fine = has_bit(words.value, h)
        linked[:-1] &= fine[:-1] & fine[1:]
        near = np.flatnonzero(linked[:-1])
        linked[near] = has_bit(pairs.value, _pairs(h)[near])
        key, length, order = _sequences(h, linked)

        order = order[length[order] > 1]
        new = np.ones(len(order), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        for k in range(WIDTH):  # equal bits, but other words: told apart, if they stand beside each other
            other = np.zeros(max(0, len(order) - 1), bool)
            both = (length[order[1:]] > k) & (length[order[:-1]] > k)
            other[both] = h[order[1:][both] + k] != h[order[:-1][both] + k]
            new[1:] |= other | ((length[order[1:]] > k) != (length[order[:-1]] > k))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(order)))
        at = order[first]
        cols = [np.zeros(len(at), np.uint64) for _ in range(WIDTH)]
        for k in range(WIDTH):
            some = length[at] > k
            cols[k][some] = h[at[some] + k]
        masks = [length[at] <= k for k in range(WIDTH)]

        # single words, and the number of the others
        single, where, of = np.unique(h[fine], return_index=True, return_inverse=True)
        place = np.flatnonzero(fine)[where]
        alone = np.bincount(of, weights=(length[fine] == 1), minlength=len(single)).astype(np.int64)
        begins = np.cumsum([0, *(len(w.hash) for w in held)])
        block = np.searchsorted(begins, place, side="right") - 1
        spelled = [held[b].text(p - begins[b]) for b, p in zip(block.tolist(), place.tolist())]
        rest = np.bincount(lang[~fine], minlength=len(names))
        some = np.flatnonzero(rest)

        empty = np.zeros(len(single) + len(some), np.uint64)
        ones = empty.copy()
        ones[: len(single)] = single
        arrays = []
        for k in range(WIDTH):
            tail_mask = np.ones(len(empty), bool)
            if k == 0:
                tail_mask[: len(single)] = False
            arrays.append(pa.array(np.concatenate((cols[k], ones if k == 0 else empty)).view(np.int64), mask=np.concatenate((masks[k], tail_mask))))
        arrays.append(pa.array(np.concatenate((n, alone, rest[some]))))
        arrays.append(pa.array([None] * len(at) + [names[x] for x in lang[place]] + [names[x] for x in some], pa.string()))
        arrays.append(pa.array([None] * len(at) + spelled + [None] * len(some), pa.string()))
        return pa.RecordBatch.from_arrays(arrays, columns)

    def run(batches):
        held, size, names = [], 0, []
        for w, names in _read(batches):
            held.append(w)
            size += len(w.hash)
            if size >= HELD:
                yield count(held, names)
                held, size = [], 0
        if size:
            yield count(held, names)

    return texts.mapInArrow(run, ", ".join(f"{w} long" for w in _WORDS) + ", n long, lang string, word string")


def _flows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, f, lang, word) of all frequent sequences of one to WIDTH words, and
    (lang, total).  Each length's counts are the flow of the next longer ones,
    plus the corrections of that length."""
    edges = materialise(rows.where("w2 is not null").groupBy(*_WORDS).agg(F.sum("n").alias("f")), "collocations-edges")
    flow, found = edges.where("w5 is not null"), []
    for k in range(WIDTH, 1, -1):
        own = _WORDS[:k]
        if k < WIDTH:
            ends = edges.where(f"w{k} is not null and w{k + 1} is null")
            flow = flow.select(*own, "f").union(ends.select(*own, "f")).groupBy(*own).agg(F.sum("f").alias("f"))
            flow = materialise(flow, f"collocations-flow-{k}")
        found.append(flow.where(F.col("f") >= LEAST).select(F.array(*own).alias("gram"), "f", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word")))
    alone = rows.where("w2 is null and w1 is not null").select("w1", F.col("n").alias("f"), "lang", "word")
    single = flow.select("w1", "f", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word")).union(alone)
    single = materialise(single.groupBy("w1").agg(F.sum("f").alias("f"), F.max("lang").alias("lang"), F.max("word").alias("word")), "collocations-flow-1")
    found.append(single.select(F.array("w1").alias("gram"), "f", "lang", "word"))
    totals = single.select("lang", "f").union(rows.where("w1 is null").select("lang", "n")).groupBy("lang").agg(F.sum("f").alias("total"))
    grams = found[0]
    for f in found[1:]:
        grams = grams.union(f)
    return materialise(grams, "collocations-grams"), totals


def _slices(gram: str, width: int) -> Column:
    """SQL: every ``width`` consecutive members of an array."""
    return F.expr(f"transform(sequence(1, size({gram}) - {width - 1}), i -> slice({gram}, i, {width}))")


def compacted(grams: DataFrame) -> DataFrame:
    """gram, f: the unary paths of the frequent edges, each edge in one path.
    All edges of a path have its weight."""
    edges = grams.where(F.size("gram") == WIDTH).select("gram", "f")
    nodes = grams.where(F.size("gram") == WIDTH - 1).select(F.col("gram").alias("node"), "f")
    # every occurrence of the node comes by the one edge and goes by the other
    into = edges.select(F.slice("gram", 2, WIDTH - 1).alias("node"), "f", F.col("gram").alias("up"))
    out = edges.select(F.slice("gram", 1, WIDTH - 1).alias("node"), "f", "gram")
    links = out.join(nodes, ["node", "f"]).join(into, ["node", "f"]).select("gram", "up")
    state = edges.join(links, "gram", "left")
    state = state.select("gram", "f", F.coalesce("up", "gram").alias("up"), F.col("up").isNotNull().cast("long").alias("far"))
    state = materialise(state, "collocations-pointers")
    while True:  # the longest path's logarithm
        above = state.select(F.col("gram").alias("up"), F.col("up").alias("top"), F.col("far").alias("more"))
        state = state.join(above, "up").select("gram", "f", F.col("top").alias("up"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("moved"))
        state = materialise(state, "collocations-pointers")
        if state.where("moved").isEmpty():
            break
    tail = F.array_sort(F.collect_list(F.struct("far", F.col("gram")[WIDTH - 1].alias("last"))))
    paths = state.groupBy("up", "f").agg(tail.alias("tail"))
    return materialise(paths.select(F.concat(F.slice("up", 1, WIDTH - 1), F.expr("transform(tail, x -> x.last)")).alias("gram"), "f"), "collocations-paths")


def _candidates(grams: DataFrame, paths: DataFrame) -> DataFrame:
    """gram, f of the candidates that no longer one swallows.  What contains a
    candidate has its count only if the sequence of one word more does."""
    pieces = [paths.select(F.explode(_slices("gram", WIDTH)).alias("gram"), "f")]
    for k in range(WIDTH - 1, 1, -1):
        longer = paths if k == WIDTH - 1 else grams.where(F.size("gram") == k + 1)
        swallowed = longer.select(F.explode(_slices("gram", k)).alias("gram"), "f").distinct()
        pieces.append(grams.where(F.size("gram") == k).select("gram", "f").join(swallowed, ["gram", "f"], "left_anti"))
    found = pieces[0]
    for p in pieces[1:]:
        found = found.union(p)
    return found


def _scored(candidates: DataFrame, grams: DataFrame, totals: DataFrame) -> DataFrame:
    """gram, lang, a, l, r, n, score by the lowest cut."""
    cuts = candidates.select("gram", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(gram) - 1)")).alias("k"))
    cuts = cuts.select("gram", "a", "k", F.expr("slice(gram, 1, k)").alias("head"), F.expr("slice(gram, k + 1, size(gram) - k)").alias("rest"))
    left = grams.select(F.col("gram").alias("head"), F.col("f").alias("l"), "lang")
    right = grams.select(F.col("gram").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, "head").join(right, "rest")
    whole = cuts.groupBy("gram", "a").agg(F.max("lang").alias("lang"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    whole = whole.join(totals.withColumnRenamed("total", "n"), "lang")
    big = lambda c: F.col(c).cast("decimal(20,0)")
    whole = whole.withColumn("top", (big("a") * big("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"))
    whole = whole.withColumn("best", F.expr("array_min(transform(cuts, c -> struct(cast(top div (cast(c.l as decimal(19,0)) * cast(c.r as decimal(19,0))) as long) as score, c.k as k, c.l as l, c.r as r)))"))
    return whole.select("gram", "lang", "a", "best.l", "best.r", "n", "best.score")


def _phrases(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """Adds phrase: the words of each gram."""
    words = rows.select("gram", F.posexplode("gram").alias("at", "w"))
    known = grams.where(F.size("gram") == 1).select(F.col("gram")[0].alias("w"), "word")
    spelled = words.join(known, "w").groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    return rows.join(spelled.select("gram", F.expr("array_join(transform(spelled, x -> x.word), ' ')").alias("phrase")), "gram")


def _graph(docs: DataFrame, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    spark = prepared(docs)
    texts = docs.select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).where("text is not null")
    words = spark.sparkContext.broadcast(_frequent(texts))
    pairs = spark.sparkContext.broadcast(_frequent(texts, words))
    return _flows(materialise(_edges(texts, words, pairs), "collocations-starts"))


def passages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, a: the compacted paths in words: passages of five words or
    more, all of whose parts of five occur ``a`` times."""
    grams, _ = _graph(docs, text_col, lang_col)
    paths = compacted(grams)
    lang = grams.where(F.size("gram") == 1).select(F.col("gram")[0].alias("w"), "lang")
    rows = paths.withColumn("w", F.col("gram")[0]).join(lang, "w").select("gram", "lang", F.col("f").alias("a"))
    return _phrases(rows, grams).select("lang", "phrase", "a")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases."""
    grams, totals = _graph(docs, text_col, lang_col)
    found = _scored(_candidates(grams, compacted(grams)), grams, materialise(totals, "collocations-totals"))
    # ties of the last place need the words to be told apart
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    found = materialise(found.withColumn("rank", F.rank().over(near)).where(F.col("rank") <= first).drop("rank"), "collocations-first")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = _phrases(found, grams).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


_GRAMS = "\n  UNION ALL ".join(f"SELECT lang, ws[i:i + {k - 1}] AS gram FROM starts WHERE i + {k - 1} <= len(ws)" for k in range(1, WIDTH + 1))

ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), sequences AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces
), starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM sequences
), every AS (
  {_GRAMS}
), counted AS (
  SELECT lang, gram, count(*) AS f FROM every GROUP BY lang, gram
), sums AS (
  SELECT lang, sum(f)::HUGEINT AS n FROM counted WHERE len(gram) = 1 GROUP BY lang
), frequent AS (
  SELECT * FROM counted WHERE f >= {LEAST} AND len(gram) > 1
), parts AS (
  SELECT f.lang, f.gram, f.f, unnest(range(1, len(f.gram))) AS width FROM frequent f
), inner_ones AS (
  SELECT lang, f, gram, width, unnest(range(1, len(gram) - width + 2)) AS i FROM parts
), swallowed AS (
  SELECT DISTINCT lang, gram[i:i + width - 1] AS gram, f FROM inner_ones
), candidates AS (
  SELECT f.* FROM frequent f ANTI JOIN swallowed s ON f.lang = s.lang AND f.gram = s.gram AND f.f <= s.f
), cuts AS (
  SELECT c.lang, c.gram, c.f AS a, unnest(range(1, len(c.gram))) AS k FROM candidates c
), scored AS (
  SELECT c.lang, c.gram, c.a, c.k, l.f AS l, r.f AS r, s.n, (1000 * c.a::HUGEINT * s.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN counted l ON l.lang = c.lang AND l.gram = c.gram[1:c.k]
  JOIN counted r ON r.lang = c.lang AND r.gram = c.gram[c.k + 1:] JOIN sums s ON s.lang = c.lang
), lowest AS (
  SELECT lang, array_to_string(gram, ' ') AS phrase, a, l, r, n, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {FIRST}
"""
