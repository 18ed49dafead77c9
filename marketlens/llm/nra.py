"""Ranked lexical search without random access (operator 12).

Documents are indexed by the items' terms: each becomes one packed row of term
numbers and frequencies, whose sums give the collection's statistics.  Segments
of the packed rows hold, for each term, its postings sorted by impact, the
largest first.  For an item, NRA reads the lists of its terms sequentially and
in step, block by block:

* a document's lower score is the sum of the impacts read for it, its upper
  score adds the last impact read from every list that has not shown it yet;
* a document whose upper score falls below the tenth best lower score (or
  reaches it with a larger doc_id) is out, and once the last impacts of all
  lists together fall below it, so are all documents not met yet;
* reading goes on until every remaining document has equal scores, so that
  members, their order among ties, and scores are final.

A task goes through its segments in turn and keeps ten documents of each item,
whose tenth score prunes the next segments.  The tasks' lists meet in a ranking
window.  Nothing is dealt by term or item before, so frequent terms and groups
of copies are spread as the documents are.

Items go in blocks of bounded terms, each block with its own index, so what is
broadcast (the block's term hashes, weights and items) does not grow with the
table of items.  Terms are told apart by 64-bit hashes.

Cases: a null text has no terms and counts nowhere; items without terms, or
whose terms no document holds, have no rows; rows of items equal in item_id and
text are one item, those that differ in text are ranked each by itself; a null
doc_id comes last among equal scores; repeated rows of documents are documents
of their own; a very long text is one packed row; empty tables: no rows; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import arrow_rows, blocks, materialise, prepared, read_table, text_bytes
from marketlens.llm.terms import byte_set, hashes, runs

TOP = 10
#: Terms of a block of items, about.
BLOCK_TERMS = 1 << 17
#: Postings of a segment, about, and its documents at most.
POSTINGS, DOCUMENTS = 1 << 20, 1 << 15
#: Postings that the first read takes from a list; each further read doubles it.
READ = 64

# Digits, letters and everything beyond ASCII make up terms.
TERM_BYTES = byte_set(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (64 bits of id and text), item_id, terms (distinct hashes)."""
    src = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].alias("text")).where("text is not null").distinct()

    def run(batches):
        for b in arrow_rows(batches):
            buf, off = text_bytes(b.column(2))
            begin, stop, doc = runs(buf, off, TERM_BYTES)
            h = hashes(buf, begin, stop).view(np.int64)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)), pa.array(h))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["item", "item_id", "terms"])

    keyed = src.select(F.xxhash64(F.coalesce("item_id", F.lit(0)), F.col("item_id").isNull(), "text").alias("item"), "item_id", "text")
    return keyed.mapInArrow(run, "item long, item_id long, terms array<long>").where("size(terms) > 0")


def _packed(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms of the text), terms (numbers in the sorted vocabulary),
    tfs, of the documents that have a term of any kind."""

    def run(batches):
        known = vocabulary.value
        for b in arrow_rows(batches):
            buf, off = text_bytes(b.column(1))
            for lo, hi in blocks(off):
                part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                begin, stop, doc = runs(part, o, TERM_BYTES)
                h = hashes(part, begin, stop).view(np.int64)
                n = np.bincount(doc, minlength=hi - lo)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                key, tf = np.unique(doc[hit] * len(known) + at[hit], return_counts=True)
                doc, term = np.divmod(key, len(known))
                ends = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
                rows = pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents of ``n`` terms, in a collection of ``docs`` documents with
    ``total`` terms."""
    if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * docs // total for x in n], np.int64)
    return 10 + 90 * n * docs // total


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    """w of terms that ``df`` of ``docs`` documents hold."""
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Segment:
    """Impact-sorted lists of some documents.  Documents are numbered in order
    of doc_id, null last."""

    def __init__(self, rows: pa.Table, weight: np.ndarray, docs: int, total: int):
        rows = rows.combine_chunks().sort_by([("doc_id", "ascending")])
        self.ids = rows["doc_id"]
        m = lengths(rows["n"].to_numpy(), docs, total)
        terms, tfs = (rows[c].combine_chunks() for c in ("terms", "tfs"))
        doc = np.repeat(np.arange(len(rows)), np.diff(terms.offsets.to_numpy()))
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        some = np.flatnonzero(impact > 0)
        some = some[np.lexsort((doc[some], -impact[some], term[some]))]
        self.doc, self.impact, term = doc[some], impact[some], term[some]
        self.starts = np.searchsorted(term, np.arange(len(weight) + 1))
        self.size = len(rows)

    def best(self, terms: np.ndarray, least: int, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` best for a set of terms, equal scores
        by number, without those below ``least``."""
        lo, hi = self.starts[terms], self.starts[terms + 1]
        lo, hi = lo[hi > lo], hi[hi > lo]
        none = np.zeros(0, np.int64)
        if not len(lo) or self.impact[lo].sum() < least:
            return none, none
        lower = np.zeros(self.size, np.int64)
        shown = np.zeros((len(lo), self.size), bool)
        out = np.zeros(self.size, bool)
        at, last = lo.copy(), self.impact[lo].copy()
        alive: np.ndarray | None = None  # documents in question, once no other can enter
        take = READ
        while True:
            for t in range(len(lo)):
                if at[t] == hi[t]:
                    continue
                end = min(at[t] + take, hi[t])
                d, x = self.doc[at[t] : end], self.impact[at[t] : end]
                lower[d] += x  # a document is in a list once
                shown[t, d] = True
                at[t], last[t] = end, x[-1] if end < hi[t] else 0
            take *= 2
            met = np.flatnonzero((lower > 0) & ~out) if alive is None else alive
            low = lower[met]
            bar = int(last.sum())
            high = low + bar - (last[:, None] * shown[:, met]).sum(axis=0)
            # the k-th best lower score, equal ones by number
            if len(met) >= k:
                order = np.lexsort((met, -low))[k - 1]
                score, number = int(low[order]), int(met[order])
            else:
                score, number = 0, -1
            if score < least:
                score, number = least, self.size
            keep = (high > score) | ((high == score) & (met <= number))
            out[met[~keep]] = True  # upper scores only fall, the bound only rises
            if alive is not None or bar < score or bar == 0:
                alive = met[keep]
                if (low[keep] == high[keep]).all():
                    order = np.lexsort((alive, -lower[alive]))[:k]
                    alive = alive[order]
                    return alive, lower[alive]


def _ranked(packed: DataFrame, shared) -> DataFrame:
    """item, doc_id, score: the best documents of each task for each item."""

    def run(batches: Iterator[pa.RecordBatch]):
        weight, docs, total, items, terms = shared.value
        ids: list[list] = [[] for _ in items]
        scores: list[list] = [[] for _ in items]

        def search(rows: list[pa.RecordBatch]) -> None:
            part = Segment(pa.Table.from_batches(rows), weight, docs, total)
            for i, own in enumerate(terms):
                found, score = part.best(own, scores[i][-1] if len(scores[i]) == TOP else 1)
                if len(found):
                    ids[i] += part.ids.take(pa.array(found)).to_pylist()
                    scores[i] += score.tolist()
                    order = sorted(range(len(ids[i])), key=lambda j: (-scores[i][j], ids[i][j] is None, ids[i][j] or 0))[:TOP]
                    ids[i], scores[i] = [ids[i][j] for j in order], [scores[i][j] for j in order]

        held: list[pa.RecordBatch] = []
        postings = rows = 0
        for b in arrow_rows(batches):
            for lo in range(0, b.num_rows, DOCUMENTS // 8):
                part = b.slice(lo, DOCUMENTS // 8)
                held.append(part)
                postings += len(part.column(2).flatten())
                rows += part.num_rows
                if postings >= POSTINGS or rows + DOCUMENTS // 8 > DOCUMENTS:
                    search(held)
                    held, postings, rows = [], 0, 0
        if held:
            search(held)
        n = [len(x) for x in ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(items, n)), pa.array([x for own in ids for x in own], pa.int64()), pa.array([x for own in scores for x in own], pa.int64())],
            ["item", "doc_id", "score"],
        )

    return packed.mapInArrow(run, "item long, doc_id long, score long")


def _block(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item, doc_id, score for the items of one block (see BLOCK_TERMS)."""
    sc = docs.sparkSession.sparkContext
    own = items.select("item", "terms").toArrow().sort_by([("item", "ascending")])
    lists = own["terms"].combine_chunks()
    vocabulary, number = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    cuts = (lists.offsets.to_numpy() - lists.offsets[0].as_py())[1:-1]
    packed = materialise(_packed(docs, sc.broadcast(vocabulary)), "nra-packed")
    n_docs, total = packed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    held = packed.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row for each term of the block
    df = np.zeros(len(vocabulary), np.int64)
    df[held["term"].to_numpy()] = held["count"].to_numpy()
    return _ranked(packed, sc.broadcast((weights(df, n_docs), n_docs, total, own["item"].to_numpy(), np.split(number, cuts))))


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item."""
    prepared(docs)
    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[doc_text].alias("text"))
    known = materialise(_items(items, item_id, item_text), "nra-items")
    terms = known.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-terms // BLOCK_TERMS))
    found = None
    for k in range(n_blocks if terms else 0):
        block = _block(src, known.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k))
        found = block if found is None else found.union(block)
    if found is None:
        return known.selectExpr("item_id", "0 as rank", "0L as doc_id", "0L as score").limit(0)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
    return found.join(known.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, {_LOWERED} AS text FROM documents
), words AS (
  SELECT d, doc_id, unnest(regexp_extract_all(text, '{_TERM}')) AS term FROM docs
), sizes AS (
  SELECT d, count(*) AS n FROM words GROUP BY d
), whole AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes
), asked AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM benchmark
), postings AS (
  SELECT d, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), terms AS (
  SELECT term, floor(1000 * ln(CAST(2 * any_value(w.docs) + 2 AS DOUBLE) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole w GROUP BY term
), scored AS (
  SELECT a.item_id, a.text, p.d, p.doc_id, sum(t.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * s.n * w.docs) // w.total))))::BIGINT AS score
  FROM asked a JOIN postings p USING (term) JOIN terms t USING (term) JOIN sizes s ON s.d = p.d, whole w
  GROUP BY a.item_id, a.text, p.d, p.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
