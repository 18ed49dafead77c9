"""Language identification (operator 6).

Multinomial logistic regression on TF-IDF character n-grams (one to three
characters, hashed to 2^15 features), trained with follow-the-regularised-
leader under an elastic-net penalty, then calibrated by one temperature.

* Document frequencies count every training document, by partial vectors of
  fixed size that are summed per feature.
* The classifier is fitted on a sample of training rows, SAMPLE_PER_LABEL each
  at most in expectation, chosen by a hash of the id; their sparse vectors (at
  most SAMPLE documents) are the only rows that reach the driver.  Labels beyond
  the SAMPLE // 10 most frequent are not learned, so never predicted.
* The temperature minimises the log loss on rows of the sample that the fit
  has not seen.
* Scores say nothing about languages that were not learned, so ``accepted`` asks
  for two bounds fitted on the same rows: the score that all but a thousandth of
  the right predictions reach, and the share of unknown n-grams (in a RARE part
  of the training documents at most) that all but a thousandth of the texts stay
  below; both with a margin, the second with room for the chance of short texts.
* Prediction reads whole texts; lang, source and doc_id play no part in it.

Cases: null text or no letter: ``und``, score 0; null lang: not learned from,
but predicted; no training rows at all: ``und``, score 0; one label: that
label; long texts are read in pieces of bounded size; repeated rows give
repeated results; empty table: no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import arrow_rows, blocks, prepared, read_table, text_bytes, whole_row
from marketlens.llm.shingles import mix

FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
#: Rows of a label, and of all labels, that the classifier is fitted on.
SAMPLE_PER_LABEL = 600
SAMPLE = 4000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: An n-gram is unknown if at most this part of the training documents hold it.
RARE = 2e-5
#: Part of the unseen rows beyond each of ``accepted``'s bounds, before the
#: margins: odds of the score divided, share of unknown n-grams multiplied.
BEYOND, ODDS_MARGIN, SHARE_MARGIN = 0.001, 4.0, 2.0
#: The greatest bound on the score; the least share that is let through; room in
#: standard deviations and n-grams.
MOST_SCORE, LEAST_SHARE, ROOM, FEW = 0.5, 0.01, 4.0, 2
#: Code points of a text that are turned into n-grams at a time.
PIECE = 1 << 20

def _lettered(text: str) -> bool:
    return any(c.isalpha() for c in text)
_U = np.uint64


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in a lower-cased text."""
    out = np.zeros(FEATURES, np.int64)
    low = text.lower()
    for k in range(0, max(1, len(low)), PIECE):  # overlapping by two, so no n-gram is lost
        c = np.frombuffer(low[k : k + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        own = min(PIECE, len(c))
        with np.errstate(over="ignore"):
            one = c + _U(1)
            two = one[:-1] * _U(0x110003) + one[1:] if len(c) > 1 else one[:0]
            three = two[:-1] * _U(0x110003) + one[2:] if len(c) > 2 else one[:0]
            for grams, salt in ((one, 11), (two, 22), (three, 33)):
                h = ((grams[:own] + _U(salt)) * _U(0x9E3779B97F4A7C15)) >> _U(64 - FEATURE_BITS)
                out += np.bincount(h.astype(np.int64), minlength=FEATURES)
    return out


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights: (1 + ln tf) * idf, of length one."""
    return weighted(counts(text), idf)


def weighted(tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(tf)
    w = (1 + np.log(tf[at])) * idf[at]
    norm = np.sqrt((w * w).sum())
    return at, w / norm if norm else w


def _remainder(doc_id: Column, by: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % by


def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with text in ``train`` (column text), and how many of them
    hold each feature."""

    def run(batches):
        have, n = np.zeros(FEATURES, np.int64), 0
        for b in arrow_rows(batches):
            _, off = text_bytes(b.column(0))
            for lo, hi in blocks(off):
                for t in b.column(0).slice(lo, hi - lo).to_pylist():
                    if t:
                        have += counts(t) > 0
                        n += 1
        full = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1), pa.int32()), pa.array(np.append(have[full], n))], ["feature", "n"])

    df = train.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    have, n = np.zeros(FEATURES), 0
    for r in df.collect():  # FEATURES + 1 rows at most
        if r["feature"] < 0:
            n = r["n"]
        else:
            have[r["feature"]] = r["n"]
    return n, have


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and intercepts by FTRL-proximal, one
    pass over the rows per epoch, in an order fixed by a seed."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weights(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search."""

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean()

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    """What prediction needs; its size is fixed by FEATURES and the labels."""

    def __init__(self, labels: list[str], idf: np.ndarray, w: np.ndarray, b: np.ndarray, temperature: float, unknown: np.ndarray | None = None, share: float = 1.0, least: float = 0.0):
        self.labels, self.idf, self.w, self.b, self.temperature = labels, idf, w, b, temperature
        self.unknown, self.share, self.least = np.zeros(FEATURES, bool) if unknown is None else unknown, share, least

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Label, score, and whether the text is in a learned language."""
        if not text or not self.labels or not _lettered(text):
            return "und", 0.0, False
        tf = counts(text)
        at, x = weighted(tf, self.idf)
        p = _softmax((x @ self.w[at] + self.b) / self.temperature)
        k = int(np.argmax(p))
        held = tf[at]
        fine = p[k] >= self.least and held[self.unknown[at]].sum() <= allowed(self.share, held.sum())
        return self.labels[k], float(p[k]), bool(fine)


def allowed(share: float, n: np.ndarray | float) -> np.ndarray | float:
    """Unknown n-grams that may be among ``n``."""
    return share * n + ROOM * np.sqrt(share * n) + FEW


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Learns from the rows of ``docs`` that have a label and a letter in
    their text; all of them must be free to learn from."""
    prepared(docs)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[label_col].alias("lang")).where("lang is not null and text is not null")
    per = {r["lang"]: r["count"] for r in src.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE // 10).collect()}
    labels = sorted(per)
    if not labels:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    n, have = document_frequencies(src)
    idf = np.log((1 + n) / (1 + have)) + 1
    unknown = have <= RARE * n
    want = min(SAMPLE_PER_LABEL, SAMPLE // len(labels))
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, want / per[k]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text")), F.lit(1 << 30)) / float(1 << 30)
    picked = src.where(draw < share[F.col("lang")])

    def run(batches):
        for b in arrow_rows(batches):
            ids, texts, langs = (c.to_pylist() for c in b.columns)
            out = []
            for i, t, k in zip(ids, texts, langs):
                if _lettered(t):
                    tf = counts(t)
                    out.append((k, t, zlib.crc32(str(i).encode()) % 4 == 3, tf[unknown].sum() / tf.sum(), *weighted(tf, idf)))
            if out:
                k, t, late, odd, at, x = zip(*out)
                key = [int(mix(np.array([zlib.crc32(v.encode())], np.uint64))[0] >> _U(1)) for v in t]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(late), pa.array(key), pa.array(odd, pa.float64()), pa.array(at, pa.list_(pa.int32())), pa.array([v.astype(np.float32) for v in x], pa.list_(pa.float32()))], ["lang", "late", "key", "odd", "at", "x"])

    rows = picked.mapInArrow(run, "lang string, late boolean, key long, odd double, at array<int>, x array<float>").limit(2 * SAMPLE).toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("key", "ascending")]).combine_chunks()
    # views of the sample's arrays: as Python numbers they would be ten times as large
    flat = {c: rows[c].chunk(0).values.to_numpy() if rows.num_rows else np.zeros(0) for c in ("at", "x")}
    ends = rows["at"].chunk(0).offsets.to_numpy() if rows.num_rows else np.zeros(1, int)
    sets: dict[bool, list] = {False: [], True: []}
    shares: dict[bool, list[float]] = {False: [], True: []}
    for i, (lang, late, odd) in enumerate(zip(rows["lang"].to_pylist(), rows["late"].to_pylist(), rows["odd"].to_pylist())):
        part = slice(ends[i], ends[i + 1])
        sets[late].append((flat["at"][part], flat["x"][part], labels.index(lang)))
        shares[late].append(odd)
    fit = sets[False] or sets[True]
    w, b = fit_ftrl(fit, len(labels))
    held = sets[True] or fit
    if not held:
        return Model(labels, idf, w, b, 1.0)
    logits, y = np.array([x @ w[at] + b for at, x, _ in held]), np.array([y for *_, y in held])
    temperature = fit_temperature(logits, y)
    p = _softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    low = float(np.quantile(right, BEYOND)) if len(right) else 0.0
    least = min(MOST_SCORE, low / (low + ODDS_MARGIN * (1 - low)))
    share = SHARE_MARGIN * float(np.quantile(shares[True] or shares[False], 1 - BEYOND))
    return Model(labels, idf, w, b, temperature, unknown, max(share, LEAST_SHARE), least)


def _predicted(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """row (all columns of ``docs``), lang_pred, score, learned."""
    cast = prepared(docs).sparkContext.broadcast(model)
    src = docs.select(whole_row(docs).alias("row"))
    out = src.schema["row"].dataType.simpleString()

    def run(batches):
        m = cast.value
        for b in arrow_rows(batches):
            texts = b.column(0).field(text_col)
            _, off = text_bytes(texts)
            for lo, hi in blocks(off):
                pred = [m.judge(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array([p[k] for p in pred]) for k in range(3)]], ["row", "lang_pred", "score", "learned"])

    return src.mapInArrow(run, f"row {out}, lang_pred string, score double, learned boolean")


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and lang_pred, score (these names, where
    ``docs`` has them, are replaced)."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    return _predicted(kept, model, text_col).select("row.*", "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are in a language which the model has learned,
    unchanged: with a letter, a score and known n-grams within the bounds that
    were fitted on unseen rows."""
    return _predicted(docs, model, text_col).where("learned").select("row.*")


def held_out(doc_id: Column) -> Column:
    return _remainder(doc_id, 4) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    src = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(src, model).select("doc_id", "held_out", "lang_pred", "score")
