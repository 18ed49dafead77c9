"""The corpus pipeline: stages over ``documents``, each written as Parquet and
reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, jaccard, langid, mixing, secrets
from marketlens.llm.common import materialise, read_table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in no learned language go (no letters, or score and
    known n-grams beyond bounds that unseen rows set)."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.accepted(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays."""
    return jaccard.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: secrets are replaced in the texts; documents stay."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its source's target takes it."""
    return mixing.mixed(docs, mixing.qualities(read_table(spark, sf_dir, "labels")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids and round trip of every document, as digests."""
    return bpe.encode_digests(docs, bpe.default_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("ngram_jaccard", deduplicate),
    ("secrets", redact),
    ("mixing", mix),
    ("byte_bpe", tokenise),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the
#: stages against plain versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}-{name}")
    return docs
