"""The corpus pipeline: its stages' contracts, and its rows against the stages
run one after another with plain checks between them."""

import hashlib

import corpus_pipeline
from marketlens.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "secrets", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), f"test-{name}")
        if name != "byte_bpe":
            assert out.schema == docs.schema
        seen[name] = out
        docs = out
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert seen["language_id"].count() >= 0.98 * first.count()
    assert seen["ngram_jaccard"].count() < seen["language_id"].count()
    assert seen["secrets"].count() == seen["ngram_jaccard"].count()
    assert seen["secrets"].where("text rlike 'AKIA[A-Z0-9]{14}' or text rlike '[0-9a-f]{16}'").count() == 0
    mixed = {r.doc_id: r.text for r in seen["mixing"].collect()}
    for r in seen["byte_bpe"].collect():
        assert r.decoded_sha256 == hashlib.sha256(mixed[r.doc_id].encode()).hexdigest()
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == sorted(tuple(r) for r in seen["byte_bpe"].collect())


def test_empty(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
