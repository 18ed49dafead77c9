"""Language ID: held-out accuracy, calibration and awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from marketlens.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.query(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_prediction_ignores_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    a = langid.predict(docs.select("doc_id", "text"), model).collect()
    b = langid.predict(docs.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit(9).alias("score")), model).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in a] == [(r.doc_id, r.lang_pred, r.score) for r in b]


def test_awkward_rows(docs, doc_rows, no_docs):
    model = langid.train(docs)
    assert model.labels == ["de", "en"]
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(doc_rows)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    kept = langid.accepted(docs, model)
    assert kept.schema == docs.schema
    assert {r.lang_pred for r in langid.predict(kept, model).collect()} <= {"de", "en"}
    none = langid.train(no_docs)
    assert none.labels == [] and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


def test_counts_of_a_long_text_equal_those_of_its_pieces(monkeypatch):
    text = "The quick brown fox, él niño. " * 40
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert (langid.counts(text) == whole).all()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    logits = rng.standard_normal((500, 3)) * 4
    logits[np.arange(500), y] += 3
    t = langid.fit_temperature(logits, y)
    loss = lambda s: -np.log(langid._softmax(logits / s)[np.arange(500), y]).mean()
    assert loss(t) <= min(loss(1.0), loss(t * 1.1), loss(t / 1.1)) + 1e-9


# Sentences in languages that the tables don't hold.
UNLEARNED = {
    "sv": "alla människor är födda fria och lika i värde och rättigheter de har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap var och en är berättigad till alla de rättigheter",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza ad ogni individuo spettano",
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства каждый человек должен обладать всеми правами",
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa każdy człowiek posiada wszystkie prawa",
}


def test_unlearned_languages_and_junk_go_and_clean_documents_stay(spark):
    import random

    rnd = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    strange = {}
    for lang, words in UNLEARNED.items():
        strange[lang] = [" ".join(rnd.choices(words.split(), k=rnd.randint(25, 120))) for _ in range(30)]
    strange["junk"] = ["".join(rnd.choice("bcdfghjklmnpqrstvwxz") if rnd.random() < 0.85 else " " for _ in range(rnd.randint(200, 900))) for _ in range(30)]
    strange["signs"] = ["".join(rnd.choice("äöÿøþðßæœłžč#@%&*") for _ in range(rnd.randint(100, 400))) for _ in range(30)]
    for kind, texts in strange.items():
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        assert langid.accepted(df, model).count() <= 0.1 * len(texts), kind
    clean = docs.where(langid.held_out(F.col("doc_id")))
    assert langid.accepted(clean, model).count() >= 0.99 * clean.where("text rlike '[A-Za-z]'").count()
