"""Language shares on planted mixtures, and accuracy on documents held out."""

import random

import pytest
from pyspark.sql import functions as F

from commentguard.llm.languages import fit_languages, mixtures, predict_languages
from commentguard.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return fit_languages(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_language_id"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and len(held) > 100
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_planted_mixture_has_both_languages(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 1500")
    first = {r.lang: r.text.split() for r in docs.groupBy("lang").agg(F.max("text").alias("text")).collect()}
    words = first["de"][:120] + first["es"][:60]
    random.Random(3).shuffle(words)
    shares = dict(mixtures([" ".join(words)], model)[0])
    assert set(shares) >= {"de", "es"} and abs(shares["de"] - 2 / 3) < 0.15
    for lang in ("de", "es", "en", "fr"):
        assert mixtures([" ".join(first[lang][-100:])], model)[0][0][0] == lang


def test_texts_in_a_batch_do_not_touch(model):
    texts = ["", "the and of that", "123 !!", "ΑΣ ς 日本", "que les des une", "İİ the"]
    together, alone = mixtures(texts, model), [mixtures([t], model)[0] for t in texts]
    assert [[x for x, _ in t] for t in together] == [[x for x, _ in t] for t in alone]
    assert all(abs(a - b) < 1e-6 for t, u in zip(together, alone, strict=True) for (_, a), (_, b) in zip(t, u, strict=True))


def test_nulls_and_empty_tables(spark, model):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "12 - ?", 3), (2, "the " * 20_000, 4)], "doc_id long, text string, score int")
    got = predict_languages(docs, model).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in got[:3]] == [(None, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0)]
    assert got[3].lang_pred == "en"
    nothing = fit_languages(docs.select("text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in predict_languages(docs, nothing).collect()} == {"und"}
    assert predict_languages(docs.limit(0), model).collect() == []
