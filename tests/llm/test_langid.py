import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitie.llm import langid as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return L.learn(docs)


def test_held_out_accuracy(docs, model):
    out = L.predict(docs, model, ["doc_id", "lang"]).withColumn("held", L.held_out())
    right, n = out.where("held and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.97
    held = {r.doc_id for r in out.where("held").select("doc_id").collect()}
    assert held == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_mixtures(docs, model):
    texts = {r.lang: r.text for r in docs.where("length(text) between 2000 and 6000").select("lang", "text").collect()}
    two = texts["en"][:1500] + " " + texts["de"][:1500]
    shares, score, fit = model.mixture(L.trigram_counts(two))
    assert set(shares) == {"en", "de"} and abs(shares["en"] - 0.5) < 0.15 and 0 < score < 1 and fit > 0
    assert list(model.mixture(L.trigram_counts(texts["fr"]))[0]) == ["fr"]


def test_pieces_do_not_change_counts(monkeypatch):
    text = "Ab cd, éfg\n\n12 hij " * 50
    whole = L.trigram_counts(text)
    monkeypatch.setattr(L, "PIECE", 7)
    assert (L.trigram_counts(text) == whole).all()
    assert L.trigram_counts("12 ..") is None and L.trigram_counts("") is None


def test_edge_rows(spark, docs, model):
    rows = [(None, None, "en", 1.0), (1, "", None, 1.0), (2, "123 !!", "de", 1.0), (3, "x", "en", 1.0), (3, "x", "en", 1.0), (4, "the and " * 20000, None, 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = [(r.doc_id, r.lang_pred, r.score) for r in L.predict(frame, model, ["doc_id"]).collect()]
    assert len(out) == 6 and all(0 <= s <= 1 for *_, s in out)
    assert {i for i, p, _ in out if p == "und"} == {None, 1, 2}
    assert ("en" in [p for i, p, _ in out if i == 4])
    empty = frame.limit(0)
    assert L.report(empty).count() == 0 and L.learn(empty).languages == []
    assert {r.lang_pred for r in L.predict(frame, L.learn(empty), ["doc_id"]).collect()} == {"und"}
    kept = L.in_learnt_language(docs)
    assert kept.columns == docs.columns and kept.count() > 990


def test_shares_of_equal_models():
    m = L.Model(["a", "b"], np.full((L.BUCKETS, 2), 1 / L.BUCKETS))
    assert list(m.mixture(L.trigram_counts("some text"))[0]) == ["a"]


def test_any_number_of_languages(spark, monkeypatch):
    rng = random.Random(6)
    words = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(12)] for i in range(150)}
    rows = [(i * 20 + j, " ".join(rng.choice(w) for _ in range(80)), lang) for i, (lang, w) in enumerate(words.items()) for j in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs)
    assert model.languages == sorted(words)
    table = np.full((L.BUCKETS, len(words)), L.SMOOTHING)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            table[:, model.languages.index(lang)] += L.trigram_counts(text)
    dense = L.Model(model.languages, table / table.sum(axis=0))
    assert (model.probabilities[np.arange(L.BUCKETS)] == dense.probabilities).all()
    out = {r.doc_id: r.lang_pred for r in L.report(docs).collect()}
    assert np.mean([out[i] == lang for i, _, lang in rows]) > 0.99 and L.in_learnt_language(docs).count() == len(rows)
    counts = L.trigram_counts(rows[3][1] + " " + rows[900][1])
    whole, score, fit = dense.mixture(counts)
    assert set(whole) == {rows[3][2], rows[900][2]} and model.mixture(counts) == (whole, score, fit)
    monkeypatch.setattr(L, "CELLS", 1000)
    parts, score_, fit_ = model.mixture(counts)
    assert list(parts) == list(whole) and np.allclose([*parts.values(), score_, fit_], [*whole.values(), score, fit])
