"""Learned operators read whole texts: no seams, short texts, awkward training rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import language_id, toxicity

DOCS = "doc_id long, text string, lang string"


def trained(spark, rows, **more):
    return language_id.train_language_model(spark.createDataFrame(rows, DOCS), **more)


def words(seed, n, letters):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))


def test_short_texts_train_a_model(spark):
    rows = [(k, "der Hund" if k % 2 else "the dog", "de" if k % 2 else "en") for k in range(200)]
    model = trained(spark, rows)
    out = language_id.identify_language(spark.createDataFrame(rows, DOCS), model)
    assert out.filter("lang_pred = lang").count() == 200


def test_states_are_handed_over(monkeypatch):
    monkeypatch.setattr(language_id, "SEGMENT", 16)
    monkeypatch.setattr(language_id, "SEAM", 1e-6)
    model = language_id.ByteGRU(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (1, 16, 17, 100, 333, 64)]

    def unbroken(text):
        symbols = np.frombuffer(text, np.uint8).astype(np.int16)[:, None]
        return model.position_probabilities(symbols).mean(axis=(0, 2))

    want = np.array([unbroken(t) for t in texts])
    assert np.allclose(model.pooled(texts), want, atol=1e-5)
    monkeypatch.setattr(language_id, "LANES", 4)  # the longest texts now go through several blocks
    assert np.allclose(model.pooled(texts), want, atol=1e-5)


def test_letters_are_those_of_category_l(spark):
    model = trained(spark, [(1, "aaa", "x"), (2, "bbb", "y")])
    rows = [(k, t, None) for k, t in enumerate(["½ ² ③", "123 !?", "_", None, "", "é", "東", "ʰ"])]
    got = [r.lang_pred == "und" for r in language_id.identify_language(spark.createDataFrame(rows, DOCS), model).orderBy("doc_id").collect()]
    assert got == [True] * 5 + [False] * 3


def test_language_training_on_awkward_rows(spark):
    rows = [(1, words(1, 50, "abcd"), "x"), (2, words(2, 50, "wxyz"), "y"), (3, None, "x"), (4, "", "y"), (6, "abcd", None), (None, "abcd", "z")]
    rows += [(1, rows[0][1], "x")] * 3 + [(1, "wxyz wxyz", "y")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("q") for c in ("id", "label", "h", "k", "size", "before")})
    model = language_id.train_language_model(df)
    assert model.labels == ["x", "y"]  # a null id is not drawn
    assert language_id.train_language_model(df.limit(0)) is None
    assert language_id.train_language_model(df.filter("lang is null")) is None
    one = language_id.train_language_model(df.filter("lang = 'x'"))
    assert one.labels == ["x"] and one.pooled([b"anything"])[0].tolist() == pytest.approx([1.0])


def test_long_texts_are_used_whole_within_the_byte_bound(spark):
    rows = [(k, words(k, 300, "abcd" if k % 2 else "wxyz"), "x" if k % 2 else "y") for k in range(1, 12)]
    assert trained(spark, rows, most_bytes=10).labels == ["x", "y"]  # one whole text of each label


def test_toxic_spans_do_not_end_at_pieces(spark):
    model = toxicity.ToxicityModel()
    model.weights, model.bias, model.transitions = {"=bad": 3.0}, -2.0, np.array([[0.0, -2.0], [-2.0, 1.0]])
    text = " ".join(["fine"] * 40 + ["bad"] * 30 + ["fine"] * 5)
    rows = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(s.start, s.end) for s in rows[0].toxic_spans] == [(200, 200 + 30 * 4 - 1)]


def test_toxicity_training_on_awkward_rows(spark):
    docs = [(k, words(k, 20, "abcdef") + (" vilest" if k % 3 == 0 else ""), "q") for k in range(60)] + [(3, None, "q"), (3, "", "q"), (None, "x", "q")]
    docs += [docs[3]] * 3
    labels = [(k, int(k % 3 == 0)) for k in range(60)] + [(7, None), (None, 1), (9, 1), (9, 1), (8, 5), (4000, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, h string").withColumns({c: F.lit("q") for c in ("label", "id")})
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_toxicity_model(d, y)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(d.filter("doc_id is not null and length(text) > 0"), model).collect()}
    assert min(scores[k] for k in range(0, 60, 3)) > max(scores[k] for k in range(60) if k % 3)
    for a, b in ((d.limit(0), y), (d, y.limit(0)), (d, y.filter("toxic = 1")), (d, y.filter("toxic = 0"))):
        flat = toxicity.score_toxicity(d, toxicity.train_toxicity_model(a, b)).select("score").distinct().count()
        assert flat == 1
