"""A language too rare for the sample of all languages."""

from shelfspark.llm import language_id


def test_every_trainable_label_is_known(spark, monkeypatch):
    monkeypatch.setattr(language_id.ByteGRU, "fit", lambda *_: None)
    rows = [(k, "the cat sat on the mat and looked at the moon " * 2, "xx" if k in (1000, 1001, 1002, 1003) else "en") for k in range(2000)]
    model = language_id.train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=10)
    assert model.labels == ["en", "xx"]
