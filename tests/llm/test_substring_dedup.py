"""Removal of passages that smaller ids hold: brute force over all windows, chunk and piece borders, awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import recompress, substring_dedup


def brute(rows, window):
    low = {}
    for i, text in rows:
        words = (text or "").split()
        for k in range(len(words) - window + 1):
            passage = tuple(words[k : k + window])
            held = low.setdefault(passage, i)
            low[passage] = i if held is None or (i is not None and i < held) else held
    out = []
    for i, text in rows:
        words, gone = (text or "").split(), set()
        for k in range(len(words) - window + 1):
            first = low[tuple(words[k : k + window])]
            if first is not None and (i is None or first < i):
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def found(spark, rows, window=50):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substring_dedup.remove_repeats(df, window=window).select("doc_id", "n_words", "n_removed", "kept_text", "removed").collect()
    assert all(r.n_removed == sum(s.end - s.start for s in r.removed) for r in out)
    return sorted((tuple(r[:4]) for r in out), key=str)


@pytest.mark.parametrize("window, vocabulary", [(50, 200), (50, 4), (20, 50), (12, 3), (5, 2)])
def test_against_all_windows(spark, window, vocabulary):
    rnd = random.Random(window + vocabulary)
    word = lambda: f"w{rnd.randrange(vocabulary)}"
    base = [[word() for _ in range(rnd.randrange(400))] for _ in range(12)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rnd.randrange(4)):
            passage = rnd.choice(base)
            at = rnd.randrange(len(passage) + 1)
            parts += passage[at : at + rnd.randrange(150)]
            if rnd.random() < 0.5:
                parts += [word() for _ in range(rnd.randrange(30))]
            if parts and rnd.random() < 0.5:
                parts[rnd.randrange(len(parts))] = "edit"
        rows.append((rnd.choice([k, k, k, None, rnd.randrange(60)]), rnd.choice([" ", "\n", "\t "]).join(parts) if k % 9 else None))
    rows += rows[:5]
    assert found(spark, rows, window) == brute(rows, window)


def test_long_texts_cross_chunks(spark):
    rnd = random.Random(3)
    words = [f"t{rnd.randrange(50_000)}" for _ in range(300_000)]
    n = recompress.CHUNK_WORDS
    rows = [(1, " ".join(words)), (2, " ".join(["x"] * 30 + words[n - 70 : n + 90] + ["y"])), (3, " ".join(words[n - 40 : n + 9])), (None, " ".join(words[2 * n - 1000 :]))]
    assert found(spark, rows) == brute(rows, 50)


def test_one_word_repeated_and_words_of_any_length(spark):
    long_word = "ab" * (recompress.PIECE_BYTES * 2)
    rows = [(5, "same " * 200), (2, "same " * 49), (9, "same " * 120 + "other"), (7, f"{'k ' * 60}{long_word}{' k' * 60}"), (8, f"{'k ' * 30}{long_word}{' k' * 30}")]
    assert found(spark, rows) == brute(rows, 50)


def test_equal_windows_have_equal_anchors():
    rnd = np.random.default_rng(1)
    names = rnd.integers(1, 9, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    place, level, symbol = recompress.anchors(names, 50)
    for at in rnd.integers(0, 4900, 200):
        cut = np.concatenate((names[:7], names[at : at + 60], names[:3]))
        p, r, s = recompress.anchors(cut, 50)
        assert (p[7:18] - 7 == place[at : at + 11] - at).all() and (r[7:18] == level[at : at + 11]).all() and (s[7:18] == symbol[at : at + 11]).all()
    assert (level[:4951] > 0).mean() > 0.9


def test_awkward_rows_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (None, None), (4, "a b"), (6, "Ünïcode 東京 " * 40), (7, "Ünïcode 東京 " * 40)]
    clashes = ["id", "hash", "row", "block", "blocks", "symbol", "name", "any", "low", "_id", "N_words", "kept_text", "removed"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in clashes})
    out = substring_dedup.remove_repeats(df)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and {"id", "hash", "row", "_id"} <= set(out.columns)
    assert sorted(map(str, out.select("doc_id", "n_words", "n_removed").collect())) == sorted(
        f"Row(doc_id={i}, n_words={len((t or '').split())}, n_removed={80 if i == 7 else 0})" for i, t in rows
    )
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0
    strings = spark.createDataFrame([("b", "q " * 60), ("a", "q " * 60)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(strings).collect()} == {"a": 0, "b": 60}
