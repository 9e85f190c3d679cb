"""The pipeline's near-duplicate stage where ids repeat or are null."""

import corpus_pipeline
from tests.llm.test_operators import SF

A, B, C, D = (" ".join(f"{k}{n}" for n in range(30)) for k in "abcd")


def kept(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    out = corpus_pipeline.keep_one_of_each_group(spark, docs.repartition(3), SF)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_different_texts_under_one_id_stay(spark):
    # 7 has a copy of 1 and a text of its own, 8 two texts of its own, one of them twice
    got = kept(spark, [(1, A), (7, A), (7, B), (8, C), (8, D), (8, D)])
    assert got == sorted([(1, A), (7, B), (8, C), (8, D)], key=str)


def test_copies_without_id_go(spark):
    # A has an id elsewhere, of B one row stays; a text without words is in no group
    got = kept(spark, [(None, A), (1, A), (None, B), (None, B), (None, B.upper()), (None, B + " more"), (None, None), (3, C), (3, "")])
    assert [x for x in got if x[1] == A] == [(1, A)]
    assert len([x for x in got if x[1] and x[1].lower().startswith("b")]) == 1
    assert [x for x in got if not x[1]] == sorted([(None, None), (3, "")], key=str) and (3, C) in got and len(got) == 5
