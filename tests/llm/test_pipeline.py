"""The corpus pipeline, stage by stage, against brute force."""

import corpus_pipeline
from pyspark.sql import functions as F

from shelfspark.llm import mixing
from tests.llm.test_operators import SF, brute_components, brute_contamination


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "?! 12", "en", "s", 0)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs.unionByName(extra), SF)
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    unique = stages["ngram_jaccard"](spark, docs, SF)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(k for k, (_, c) in brute_components(rows).items() if k == c)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages["decontaminate"](spark, docs, SF)
    hits = {k: brute_contamination(t, items) for k, t in rows}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(k for k, (n, h, _, _) in hits.items() if not (h and 20 * h >= n))

    mixed = stages["mix"](spark, docs, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(k for k, n in copies.items() for _ in range(n))

    sharded = stages["shard"](spark, docs, SF)
    assert sorted(r.doc_id for r in sharded.collect()) == sorted(k for k, _ in rows) and "shard" in sharded.columns
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_repeated_rows_keep_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    once = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    twice = corpus_pipeline.keep_one_of_each_group(spark, docs.unionByName(docs), SF)
    assert sorted(r.doc_id for r in once.collect()) == sorted(r.doc_id for r in twice.collect())


def test_stages_on_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = [(None, None, None, None, None), (5000, "", "en", "s", 0), (5001, "word " * 40_000, "en", None, 1), (None, "no id but some words", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd + [odd[2]], docs.schema))
    docs = docs.withColumns({c: F.lit(c) for c in ("row", "key", "number", "h", "items", "n_words", "copies", "size", "set_digest", "_id", "Score")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        own = [c for c in out.columns if c != "shard"]
        assert set(own) == set(docs.columns), name
        rows, every = [str(r) for r in out.select(docs.columns).collect()], {str(r) for r in docs.collect()}
        assert rows and set(rows) <= every, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
