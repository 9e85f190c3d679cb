"""Shards of arrivals that are larger than the target, concurrent writers, clean-up."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import sharding
from shelfspark.llm.common import shared_dir
from tests.llm.test_operators import documents


def noise(n, seed=0):
    """Text that does not compress."""
    rng = random.Random(seed)
    return "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n // 3))


def store_of(spark, target):
    return sharding.ShardStore(spark, f"{shared_dir(spark)}/large-{random.random()}", target)


def same(rows):
    return sorted((r.doc_id, r.text or "") for r in rows.select("doc_id", "text").collect())


def test_one_task_above_the_target(spark):
    docs = documents(spark).select("doc_id", "text").coalesce(1)
    probe = store_of(spark, 1 << 30)
    probe.append(docs)
    total = probe.manifest().agg(F.sum("bytes")).first()[0]
    store = store_of(spark, total // 7)
    out = sharding.shard_documents(docs, store.path, store.target_bytes)
    sizes = [r.bytes for r in store.manifest().collect()]
    assert 3 < len(sizes) < 12 and max(sizes) < 2 * store.target_bytes
    assert out.select("shard").distinct().count() == len(sizes) and same(out) == same(docs)


def test_long_texts_together(spark):
    rows = [(k, noise(50_000 if k < 20 else 10, k)) for k in range(400)] + [(400, None), (401, noise(500_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    store = store_of(spark, 120_000)
    out = sharding.shard_documents(docs, store.path, store.target_bytes)
    assert all(r.bytes < 240_000 or r.rows == 1 for r in store.manifest().collect())
    assert same(out) == sorted((k, t or "") for k, t in rows)


def test_two_writers(spark, monkeypatch):
    store, docs = store_of(spark, 1 << 20), documents(spark).select("doc_id", "text")
    store.append(docs.filter("doc_id % 3 = 0"))
    plain = store._commit

    def late(shards, version):
        # another writer commits first, once
        monkeypatch.setattr(store, "_commit", plain)
        sharding.ShardStore(spark, store.path).append(docs.filter("doc_id % 3 = 1"))
        return plain(shards, version)

    monkeypatch.setattr(store, "_commit", late)
    assert store.append(docs.filter("doc_id % 3 = 2")) == 3
    assert same(store.read()) == same(docs) and store.read(1).count() == docs.filter("doc_id % 3 = 0").count()
    # a compaction that another one has overtaken changes nothing
    gone = store.manifest().select("shard")
    assert store.compact() == 4
    with pytest.raises(RuntimeError, match="another writer"):
        store.publish(store.manifest().drop("created"), gone)
    assert same(store.read()) == same(docs)


def test_vacuum_leaves_what_is_not_committed(spark):
    store, docs = store_of(spark, 1 << 20), documents(spark).select("doc_id", "text")
    store.append(docs)
    docs.limit(3).write.parquet(f"{store.path}/shards/a-running")
    store.append(docs)
    store.compact()
    assert store.vacuum() == 2  # both arrivals, now merged
    pending = store._files("shards/a-running")
    store.publish(pending)
    assert store.read().count() == 2 * docs.count() + 3
    docs.limit(3).write.parquet(f"{store.path}/shards/a-lost")
    assert store.vacuum(orphan_seconds=-1) == 1


def test_awkward_rows_keep_every_column(spark):
    rows = [(None, None), (None, None), (1, ""), (1, "a"), (1, "a"), (2, noise(60_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("row", "to", "_run", "_shard", "at", "first", "Shard", "rows")})
    out = sharding.shard_documents(docs, store_of(spark, 1).path, 20_000)
    assert sorted(out.columns) == sorted([*[c for c in docs.columns if c != "Shard"], "shard"])
    kept = [c for c in docs.columns if c != "Shard"]
    assert sorted(map(str, out.select(kept).collect())) == sorted(map(str, docs.select(kept).collect()))
