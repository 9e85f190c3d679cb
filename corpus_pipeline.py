"""A corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  Every stage but the last
returns the columns of ``documents``.

All stages read texts of any length whole, take nulls in any column, keep further columns, whatever their names, and
turn an empty table into an empty one.  What they do with repeated rows and ties stands with each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate, jaccard, language_id, mixing, sharding
from shelfspark.llm.common import bound_batches, drop_table, semi, shared_dir, write_table
from shelfspark.llm.queries import SHARD_BYTES


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` as the columns ``used`` and a struct of the others, so no column an operator adds can clash; and how to undo it."""
    others = [c for c in docs.columns if c not in used]
    packed = docs.select(*used, F.struct(F.lit(True).alias("any"), *others).alias("others"))
    return packed, [F.col(c) if c in used else F.col("others")[c].alias(c) for c in docs.columns]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: a null text or one without letters.

    Repeated rows go or stay together.  Where no row has a language to learn from, nothing is recognised and all go.
    """
    bound_batches(spark)
    model = language_id.train_language_model(docs)
    packed, columns = apart(docs, "text")
    named = language_id.identify_language(packed, model)
    return named.filter(F.col("lang_pred") != language_id.UNKNOWN).select(*columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest (id, set digest), null ids last.

    A row only goes if its own text's group keeps another row, also where ids repeat or are null.  Rows without
    words are in no group and stay.
    """
    bound_batches(spark)
    found = write_table(jaccard.jaccard_components(docs.select("doc_id", "text"), with_sets=True), "groups")
    # the id of a single row tells whether that row goes; only the others' rows need their digests
    per = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    unclear = write_table(per.filter("n > 1 or doc_id is null").select("doc_id"), "unclear-ids")
    if unclear.isEmpty():
        return semi(docs, found.filter("not stands").select("doc_id"), "doc_id", "left_anti")
    gone = found.filter("not stands").select("doc_id")
    clear = semi(semi(docs, unclear, "doc_id", "left_anti"), gone, "doc_id", "left_anti")
    packed, columns = apart(docs, "doc_id", "text")
    rest = jaccard.add_digests(semi(packed, unclear, "doc_id"))
    best = found.filter("stands and set_digest is not null").select(F.col("doc_id").alias("_id"), F.col("set_digest").alias("_digest")).distinct()
    won = rest.join(best, rest["doc_id"].eqNullSafe(best["_id"]) & (rest["set_digest"] == best["_digest"]))
    # rows of one id and one set: partial minima, so that many copies gather nowhere
    once = won.groupBy("_id", "_digest").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return clear.unionByName(rest.filter("set_digest is null").select(*columns)).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates; repeated rows go or stay together, an empty benchmark drops none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    packed, columns = apart(docs, "text")
    return decontaminate.find_contamination(packed, benchmark).filter("not contaminated").select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every document as often as its source's rate and its own draw say; repeated rows draw one by one."""
    packed, columns = apart(docs, "doc_id", "text", "source")
    return mixing.emit_copies(mixing.mix_sources(packed)).select(*columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as compacted shards; returns its rows, repeated ones included, as read from the committed version, with ``shard``."""
    return sharding.shard_documents(docs, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", SHARD_BYTES)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
    ("shard", shard),
]

#: A trained network decides the first stage, so SQL cannot express the rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read by the next stage, after which it goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done, docs = docs, write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_table(done)
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop_table(docs)
    return out
