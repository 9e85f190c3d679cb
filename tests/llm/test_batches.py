"""Arrow batches of the pipeline's stages are bounded by bytes, so executors hold few texts at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from shelfspark.llm.common import BATCH_BYTES, bound_batches, map_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT = 1 << 19


def sizes(batches):
    for batch in batches:
        yield batch, [pa.array([batch.nbytes] * batch.num_rows, pa.int64())]


@pytest.mark.parametrize("stage", ["language_id", "ngram_jaccard", "decontaminate"])
def test_batches_are_bounded(spark, tmp_path, stage):
    few = spark.createDataFrame([(1, "the dog", "en", "a")], "doc_id long, text string, lang string, source string")
    spark.createDataFrame([("i", "a cat")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    many = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("a"), TEXT).alias("text"))
    before = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "64m")
        assert dict(corpus_pipeline.STAGES)[stage](spark, few, str(tmp_path)).count() == 1
        found = map_batches(many, sizes, [T.StructField("size", T.LongType())]).agg(F.count("*"), F.max("size")).first()
        assert found[0] == 40 and found[1] <= BATCH_BYTES + 2 * TEXT
        spark.conf.set(KEY, "1m")
        bound_batches(spark)
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.set(KEY, before)
