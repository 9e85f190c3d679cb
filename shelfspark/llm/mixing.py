"""Mixing sources to target weights.

Tokens are summed per source, the target shares give each source a repetition
rate, and each document is emitted floor(rate) times plus one hash-seeded
Bernoulli copy whose probability is the rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, semi, small_enough, write_table

#: Words are separated by ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Target size per source: columns ``source``, ``source_size``, ``target``.

    ``sizes`` has one row per (part of a) source: ``source``, ``source_size``.  Sources sorted by code
    point, null last, take ``weights`` in turn and share all sizes; no target exceeds ``most`` times its
    source's size, and what is cut off is shared anew by weight until no target is above.

    The ranks come from a range-partitioned sort with per-partition offsets and the water level from one
    aggregate per round, so any number of sources stays distributed.
    """
    per = sizes.groupBy("source").agg(F.sum("source_size").alias("source_size"))
    parts = write_table(per.orderBy(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(within) - 1 + F.col("_offset")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = parts.join(F.broadcast(offsets), "_part").select(
        "source", "source_size", F.element_at(turn, (rank % len(weights) + 1).cast("int")).alias("_weight")
    )
    ranked = write_table(ranked, "source-weights")
    cap = F.lit(float(most)) * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        over = cap <= F.lit(level) * F.col("_weight")
        row = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum("_weight").alias("weight"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("cut"),
            F.coalesce(F.sum(F.when(over, F.col("_weight"))), F.lit(0.0)).alias("gone"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if not row.total or row.n == capped or row.weight <= row.gone:
            break
        level, capped = (row.total - row.cut) / (row.weight - row.gone), row.n
    return ranked.select("source", "source_size", F.least(cap, F.lit(level) * F.col("_weight")).alias("target"))


def uniform_hash(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of the seed and the keys that are not null."""
    key = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def numbered_repeats(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Add ``number``: 1, 2, ... for the rows that share a ``key``, in no particular order.

    Only rows whose key occurs more than once are written and numbered: per task of that table, plus the
    counts of the tasks before it, so a key with any share of the rows loads no single task.
    """
    repeated = write_table(rows.groupBy(key).count().filter("count > 1").select(key), "repeated-keys")
    if repeated.isEmpty():
        drop_table(repeated)
        return rows.withColumn(number, F.lit(1).cast("long"))
    alone = semi(rows, repeated, key, "left_anti").withColumn(number, F.lit(1).cast("long"))
    several = semi(rows, repeated, key)
    several = write_table(several.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("at")), "repeated-rows")
    task = F.shiftright("at", 33)  # the task that wrote the row
    counts = several.groupBy("key", task.alias("task")).count()
    before = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("key", "task").orderBy("at"))
    placed = several.withColumn("task", task).withColumn("inside", inside).join(offsets, ["key", "task"])
    return alone.unionByName(placed.select("row.*", (F.col("inside") + F.col("offset")).alias(number)))


def mix_sources(
    df: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: Sequence[float] = (1, 2, 3),
    most: float = 3.0,
    seed: str = "mix-1",
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` to every row.

    ``copies`` is how often the mix takes the document and ``taken`` its words in the mix.  The draw of a row depends on
    its id, its text and, where several rows have the same id, text and source, on a number among
    them, so rows with repeated or null ids draw one by one and sources of such rows come near their targets, too.
    Reruns give the same rows; which of several equal rows gets which draw may differ.  Null or empty texts have
    size 0; a null source is a source of its own.  An empty table stays empty; texts of any length are counted whole; other columns
    pass through whatever their names, but those of the five added ones.
    """
    names = ["size", "source_size", "target", "copies", "taken"]
    base = df.drop(*[c for c in df.columns if c.lower() in names])
    text, source, doc = F.col(text_col), F.col(source_col), F.col(id_col)
    sized = base.select(
        F.struct("*").alias("row"), doc.alias("id"), source.alias("source"), F.md5(text).alias("digest"), word_count(text).alias("size"),
        F.xxhash64(doc, text, source, doc.isNull(), text.isNull(), source.isNull()).alias("key"),
    )
    totals = base.select(source.alias("source"), word_count(text).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = source_targets(totals, weights, most).select(F.col("source").alias("rate_source"), "source_size", "target")
    if small_enough(rates):
        rates = F.broadcast(rates)
    numbered = numbered_repeats(sized, "key", "number")
    joined = numbered.join(rates, numbered["source"].eqNullSafe(rates["rate_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = uniform_hash(seed, F.col("id"), F.col("digest"), F.col("number"))
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    drawn = joined.select("row", "size", "source_size", "target", copies.alias("copies"))
    return drawn.select("row.*", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each row of :func:`mix_sources` as often as its ``copies`` say."""
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.filter("copies > 0").select(F.struct("*").alias("row"), times.alias("time")).select("row.*")
