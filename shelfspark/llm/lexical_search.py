"""Ranked lexical search over term-bucketed postings.

The postings are a table with a row for every term of every document, bucketed and sorted by term within the part of the
documents that a task has read.  So a search reads the row groups of its terms' buckets only, and the
postings of a document lie together, which lets the sums of scores be combined before they are shuffled.

A search joins the terms of its items with the postings, scores each match in 64-bit integers, adds the scores up
by item and document and keeps the first of each item by a window.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, drop_table, small_enough, tidy, write_table
from .decontaminate import PIECE_BYTES, WORD_BYTES

#: Terms after A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets of terms.
BUCKETS = 64
#: Documents of each item.
TOP = 10


def bucket_of(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def term_counts(text: bytes) -> Counter:
    """How often each term is in a text of any length."""
    raw, counts, at = text.translate(WORD_BYTES), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE_BYTES)
        end = len(raw) if end < 0 else end
        counts.update(raw[at:end].split())
        at = end
    return counts


def terms_of_items(items: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """``item_id``, ``term``, ``times``: how often each term is in an item.  Rows of one id are one item; null texts have no terms."""
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def build_postings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", terms: DataFrame | None = None) -> DataFrame:
    """The postings, a written table: ``bucket``, ``term``, ``row`` (of the table), ``id``, ``tf``, ``n`` (terms of the document).

    Each document has one more row, with a null ``term``.  ``terms`` (``term``) restricts the postings to terms that are
    wanted, before they leave the task that reads the document; where these are many, all terms are indexed.
    """
    wanted = None
    if terms is not None and small_enough(distinct := terms.select("term").distinct()):
        wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r.term.encode() for r in distinct.collect()))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("tf", T.LongType()), T.StructField("n", T.LongType())])

    def index(batches):
        import pyarrow as pa

        only = wanted.value if wanted else None
        for batch in batches:
            rows, terms, tf, n = [], [], [], []
            for row, text in enumerate(as_bytes(batch, "text")):
                counts = term_counts(text or b"")
                own = counts.keys() if only is None else counts.keys() & only
                terms.append(None)
                terms.extend(own)
                tf.append(0)
                tf.extend(map(counts.__getitem__, own))
                rows.extend([row] * (len(own) + 1))
                n.extend([counts.total()] * (len(own) + 1))
            at = pa.array(rows, pa.int64())
            texts = pa.array(terms, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts, batch.column(0).take(at), batch.column(1).take(at), pa.array(tf, pa.int64()), pa.array(n, pa.int64())], names=schema.names)

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    postings = read.mapInArrow(tidy(index), schema).select(bucket_of("term").alias("bucket"), *schema.names)
    return write_table(postings.sortWithinPartitions("bucket", "term", "row"), "postings")


def search(postings: DataFrame, terms: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` documents of each item with a score above 0, best first.

    ``terms`` comes from :func:`terms_of_items`.  Equal scores are ranked by ascending id, a null id last; of rows with
    equal ids any may come first, and each counts as a document.  Items without matches have no rows.

    A term in df of the N documents with terms weighs floor(1000 * ln((2 N + 2) / (2 df + 1))); its occurrences tf in a document of n terms
    multiply that by tf / (tf + 0.008 m) in integers of 10^-6, where m is 25 plus 75 times n over the mean.
    """
    stats = postings.filter("term is null").agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = stats.docs, max(1, stats.terms)
    buckets = [r[0] for r in terms.select(bucket_of("term").alias("b")).distinct().collect()]  # BUCKETS numbers at most
    held = postings.filter(F.col("bucket").isin(buckets) & F.col("term").isNotNull())
    names = terms.select("term").distinct()
    names = F.broadcast(names) if small_enough(names) else names
    df = held.join(names, "term").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = write_table(terms.join(df, "term").select("term", "item_id", (F.col("times") * weight).alias("weight")).filter("weight > 0"), "term-weights")
    part = F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * (25L + (75L * n * {n_docs}L) div {n_terms}L))")
    scored = held.select("term", "row", "id", part.alias("part")).join(F.broadcast(weights) if small_enough(weights) else weights, "term")
    sums = scored.groupBy("item_id", "row", "id").agg(F.sum(F.col("weight") * F.col("part")).alias("score")).filter("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    ranked = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    found = write_table(ranked.select("item_id", "rank", F.col("id").alias("doc_id"), "score"), "ranked")
    drop_table(weights)
    return found


def rank_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """:func:`search` of all ``docs`` for each of ``items``, in postings of the items' terms.

    Texts of any length are read whole; null and empty ones have no terms.  Either table may be empty, which gives no rows; other columns,
    whatever their names, are not looked at.
    """
    terms = write_table(terms_of_items(items, item_text_col, item_col), "item-terms")
    postings = build_postings(docs, text_col, id_col, terms)
    found = search(postings, terms, top)
    drop_table(terms)
    drop_table(postings)
    return found
