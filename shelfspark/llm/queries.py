"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language_id, lexical_search, line_dedup, media, mixing, pii, prefix_trie, sharding, substring_dedup, toxicity, url_filter
from .common import drop_table, is_held_out, shared_dir, small_enough, write_table

#: File bytes of a finished shard.
SHARD_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity_model(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train_language_model(docs)
    named = language_id.identify_language(docs.select("doc_id", "text"), model)
    return named.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cleaned = line_dedup.remove_boilerplate(docs)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as read from the committed version; ``fits``: their shard is below twice the target size or holds one row."""
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), path, SHARD_BYTES)
    shards = sharding.ShardStore(spark, path).manifest().select(F.col("shard").alias("name"), ((F.col("bytes") < 2 * SHARD_BYTES) | (F.col("rows") == 1)).alias("fits"))
    shards = F.broadcast(shards) if small_enough(shards) else shards
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return rows.join(shards, rows["shard"] == shards["name"]).select("doc_id", n_bytes, F.sha2("text", 256).alias("text_sha256"), "fits")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = media.images_of_texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "media")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return media.media_features(stored).select(*names, F.sha2("tile_npy", 256).alias("tile_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs)
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in pii.BASE_KINDS], F.sha2(pii.span_list(base), 256).alias("base_sha256"),
        pii.span_list(F.col("pii")).alias("spans"), F.array_max(F.transform("pii", lambda x: x["score"])).alias("top_score"),
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.number_turns(table(spark, sf_dir, "conversations"))
    convs = turns.select("conv_id").distinct()
    rebuilt = write_table(share_heads(turns), "rebuilt-turns")
    nodes = prefix_trie.prefix_trie(rebuilt, convs)
    drop_table(turns)
    drop_table(rebuilt)
    return nodes


def share_heads(turns: DataFrame) -> DataFrame:
    """Conversations that begin like the first of their five: ``conv_id``, ``depth``, ``tid``, ``n_bytes``.

    The first h turns of conversation c - c % 5 and then c's own after its first h, where h is crc32(c) % 9.
    """
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h"))
    heads = heads.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("most")), "base", "left")
    heads = heads.withColumn("shared", F.least("h", F.coalesce("most", F.lit(0).cast("long"))))
    own = turns.join(heads, "conv_id").filter("rank >= h").select("conv_id", (F.col("shared") + F.col("rank") - F.col("h") + 1).alias("depth"), "tid", "n_bytes")
    first = turns.filter("rank < 8").withColumnRenamed("conv_id", "base").join(heads, "base").filter("rank < h")
    return first.select("conv_id", (F.col("rank") + 1).alias("depth"), "tid", "n_bytes").unionByName(own)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.rank_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_url_filter, op2_toxicity, op3_decontaminate, op4_language_id, op5_line_dedup,
        op6_mixing, op7_sharding, op8_media, op9_ngram_jaccard, op10_pii, op11_substring_dedup, op12_prefix_trie, op13_lexical_search, pipeline,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": URL_SQL,
        "op3_decontaminate": DECONTAMINATION_SQL,
        "op5_line_dedup": LINE_SQL,
        "op6_mixing": MIXING_SQL,
        "op7_sharding": SHARDING_SQL,
        "op9_ngram_jaccard": JACCARD_SQL,
        "op11_substring_dedup": SUBSTRING_SQL,
        "op12_prefix_trie": TRIE_SQL,
        "op13_lexical_search": SEARCH_SQL,
    }


URL_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                      ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM (SELECT DISTINCT * FROM parsed) p
  LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parsed p JOIN best b ON b.k = 1 AND p.page_id IS NOT DISTINCT FROM b.page_id AND p.host = b.host AND p.path = b.path
"""

DECONTAMINATION_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
phrases AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k : k + 12], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS k FROM items WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM lowered, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.k, g.n, p.item FROM grams g JOIN phrases p USING (n, phrase)),
words AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS k FROM hits),
per_doc AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
per_item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l.w) AS contaminated
FROM lowered l LEFT JOIN per_doc USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""

LINE_SQL = r"""
WITH blanks AS (SELECT ' ' || chr(9) || chr(11) || chr(12) || chr(13) AS b),
lines AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
pieces AS (SELECT DISTINCT coalesce('s' || source, 'n') AS site, trim(line, b) AS line FROM (SELECT source, unnest(parts) AS line FROM lines), blanks),
common AS (SELECT line FROM pieces WHERE line <> '' GROUP BY line HAVING count(*) >= 8),
listed AS (SELECT coalesce(list(line), []) AS common FROM common)
SELECT doc_id, coalesce(len(parts), 0) AS n_lines,
       coalesce(len(list_filter(parts, lambda x: list_contains(common, trim(x, b)))), 0) AS n_removed,
       CASE WHEN parts IS NOT NULL THEN sha256(coalesce(array_to_string(list_filter(parts, lambda x: NOT list_contains(common, trim(x, b))), chr(10)), '')) END AS clean_sha256
FROM lines, listed, blanks
"""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(text) AS digest, row_number() OVER (PARTITION BY doc_id, text, source) AS number,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM per),
ordered AS (
  SELECT *, sum(3.0::DOUBLE * source_size) OVER before AS cut, sum(weight) OVER before AS gone
  FROM ranked WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM per)::DOUBLE - coalesce(cut, 0)) / ((SELECT sum(weight) FROM ranked) - coalesce(gone, 0)) AS level
  FROM ordered),
water AS (
  SELECT coalesce((SELECT level FROM levels WHERE 3.0::DOUBLE * source_size > level * weight ORDER BY 3.0 * source_size / weight, source LIMIT 1), 0) AS level),
rates AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT level FROM water) * weight) AS target FROM ranked),
drawn AS (
  SELECT s.*, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5(concat_ws(':', 'mix-1', CAST(doc_id AS VARCHAR), digest, CAST(number AS VARCHAR))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM drawn
"""

SHARDING_SQL = r"""
SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes, sha256(text) AS text_sha256, TRUE AS fits FROM documents
"""

JACCARD_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common.n >= 75 * (p.n + q.n - common.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, least(w.doc_id, min(r.b)) AS component_id
FROM worded w LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id, s.n
"""

SUBSTRING_SQL = r"""
WITH worded AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS passage
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM worded WHERE len(w) >= 50)),
first AS (SELECT passage, min(doc_id) AS low FROM windows GROUP BY passage),
gone AS (
  SELECT DISTINCT r, unnest(range(k, k + 50)) AS k FROM windows JOIN first USING (passage) WHERE low < doc_id OR (doc_id IS NULL AND low IS NOT NULL)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM worded),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (r, k) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
"""

SEARCH_SQL = r"""
WITH worded AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM worded WHERE len(w) > 0),
postings AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM worded) GROUP BY ALL),
wanted AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
spread AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scores AS (
  SELECT item_id, r, doc_id,
         CAST(sum(times * CAST(floor(1000.0::DOUBLE * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT)
                  * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted JOIN postings USING (term) JOIN spread USING (term), totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', role, text)) AS turn_key, octet_length(encode(coalesce(text, ''))) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS rank
  FROM conversations WHERE conv_id IS NOT NULL),
counts AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
heads AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c.conv_id AS VARCHAR), ''),
               lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384::BIGINT * (crc & 1)) END), 4294967295::BIGINT) % 9 AS h
  FROM counts c),
shares AS (SELECT h.*, least(h.h, coalesce(b.n, 0)) AS shared FROM heads h LEFT JOIN counts b ON b.conv_id = h.base),
rebuilt AS (
  SELECT s.conv_id, t.rank + 1 AS depth, turn_key, bytes FROM shares s JOIN turns t ON t.conv_id = s.base WHERE t.rank < s.h
  UNION ALL SELECT s.conv_id, s.shared + t.rank - s.h + 1, turn_key, bytes FROM shares s JOIN turns t USING (conv_id) WHERE t.rank >= s.h),
sequences AS (
  SELECT s.conv_id, coalesce(list(turn_key ORDER BY depth) FILTER (WHERE depth IS NOT NULL), []) AS keys,
         coalesce(list(bytes ORDER BY depth) FILTER (WHERE depth IS NOT NULL), []) AS sizes
  FROM shares s LEFT JOIN rebuilt USING (conv_id) GROUP BY s.conv_id),
members AS (
  SELECT conv_id, depth, md5(array_to_string(keys[1 : depth], ' ')) AS prefix, coalesce(sizes[depth], 0) AS bytes, depth = len(keys) AS ends
  FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS depth FROM sequences)),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS node, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY depth, prefix),
placed AS (SELECT m.conv_id, m.depth, n.node FROM members m JOIN nodes n USING (depth, prefix)),
parents AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN placed p ON p.conv_id = n.node AND p.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE parent IS NOT NULL GROUP BY ALL),
full_nodes AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN kids USING (node, depth)),
totals AS (
  SELECT a.node, a.depth, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
  FROM full_nodes f JOIN placed a ON a.conv_id = f.node AND a.depth <= f.depth GROUP BY a.node, a.depth)
SELECT f.node AS conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, t.n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN totals t USING (node, depth)
"""
