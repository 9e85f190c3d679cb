"""Removal of long passages that earlier documents hold, by recompression.

A window is ``window`` consecutive words.  A word goes if a window over it also starts in a document with a smaller id.

1. Every text is renamed in rounds (:mod:`.recompress`); names are hashes, so they are global without an exchange.  Each window has
   an anchor between two of its symbols, and neighbouring windows with one anchor make a block of some 15 windows.
2. Reveal: symbols are grouped; those of one document only are done with, which is most of them.
3. Verify by blocks: where every block of a shared symbol has the same words, or as many as do, the smallest id decides for the whole block.
4. Verify by windows: only blocks that differ from others of their symbol, which are those at the ends of passages and beside edits, are
   looked at window by window, once for each different block.

Groups are only ever reduced to their smallest id, with partial aggregation, so neither copies nor widespread passages make pairs or load one
task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import recompress as rc
from .common import as_bytes, drop_table, small_enough, tidy, write_table

#: Words of a window.
WINDOW = 50
#: A block is packed into one number: its start times PACK plus its length, which a chunk bounds.
PACK = 1 << 20


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Add ``n_words``, ``n_removed``, ``removed`` (spans of words, end exclusive) and ``kept_text`` (words joined by a space).

    Words are parted by ASCII white space and compared byte by byte.  Windows are judged on the input, not on what is left, so the
    smallest id of each passage keeps it.  Rows with equal ids don't remove each other's words; a null id is larger
    than any other.  Null and empty texts have no words; texts of any length are read whole, words of any length count.
    Repeated rows get equal results.  An empty table stays empty.  Added columns replace input columns of their names; others stay.

    Passages are equal if their 64-bit symbol and the 64-bit name of their words are.
    """
    names = ["n_words", "n_removed", "removed", "kept_text"]
    others = [c for c in df.columns if c.lower() not in names]
    row = F.struct(*others or [F.lit(None).alias("none")])
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(row.alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    covered = covered_blocks(docs, window)
    spans = F.col("blocks")
    joined = _beside(docs, covered).select("row", "text", spans)
    out = _without(joined, window)
    return out.select(*[F.col("row")[c].alias(c) for c in others], *names)


def covered_blocks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(``id``, ``hash``, ``blocks``): for each text the packed blocks of windows that a smaller id has, too; a written table."""
    occurrences = write_table(blocks_of(docs, window), "blocks")
    # reveal: symbols of several documents
    seen = occurrences.groupBy("symbol").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.max(F.col("id").isNull()).alias("unnamed"), F.min("name").alias("_a"), F.max("name").alias("_b")
    )
    seen = seen.filter(F.col("low").isNotNull() & ((F.col("low") != F.col("high")) | F.col("unnamed")))
    shared = write_table(seen.select("symbol", "low", (F.col("_a") != F.col("_b")).alias("differ")), "shared-symbols")
    met = occurrences.join(F.broadcast(shared) if small_enough(shared) else shared, "symbol")
    block = ("id", "hash", "block")
    plain = met.filter(~F.col("differ") & _smaller("low"))
    # verify by blocks
    unlike = write_table(met.filter("differ").select("symbol", "name", *block), "unlike-blocks")
    # written tables, so that Spark can split the joins where one key has very many rows
    lowest = write_table(unlike.groupBy("symbol", "name").agg(F.min("id").alias("low")), "lowest-of-blocks")
    judged = write_table(unlike.join(F.broadcast(lowest) if small_enough(lowest) else lowest, ["symbol", "name"]).select("symbol", *block, F.coalesce(_smaller("low"), F.lit(False)).alias("gone")), "judged-blocks")
    # verify by windows
    asked = judged.filter("not gone").select("symbol", *block).distinct()
    asked = asked.groupBy("id", "hash").agg(F.collect_list("block").alias("blocks"), F.collect_list("symbol").alias("symbols"))
    asked = write_table(asked, "asked-blocks")
    windows = write_table(windows_of(_beside(docs, asked, "inner"), window), "windows")
    held = windows.groupBy("symbol", "name").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max(F.col("id").isNull()).alias("unnamed"))
    held = held.filter(F.col("low").isNotNull() & ((F.col("low") != F.col("high")) | F.col("unnamed"))).select("symbol", "name", "low")
    held = write_table(held, "lowest-of-windows")
    fine = windows.join(F.broadcast(held) if small_enough(held) else held, ["symbol", "name"]).filter(_smaller("low"))
    every = plain.select(*block).unionByName(judged.filter("gone").select(*block)).unionByName(fine.select(*block))
    out = write_table(every.groupBy("id", "hash").agg(F.collect_set("block").alias("blocks")), "covered-blocks")
    for done in (occurrences, shared, unlike, lowest, judged, asked, windows, held):
        drop_table(done)
    return out


def _smaller(low: str) -> Column:
    """Whether ``low`` comes before the row's id; a null id comes last."""
    return (F.col(low) < F.col("id")) | (F.col("id").isNull() & F.col(low).isNotNull())


def _beside(docs: DataFrame, blocks: DataFrame, how: str = "left") -> DataFrame:
    """Every text with its packed blocks; they are broadcast only if their measured bytes are few."""
    own = blocks.withColumnsRenamed({"id": "_id", "hash": "_hash"})
    own = F.broadcast(own) if small_enough(own) else own
    return docs.join(own, docs["id"].eqNullSafe(own["_id"]) & (docs["hash"] == own["_hash"]), how).drop("_id", "_hash")


def blocks_of(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The blocks of every text: ``symbol``, ``name`` of its words, ``id``, ``hash``, ``block``."""
    schema = T.StructType(
        [T.StructField("symbol", T.LongType()), T.StructField("name", T.LongType()), docs.schema["id"], T.StructField("hash", T.LongType()), T.StructField("block", T.LongType())]
    )

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, starts, names in _chunks(as_bytes(batch, "text"), window):
                symbol, name, row, block = _blocks(names, rows, starts, window)
                ids, hashes = (batch.column(k).take(pa.array(row)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(symbol), pa.array(name), ids, hashes, pa.array(block)], names=schema.names)

    return docs.select("id", "hash", "text").mapInArrow(tidy(find), schema)


def _chunks(texts: list[bytes], window: int):
    """Texts or parts of them, an edge after each, some CHUNK_WORDS at a time: row and word number of each place, and its name."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for first, names in rc.segments(text, window):
            held.append((row, first, names))
            size += len(names) + 1
            if size >= rc.CHUNK_WORDS:
                yield _side_by_side(held)
                held, size = [], 0
    if held:
        yield _side_by_side(held)


def _side_by_side(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.zeros(1, rc.U)
    rows = np.concatenate([np.full(len(names) + 1, row) for row, _, names in held])
    places = np.concatenate([np.arange(first, first + len(names) + 1) for _, first, names in held])
    return rows, places, np.concatenate([part for _, _, names in held for part in (names, edge)])


def _blocks(names: np.ndarray, rows: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Blocks of a chunk: symbol, name, row, packed block."""
    anchor, level, symbol = rc.anchors(names, window)
    new = np.ones(len(names), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (level[1:] != level[:-1])
    turns = np.flatnonzero(new)
    ends = np.concatenate((turns[1:], [len(names)]))  # first window after the block
    real = anchor[turns] >= 0
    starts, ends = turns[real], ends[real]
    name = rc.mixed(rc.spans_hash(names, starts, ends + window - 1) + (anchor[starts] - starts).astype(rc.U))
    own = np.where(level[starts] > 0, symbol[starts], name)
    return own.view(np.int64), name.view(np.int64), rows[starts], places[starts] * PACK + (ends - starts)


def windows_of(asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each window of the ``blocks`` of a text as a block of its own: ``symbol``, ``name``, ``id``, ``hash``, ``block``."""
    schema = T.StructType(
        [T.StructField("symbol", T.LongType()), T.StructField("name", T.LongType()), asked.schema["id"], T.StructField("hash", T.LongType()), T.StructField("block", T.LongType())]
    )

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            blocks, symbols = (batch.column(batch.schema.get_field_index(c)) for c in ("blocks", "symbols"))
            for row, text in enumerate(as_bytes(batch, "text")):
                packed, symbol = (np.array(x[row].values) for x in (blocks, symbols))
                starts, ends = packed // PACK, packed // PACK + packed % PACK
                for first, names in rc.segments(text, window):
                    here = np.clip(np.stack((starts, ends)) - first, 0, len(names) - window + 1)
                    n = here[1] - here[0]
                    at = np.arange(n.sum()) + np.repeat(here[0] - (np.cumsum(n) - n), n)
                    if not len(at):
                        continue
                    own = pa.array(np.full(len(at), row))
                    name = rc.spans_hash(names, at, at + window).view(np.int64)
                    columns = [pa.array(np.repeat(symbol, n)), pa.array(name), batch.column(0).take(own), batch.column(1).take(own), pa.array((at + first) * PACK + 1)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return asked.select("id", "hash", "text", "blocks", "symbols").mapInArrow(tidy(look), schema)


def _without(joined: DataFrame, window: int) -> DataFrame:
    """What is left of each text without the words under its ``blocks``."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept_text", T.StringType())]
    schema = T.StructType([joined.schema["row"], *added])

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            blocks = batch.column(batch.schema.get_field_index("blocks"))
            n_words, n_removed, removed, kept = [], [], [], []
            for row, text in enumerate(as_bytes(batch, "text")):
                spans = _merged(np.array(blocks[row].values), window) if blocks[row].is_valid else []
                words, left = _keep(text, spans)
                n_words.append(words)
                n_removed.append(sum(end - start for start, end in spans))
                removed.append([{"start": start, "end": end} for start, end in spans])
                kept.append(left)
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, texts], names=schema.names)

    return joined.mapInArrow(tidy(cut), schema)


def _merged(packed: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Spans of words under packed blocks of windows, ascending and apart."""
    packed = np.sort(packed)
    starts = packed // PACK
    ends = np.maximum.accumulate(starts + packed % PACK + window - 1)
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    return list(zip(starts[new].tolist(), ends[np.concatenate((new[1:] - 1, [len(ends) - 1]))].tolist(), strict=True))


def _keep(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    """Number of words of a text, and those outside the spans joined by a space."""
    left, at, k = [], 0, 0
    for piece in rc.pieces(text):
        words = piece.split()
        end, here = at + len(words), at
        while here < end:
            while k < len(spans) and spans[k][1] <= here:
                k += 1
            start, stop = spans[k] if k < len(spans) else (end, end)
            if here < start:
                left.extend(words[here - at : min(start, end) - at])
            here = min(end, max(stop, here)) if start < end else end
        at = end
        left = [b" ".join(left)] if left else left
    return at, left[0] if left else b""
