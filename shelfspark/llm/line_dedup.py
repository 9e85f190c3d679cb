"""Line deduplication by distinct-site spread.

A line is boilerplate if it occurs on at least ``min_sites`` distinct sites, so
in as many rows at least; most lines do not, and plain counts of rows leave them out.
One HyperLogLog sketch of sites per hash of the others, built by partial aggregation and
merged, estimates the spread.  Lines whose estimate is near the threshold get
an exact distinct count; only lines far above it are decided by the sketch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, bytes_of, small_enough, tidy, write_table

#: Sketch size: 2^LG_K registers give a relative standard error of about 1.04 / sqrt(2^LG_K).
LG_K = 8
#: Lines with an estimate within this factor of the threshold are counted exactly; beyond it, LG_K's error cannot matter.
NEAR = 2.0
#: Most bytes of the list of boilerplate (with 16 for each line) that every worker gets; a longer one is joined, which shuffles the texts.
LIST_BYTES = BROADCAST_BYTES
#: Rows of a batch that a worker holds as Python objects at a time.
SLICE = 1000

#: White space around a line that does not count.
BLANKS = " \t\r\x0b\x0c"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_hashes(text: Column) -> Column:
    """64-bit hashes of the distinct lines of a text that hold more than white space."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Line hashes (``_line``) with at least ``min_sites`` distinct sites in ``lines`` (``_line`` once a row, ``_site``)."""
    frequent = _listed(lines.groupBy("_line").count().filter(F.col("count") >= min_sites).select("_line"), "line-counts")
    sketched = _among(lines, frequent).groupBy("_line").agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("sites"))
    spread = _listed(
        sketched.select("_line", F.hll_sketch_estimate("sites").alias("estimate")).filter(F.col("estimate") >= min_sites / NEAR),
        "line-spread",
    )
    near = spread.filter(F.col("estimate") < min_sites * NEAR)
    exact = (
        _among(lines, near.select("_line"))
        .distinct()
        .groupBy("_line")
        .count()
        .filter(F.col("count") >= min_sites)
        .select("_line")
    )
    return spread.filter(F.col("estimate") >= min_sites * NEAR).select("_line").unionByName(exact)


def _listed(found: DataFrame, name: str) -> DataFrame:
    """``found``, short beside the texts, written as a file for each core at most, whatever the number of shuffle partitions."""
    return write_table(found.repartition(found.sparkSession.sparkContext.defaultParallelism), name)


def _among(lines: DataFrame, listed: DataFrame) -> DataFrame:
    return lines.join(F.broadcast(listed) if small_enough(listed) else listed, "_line", "left_semi")


def remove_boilerplate(
    df: DataFrame, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id", min_sites: int = 8
) -> DataFrame:
    """Add ``clean_text`` (the text without boilerplate lines), ``n_lines`` and ``n_removed``.

    Lines are compared without ASCII white space at their ends; lines of nothing else stay and are never boilerplate.
    A null text gives a null ``clean_text`` and no lines; a null site counts as one site.  Rows that share an id, or have
    none, are judged by their own texts.  Repeated rows are cleaned alike, texts of any
    length are whole, an empty table stays empty, other columns pass through whatever their names.

    The list of boilerplate goes to the workers, so texts stay where they are read.  Above ``LIST_BYTES`` the lines of
    each row are joined with it, and rows are matched with their lines to drop by id and a hash of the text; where
    two texts of an id share the hash, both drop what is boilerplate in either.
    """
    base = df.drop(*[c for c in df.columns if c.lower() in ("clean_text", "n_lines", "n_removed")])
    row = F.struct("*").alias("row")
    lines = base.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("h"),
        F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n")).alias("_site"),
        F.explode(line_hashes(F.col(text_col))).alias("_line"),
    )
    common = _listed(boilerplate_lines(lines.select("_line", "_site"), min_sites), "boilerplate")
    if small_enough(common, LIST_BYTES):
        cleaned = _without(base.select(row), text_col, common.toArrow().column("_line").to_numpy())
    else:
        own = base.select(row, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
        # the lines of one text, so a group is never longer than that
        hits = lines.join(common, "_line", "left_semi").groupBy("id", "h").agg(F.collect_set("_line").alias("drop"))
        joined = own.join(hits, own["id"].eqNullSafe(hits["id"]) & (own["h"] == hits["h"]), "left")
        cleaned = _without(joined.select("row", "drop"), text_col)
    return cleaned.select("row.*", "n_lines", "n_removed", "clean_text")


def _without(rows: DataFrame, text_col: str, listed: np.ndarray | None = None) -> DataFrame:
    """``clean_text``: the text of ``row`` without the lines whose hashes are in ``listed``, or else in ``drop``; the work grows with the text alone."""
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("clean_text", T.StringType())]
    schema = T.StructType([rows.schema["row"], *added])
    place = [c.lower() for c in rows.schema["row"].dataType.names].index(text_col.lower())
    blanks = BLANKS.encode()
    shared = None if listed is None else rows.sparkSession.sparkContext.broadcast(np.sort(listed.view(np.uint64)))

    def dropped(lines: list[bytes], drop: np.ndarray) -> np.ndarray:
        import xxhash

        owns = [line.strip(blanks) for line in lines]
        # as Spark's xxhash64: seed 42, unsigned here
        hashes = np.array([xxhash.xxh64_intdigest(own, 42) for own in owns], np.uint64)
        found = drop[np.minimum(np.searchsorted(drop, hashes), len(drop) - 1)] == hashes
        return found & np.array([own != b"" for own in owns])

    def clean(batches):
        import pyarrow as pa

        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            n_lines, n_removed, texts = [], [], []
            for k, text in enumerate(bytes_of(batch.column(0).field(place))):
                lines = text.split(b"\n") if text is not None else []
                if shared is not None:
                    drop = shared.value
                else:
                    drop = np.sort(np.array(own.values).view(np.uint64)) if (own := batch.column(1)[k]).is_valid else ()
                gone = dropped(lines, drop) if lines and len(drop) else np.zeros(len(lines), bool)
                n_lines.append(len(lines))
                n_removed.append(int(gone.sum()))
                texts.append(b"\n".join(line for line, out in zip(lines, gone.tolist(), strict=True) if not out) if n_removed[-1] else text)
            arrays = [pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return rows.mapInArrow(tidy(clean), schema)
