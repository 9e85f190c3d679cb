"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of keys and values (with 16 for each row) that are broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Folds of the learned operators: a row is held out if crc32(doc_id) mod 5 is 0.
FOLDS = 5
#: Bytes of rows that one Arrow batch gathers; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (tests, a laptop) a temporary one is set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` below the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`write_table` that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_table_path", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def is_held_out(id_col: str | Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; false for null ids."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string")) % FOLDS == 0, F.lit(False))


def may_learn(id_col: str) -> Column:
    """Rows a model may learn from: the id is known and not held out."""
    return F.col(id_col).isNotNull() & ~is_held_out(id_col)


def smallest_hashes(keys: DataFrame, label: str, h: str, most: DataFrame) -> DataFrame:
    """The rows of each ``label`` with the smallest 64-bit hashes ``h``: as many as ``most`` (``label``, ``most``) says, ties by id.

    Labels are counted first, and only hashes below a bound that about four times as many rows reach go on, so no
    task sees all rows of a frequent label.
    """
    counts = keys.groupBy(label).agg(F.count("*").alias("n")).join(most, label)
    counts = F.broadcast(counts) if small_enough(counts) else counts
    place = F.col(h).cast("double") / float(1 << 64) + 0.5  # uniform in [0, 1]
    near = keys.join(counts, label).filter(place * F.col("n") <= 4 * F.col("most") + 64)
    order = Window.partitionBy(label).orderBy(h, "id")
    return near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.col("most")).select(*keys.columns)


def kept_fields(df: DataFrame, added: list[T.StructField]) -> list[T.StructField]:
    """Input fields that stay next to ``added`` ones (Spark names ignore case)."""
    names = {f.name.lower() for f in added}
    return [f for f in df.schema.fields if f.name.lower() not in names]


def tidy(function):
    """``function(batches)`` for ``mapInArrow`` that gives its memory back at the end of a task.

    Reused Python workers would else keep what earlier stages have freed, beside what the next ones need.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU libc only
            if trim:
                trim(0)

    return run


def bound_batches(spark: SparkSession) -> None:
    """Let Python workers of this session get Arrow batches of BATCH_BYTES, unless it asks for smaller ones.

    A batch stands several times in the memory of an executor: as vectors and as a stream in the JVM, and as buffers and
    texts in Python.  Spark's own bounds are 10,000 rows and 64 MiB.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_batches(df: DataFrame, function, added: list[T.StructField]) -> DataFrame:
    """Add columns computed from Arrow batches; the other columns pass through.

    ``function(batches)`` yields, for each record batch, a list of Arrow arrays in
    the order of ``added``.
    """
    import pyarrow as pa

    keep = [f.name for f in kept_fields(df, added)]
    names = keep + [f.name for f in added]
    schema = T.StructType(kept_fields(df, added) + added)

    def run(batches):
        for batch, arrays in function(batches):
            columns = [batch.column(batch.schema.get_field_index(n)) for n in keep]
            yield pa.RecordBatch.from_arrays(columns + arrays, names=names)

    return df.mapInArrow(tidy(run), schema)


def as_bytes(batch, name: str) -> list[bytes | None]:
    """A string column of a record batch as UTF-8 bytes."""
    return bytes_of(batch.column(batch.schema.get_field_index(name)))


def bytes_of(column) -> list[bytes | None]:
    """An Arrow array of strings as UTF-8 bytes."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def small_enough(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df`` take at most ``most`` bytes (measured before a broadcast; 8 for each element of an array)."""

    def width_of(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(f.name), F.lit(0))
        return F.coalesce(F.size(f.name), F.lit(0)) * 8 if isinstance(f.dataType, T.ArrayType) else F.lit(8)

    width = sum(map(width_of, df.schema.fields), F.lit(16))
    return (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most


def semi(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join on one null-safe key.

    ``ids`` is broadcast only if its measured bytes are few; beyond that both sides are shuffled on the key.
    """
    keys = ids.select(F.col(on).alias("_semi_key")).distinct()
    if small_enough(keys):
        keys = F.broadcast(keys)
    return df.join(keys, df[on].eqNullSafe(keys["_semi_key"]), how)
