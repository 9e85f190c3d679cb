"""Structured Streaming forms of the event-log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PINS = 3


def rate_windows(events: DataFrame, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events per key and fixed window, with whether the limit was passed; works on streams and tables."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = timed.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("over"))


def run_counters(requests: DataFrame, path: str, checkpoint: str, limit: int, seconds: int = 60, late: str = "1 day") -> DataFrame:
    """Requests (``ts``, ``bucket``, ``key``) per bucket, key and fixed window as kept in the state store, and whether they passed ``limit``.

    Each batch writes the counters it has changed below ``path``, late requests up to ``late`` included; counters only grow, so the
    largest count of one is its newest.
    """
    window = F.window("ts", f"{seconds} seconds").alias("w")
    counts = requests.withWatermark("ts", late).groupBy("bucket", "key", window).agg(F.count("*").alias("n"))
    rows = counts.select("bucket", "key", F.col("w.start").alias("window_start"), "n")
    every = run_once(rows, path, checkpoint, "update")
    return every.groupBy("bucket", "key", "window_start").agg(F.max("n").alias("n")).withColumn("over", F.col("n") > limit)


def drop_repeats(events: DataFrame, keys: list[str], within: str = "10 minutes") -> DataFrame:
    """Drop events whose content was seen within the time span."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def accepted(events: DataFrame, keys: list[str], seconds: int = 600) -> DataFrame:
    """Events that repeat no accepted event of their keys from the last ``seconds``; a batch operator.

    The span counts from the last accepted event, and one of exactly ``seconds`` still rejects.  Events without a
    time are accepted.  Tasks fold sorted rows one by one and hold no group in memory.
    """
    rows = events.repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id")

    def fold(batches):
        import pyarrow as pa

        key, last = None, None
        for batch in batches:
            stamps = batch.column(batch.schema.get_field_index("ts")).cast(pa.int64()).to_pylist()
            owners = zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], strict=True)
            keep = []
            for owner, at in zip(owners, stamps, strict=True):
                if owner != key:
                    key, last = owner, None
                keep.append(at is None or last is None or at - last > seconds * 1_000_000)
                if keep[-1] and at is not None:
                    last = at
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(fold, rows.schema)


def fold_pins(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Pinned games (``user_id``, ``pins``) after a batch: at most MAX_PINS, pinning again changes nothing.

    ``before`` are the pins that earlier batches left.  Tasks fold sorted rows one by one and hold no group in memory.
    """
    rows = events.select("user_id", "ts", "event_id", "appid", "event", F.lit(None).cast("array<long>").alias("pins"))
    if before is not None:
        held = before.select("user_id", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("appid"), F.lit("held").alias("event"), "pins")
        rows = rows.unionByName(held)
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", F.col("event") != "held", F.col("ts").asc_nulls_last(), "event_id")

    def fold(batches):
        import pyarrow as pa

        user, pins, begun = None, [], False
        for batch in batches:
            done = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("user_id", "appid", "event", "pins")]
            for who, game, event, held in zip(*columns, strict=True):
                if not begun or who != user:
                    if begun:
                        done.append((user, pins))
                    user, pins, begun = who, [], True
                if event == "held":
                    pins = list(held)
                elif event == "pinned" and game not in pins and len(pins) < MAX_PINS:
                    pins.append(game)
                elif event in ("unpinned", "drew_again") and game in pins:
                    pins.remove(game)
            yield _pin_rows(pa, done)
        if begun:
            yield _pin_rows(pa, [(user, pins)])

    return rows.select("user_id", "appid", "event", "pins").mapInArrow(fold, "user_id long, pins array<long>")


def _pin_rows(pa, rows: list):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["user_id", "pins"])


def run_pins(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Fold a stream of pin events; the pins after each batch are written below ``path`` and carried into the next."""
    done = []

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fold_pins(batch, spark.read.parquet(done[-1]) if done else None).write.mode("overwrite").parquet(f"{path}/{number}")
        done.append(f"{path}/{number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    pins = spark.read.parquet(done[-1]) if done else spark.createDataFrame([], "user_id long, pins array<long>")
    return pins.select("user_id", F.array_join("pins", ",").alias("pins"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available, write its rows as Parquet below ``path`` and read all rows there.

    Of the batches of a complete result the last one counts.  Starting again with the same ``path`` and ``checkpoint`` adds to the rows.
    """
    done = []
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("append").parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        done.append(f"{path}/{number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = stream.sparkSession.read.schema(stream.schema)
    return read.parquet(done[-1]) if done and mode == "complete" else read.option("recursiveFileLookup", "true").parquet(path)
