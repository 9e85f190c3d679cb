"""Domain views over the star-schema tables: catalogue, ownership, draws, snapshots, reviews, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

NOW_ORDERS, NOW_EVENTS = "2001-12-01 00:00:00", "2024-01-31 00:00:00"
USERS = 50
#: Rows of a task that sorts or joins rows of ``lineitem``: the memory of a task stays the same whatever the table's size.
TASK_ROWS = 250_000
GENRES = {"ECONOMY": "Casual", "STANDARD": "Action", "MEDIUM": "Adventure", "LARGE": "Strategy", "PROMO": "RPG"}
TAGS = ["Cozy", "Horror", "Puzzle", "Roguelike", "Story_Rich", "Exploration", "Competitive", "Arcade"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts(value: str):
    return F.lit(value).cast("timestamp")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game: labels, price in cents, duration estimates in minutes, review counts."""
    games = facts(spark, sf_dir)
    sold = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("kept"))
    reviews = lambda c: (F.coalesce(c, F.lit(0)) * F.col("_size") * F.col("_size")).cast("long")
    joined = games.join(sold, games.appid == F.col("l_partkey") + 1, "left")
    return joined.withColumns({"review_total": reviews("n"), "review_positive": reviews("kept")}).drop("l_partkey", "n", "kept", "_size")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue without its reviews, from ``part`` alone; ``_size`` scales the reviews."""
    part = read(spark, sf_dir, "part")
    kind = F.split("p_type", " ")[0]
    genre = F.coalesce(F.create_map(*[F.lit(x) for pair in GENRES.items() for x in pair])[kind], F.lit("Simulation"))
    known, size = F.col("p_size") % 7 != 0, F.col("p_size")
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("p_partkey") % len(TAGS) + 1).cast("int"))
    return part.select(
        (F.col("p_partkey") + 1).alias("appid"), F.col("p_name").alias("title"), genre.alias("genre"),
        F.array(genre, tag).alias("labels"), F.floor(F.col("p_retailprice") * 100 + 0.5).alias("price_cents"),
        F.when(known, size * 60).alias("main_story"), F.when(known, size * 90).alias("main_extras"),
        F.when(known, size * 150).alias("completionist"), (size % 11 == 0).alias("endless"),
        F.when(known, "ready").otherwise(F.element_at(F.array(*map(F.lit, ("pending", "processing", "failed"))), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("duration_status"),
        F.when(F.col("p_partkey") % 16 == 3, "pending").when(F.col("p_partkey") % 16 != 5, "ready").alias("tags_status"), size.alias("_size"),
    )


def spread(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` over so many tasks; a single one is left to Spark."""
    return rows.repartition(tasks, *keys) if tasks > 1 else rows


def user_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and owned game: status, hours, last played, added."""
    items, kept = read(spark, sf_dir, "lineitem"), F.col("l_returnflag") != "R"
    tasks = -(-items.count() // TASK_ROWS)
    sold = items.select("l_orderkey", (F.col("l_partkey") + 1).alias("appid"), F.when(kept, F.col("l_quantity")).alias("quantity"), F.when(kept, F.col("l_shipdate").cast("timestamp")).alias("shipped"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % USERS).alias("user_id"), "o_orderdate", "o_orderstatus", "o_orderpriority")
    joined = spread(sold, tasks, "l_orderkey").join(spread(orders, tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    # pairs of users and games hardly repeat, so rows are shuffled before they are gathered; the catalogue is joined by the same key
    per = spread(joined, tasks, "appid").groupBy("user_id", "appid").agg(
        F.sum("quantity").alias("quantity"), F.max("shipped").alias("last_played_at"), F.min(F.col("o_orderdate").cast("timestamp")).alias("added_at"),
        F.max_by(F.struct("o_orderstatus", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("newest"),
    )
    per = per.select("*", F.col("newest.o_orderstatus").alias("state"), F.when(F.col("newest.o_orderpriority") == "1-URGENT", "Must Play").otherwise("Medium").alias("priority"))
    status = (
        F.when((F.col("state") == "F") & F.col("quantity").isNull(), "Slept").when(F.col("state") == "F", "Completed")
        .when(F.col("state") == "P", "In Progress").otherwise("Not Started")
    )
    return per.withColumn("status", status).select(
        "user_id", "appid", "status", F.when(F.col("status") == "Not Started", 0.0).otherwise(F.coalesce(F.col("quantity") / 10, F.lit(0.0))).alias("hours"),
        "last_played_at", "added_at", "priority", F.when(F.col("status") == "Completed", F.col("last_played_at")).alias("completed_at"),
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw events with their draws: three consecutive events of a user make one draw."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.floor((F.row_number().over(order) - 1) / 3))
    own = Window.partitionBy("user_id", "k").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = read(spark, sf_dir, "part").agg(F.count("*").alias("n_parts"))
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "opened_on_steam", "click", "liked", "signup", "pinned", "view", "drew_again")])
    event = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "reroll_not_interested").otherwise("reroll_wrong_mood")).otherwise(kind[F.col("event_type")])
    mood = F.element_at(F.array(F.lit(None), F.lit("brain-off"), F.lit("chill"), F.lit("intense")), (F.col("k") % 4 + 1).cast("int"))
    return rows.crossJoin(F.broadcast(parts)).select(
        "user_id", F.col("k").alias("draw_no"), (F.first("event_id").over(own) % F.col("n_parts") + 1).alias("appid"), F.first("ts").over(own).alias("drawn_at"),
        mood.alias("mood"), event.alias("event"), F.col("ts").alias("created_at"), "event_id",
    )


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pinned games per user, the first added; one in four has no hours at pinning."""
    order = Window.partitionBy("user_id").orderBy("added_at", "appid")
    first = user_games(spark, sf_dir).withColumn("slot", F.row_number().over(order)).filter("slot <= 5")
    return first.select("user_id", "slot", "appid", F.when(F.col("appid") % 4 != 0, F.floor(F.col("hours") / 2)).alias("hours_at_pin"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total of minutes per user and day: whole minutes of each day's exact sum, as a sum of doubles depends on its order."""
    day = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.floor(F.sum(F.col("value").cast("decimal(28,6)"))).cast("long").alias("minutes"))
    return day.select("user_id", "day", F.sum("minutes").over(Window.partitionBy("user_id").orderBy("day")).alias("total_minutes"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per game and metric with its value."""
    per = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") + 1).alias("appid")).agg(
        F.count("*").cast("double").alias("count"), F.round(F.sum(F.col("l_extendedprice")), 2).alias("revenue"), F.sum("l_quantity").alias("quantity")
    )
    return per.unpivot("appid", ["count", "revenue", "quantity"], "metric", "value")


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three popularity rankings of all games: rows per metric with rank and value.

    Ranks come from a range-partitioned sort with offsets per partition, so that no task holds a whole metric.
    """
    order = [F.col("value").desc(), F.col("appid")]
    parted = written(metrics(spark, sf_dir).orderBy("metric", *order).withColumn("_part", F.spark_partition_id()), "rankings")
    before = Window.partitionBy("metric").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("metric", "_part").agg(F.count("*").alias("_n")).select("metric", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("metric", "_part").orderBy(*order)) + F.col("_offset")
    return parted.join(F.broadcast(offsets), ["metric", "_part"]).select("appid", "metric", "value", rank.alias("rank"))
