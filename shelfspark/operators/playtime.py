"""Play-time series: daily gains, streaks, trailing sums, visit recaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up


def gains(snapshots: DataFrame) -> DataFrame:
    """Difference to the previous snapshot, at least 0, on the newer day; none for the first."""
    own = Window.partitionBy("user_id").orderBy("day")
    before = F.lag("total_minutes").over(own)
    return snapshots.withColumn("_before", before).withColumn("minutes", F.greatest(F.lit(0), F.col("total_minutes") - F.col("_before"))).filter("_before is not null").select("user_id", "day", F.col("minutes").cast("long").alias("minutes"))


def streaks(daily: DataFrame, today: Column) -> DataFrame:
    """Days in a row with a gain that end today, or yesterday if today has none; users without days too."""
    played = daily.filter(F.col("minutes") > 0).filter(F.col("day") <= today)
    own = Window.partitionBy("user_id").orderBy("day")
    runs = played.withColumn("run", F.date_sub("day", F.row_number().over(own)))
    ends = runs.groupBy("user_id", "run").agg(F.count("*").alias("length"), F.max("day").alias("last"))
    live = ends.filter(F.col("last") >= F.date_sub(today, 1)).groupBy("user_id").agg(F.max_by("length", "last").alias("streak"))
    return daily.select("user_id").distinct().join(live, "user_id", "left").select("user_id", F.coalesce("streak", F.lit(0)).alias("streak"))


def trailing(daily: DataFrame, today: Column, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Minutes of the last days, today included."""
    inside = lambda d: F.coalesce(F.sum(F.when((F.col("day") > F.date_sub(today, d)) & (F.col("day") <= today), F.col("minutes"))), F.lit(0))
    return daily.groupBy("user_id").agg(*[inside(d).alias(f"minutes_{d}d") for d in days])


def visit_recap(users: DataFrame, daily: DataFrame, last_visit: DataFrame, finished: DataFrame, today: Column) -> DataFrame:
    """Minutes and finished games since the last visit (a week if unknown or over 30 days ago), for every user of ``users``.

    None for a visit of the same day, and none under 20 minutes without a finished game.  ``finished`` has ``user_id`` and
    ``completed_at``.
    """
    seen = users.select("user_id").distinct().join(last_visit, "user_id", "left")
    old = F.col("visited").isNull() | (F.datediff(today, F.col("visited")) > 30)
    spans = seen.select("user_id", F.when(old, F.date_sub(today, 7)).otherwise(F.col("visited")).alias("since"), old.alias("windowed"))
    spans = spans.filter(F.col("windowed") | (F.col("since") < today))
    entries = daily.select("user_id", "day", "minutes", F.lit(0).alias("done")).unionByName(
        finished.select("user_id", F.to_date("completed_at").alias("day"), F.lit(0).cast("long").alias("minutes"), F.lit(1).alias("done"))
    )
    inside = (F.col("day") > F.col("since")) & (F.col("day") <= today)
    per = spans.join(entries, "user_id").filter(inside).groupBy("user_id", "since", "windowed")
    out = per.agg(F.sum("minutes").alias("minutes"), F.sum("done").alias("games_finished"))
    return out.filter((F.col("minutes") >= 20) | (F.col("games_finished") > 0)).withColumn("hours", half_up(F.col("minutes") / 60, 1))
