"""Library statistics, queues for completion and clean-up, smart collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, percent
from .scoring import appeal

DAY = 86_400_000_000


def active(status: Column | str = "status") -> Column:
    """Neither completed nor slept."""
    return ~(F.col(status) if isinstance(status, str) else status).isin("Completed", "Slept")


def shown_status(status: Column, percent_done: Column, endless: Column, hours: Column) -> Column:
    """Status by progress: up to 10 percent is a sample, an endless game that was played is in progress."""
    return (
        F.when(status == "Completed", "Completed").when((percent_done > 0) & (percent_done <= 10), "Sampled")
        .when((percent_done > 10) | (endless & (hours > 0)), "In Progress").otherwise("Not Started")
    )


def library_stats(df: DataFrame) -> DataFrame:
    """Counts, hours, mean of the positive ratings and mean progress per user."""
    shown = shown_status(F.col("status"), F.col("percent"), F.col("endless"), F.col("hours"))
    return df.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "Completed").alias("completed"), F.count_if(shown == "In Progress").alias("in_progress"),
        half_up(F.round(F.sum("hours"), 6), 1).alias("hours"), F.coalesce(half_up(F.avg(F.when(F.col("rating") > 0, F.col("rating"))), 1), F.lit(0.0)).alias("avg_rating"),
        half_up(F.avg("percent"), 1).alias("mean_progress"),
    )


def backlog_stats(df: DataFrame) -> DataFrame:
    """Size, value, hours and completion of the backlog per user, cheapest game per hour and latest completion, in one pass.

    Of equally cheap games and of completions at one time the smallest id counts.
    """
    done, unplayed, value = F.col("status") == "Completed", F.col("hours") <= 0, F.col("price_cents")
    priced, dated = (value > 0) & (F.col("hours") >= 1), done & F.col("completed_at").isNotNull()
    cents = lambda cond: F.coalesce(F.sum(F.when(cond, value)), F.lit(0))
    rate = F.struct(F.round(value / F.col("hours"), 6).alias("rate"), F.col("appid").alias("appid"))
    return df.groupBy("user_id").agg(
        F.count("*").alias("total_games"), F.count_if(done).alias("completed_games"), percent(F.count_if(done), F.count("*")).alias("completed_percent"),
        F.sum(value).alias("library_cents"), cents(done).alias("completed_cents"), percent(cents(done), F.sum(value)).alias("value_percent"),
        half_up(F.round(F.sum(F.greatest(F.lit(0.0), F.col("hours"))), 6)).cast("long").alias("total_hours"), F.count_if(unplayed).alias("unplayed_games"),
        cents(unplayed).alias("unplayed_cents"), F.count_if(value > 0).alias("priced_games"),
        F.min(F.when(priced, rate))["appid"].alias("best_value_appid"),
        F.max(F.when(dated, F.struct("completed_at", (-F.col("appid")).alias("below"))))["below"].alias("_below"),
    ).withColumn("latest_completed_appid", -F.col("_below")).drop("_below")


def best_value(df: DataFrame, k: int = 5) -> DataFrame:
    """The k games per user with the fewest cents per hour."""
    rated = df.filter((F.col("price_cents") > 0) & (F.col("hours") >= 1)).withColumn("cents_per_hour", F.round(F.col("price_cents") / F.col("hours"), 4))
    own = Window.partitionBy("user_id").orderBy("cents_per_hour", "appid")
    return rated.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("user_id", "rank", "appid", "cents_per_hour")


def idle_days(now: Column) -> Column:
    """Days since the last play, at least 0; null where it is unknown."""
    return F.when(F.col("last_played_at").isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("last_played_at")) / DAY))


def preset(name: str, now: Column) -> Column:
    """Whether a library row belongs to a smart collection."""
    still, hours, done = active(), F.col("hours"), F.col("percent")
    idle = F.floor(idle_days(now))
    length = F.col("estimate") / 60
    left = F.greatest(F.lit(0.0), length - hours)
    finite = ~F.col("endless")
    rules = {
        "nearly-finished": still & finite & (done >= 65) & (done < 100), "quick-wins": still & finite & (left > 0) & (left <= 8),
        "recently-played": still & (hours > 0) & (idle <= 30), "fallen-off": still & (hours > 0) & (idle >= 180),
        "long-haul": still & finite & (done < 65) & (length >= 40), "endless-rotation": still & F.col("endless"),
        "untouched": still & (hours == 0), "backlog": F.col("status") == "Not Started", "in-progress": F.col("status").isin("In Progress", "Sampled"),
        "must-play": F.col("priority") == "Must Play", "unplayed": hours == 0, "short": still & finite & (length <= 10),
    }
    return F.coalesce(rules[name], F.lit(False))


def smart_members(df: DataFrame, presets: tuple[str, ...], now: Column) -> DataFrame:
    """(user, preset, game) for every preset a row matches; each row is read once."""
    matched = F.filter(F.array(*[F.when(preset(p, now), F.lit(p)) for p in presets]), lambda x: x.isNotNull())
    return df.select("user_id", "appid", F.explode(matched).alias("preset"))


def completion_queue(df: DataFrame) -> DataFrame:
    """Probably finished games: at least 90 percent of an estimate of two hours or more; with confidence."""
    over = F.col("hours") * 60 / F.col("estimate")
    confidence = F.when(over <= 1.5, 1.0).when(over <= 2.5, 0.8).when(over <= 4, 0.6).otherwise(0.4)
    ready = active() & ~F.col("endless") & (F.col("estimate") >= 120) & (over >= 0.9)
    own = Window.partitionBy("user_id").orderBy(F.col("confidence").desc(), F.col("price_cents").desc(), "appid")
    return df.filter(ready).withColumn("confidence", confidence).withColumn("rank", F.row_number().over(own)).select("user_id", "rank", "appid", "confidence")


def purge_queue(df: DataFrame, protected: DataFrame, verdicts: DataFrame, now: Column, keep_days: int = 180, idle: int = 180) -> DataFrame:
    """Games to reconsider: active, not protected, without a fresh verdict, untouched or idle; with category, signal and confidence.

    A verdict to keep rests for ``keep_days``, any other for five minutes.  A played game without a date counts as idle for ever.
    Divisive games are easier to cut, liked ones harder.
    """
    age = F.unix_micros(now) - F.unix_micros("reviewed_at")
    fresh = F.when(F.col("action") == "keep", age < keep_days * DAY).otherwise(age < 5 * 60_000_000)
    rested = verdicts.filter(fresh).select("user_id", "appid").distinct()
    base = df.filter(active()).join(protected, ["user_id", "appid"], "left_anti").join(rested, ["user_id", "appid"], "left_anti")
    never, days = F.col("hours") == 0, F.coalesce(idle_days(now), F.lit(float("inf")))
    likely_done = ~F.col("endless") & (F.col("hours") * 60 / F.col("estimate") >= 0.9) & (F.col("estimate") >= 120)
    rows = base.filter(never | (days >= idle)).filter(~F.coalesce(likely_done, F.lit(False)))
    category = F.when(never, "untouched").when(F.col("percent") <= 50, "stalled").otherwise("dormant")
    if "appeal_kind" not in rows.columns:
        rows = rows.withColumn("appeal_kind", appeal(F.col("review_positive"), F.col("review_total"))["kind"])
    kind = F.col("appeal_kind")
    signal = F.when(kind == "divisive", "cut").when(kind != "none", "keep")
    score = (
        F.when(never, 2.0).otherwise(0.0) + F.when(days >= 730, 1.5).when(days >= 365, 1.0).otherwise(0.0)
        + F.when(signal == "cut", 2.0).when(signal == "keep", -2.5).otherwise(0.0)
    )
    own = Window.partitionBy("user_id").orderBy(F.col("confidence").desc(), "price_cents", "title", "appid")
    ranked = rows.withColumns({"category": category, "signal": signal, "confidence": score}).withColumn("rank", F.row_number().over(own))
    return ranked.select("user_id", "rank", "appid", "category", "signal", "confidence")


def superseded(action: Column, status: Column) -> Column:
    """Whether a verdict no longer matches the game's status."""
    wanted = F.when(action == "sleep", status != "Slept").when(action == "complete", status != "Completed")
    return wanted.when(action.isin("keep", "pin"), status.isin("Slept", "Completed")).otherwise(F.lit(False))


def in_flight(duration_status: Column, tags_status: Column, labels: Column) -> Column:
    """Whether catalogue work on a game is queued or running: by its statuses, or no genres and no status at all."""
    running = lambda c: F.coalesce(c.isin("pending", "processing"), F.lit(False))
    known = F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda x: (x != "") & (F.lower(x) != "unknown"))
    no_status = (F.coalesce(duration_status, F.lit("")) == "") & (F.coalesce(tags_status, F.lit("")) == "")
    return running(duration_status) | running(tags_status) | (~known & no_status)


def enrichment(df: DataFrame) -> DataFrame:
    """Per user: games, games in flight, games ready, percent ready (100 of nothing)."""
    busy = F.count_if(in_flight(F.col("duration_status"), F.col("tags_status"), F.col("labels")))
    return df.groupBy("user_id").agg(F.count("*").alias("total"), busy.alias("processing"), (F.count("*") - busy).alias("ready"), percent(F.count("*") - busy, F.count("*")).alias("percent_ready"))


def tabs(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(
        F.count_if(active()).alias("active"), F.count_if(F.col("status") == "Completed").alias("completed"),
        F.count_if(F.col("status") == "Slept").alias("slept"),
    )
