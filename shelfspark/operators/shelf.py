"""A user's shelf: library orders, recent activity, showcase, pins, draw history, ownership and device facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up

#: What a status counts in the status order, highest first.
STATUS_ORDER = {"Completed": 4, "In Progress": 3, "Not Started": 2, "Slept": 1}
SHOWN, HISTORY = 4, 50


def sort_keys(mode: str, reverse: bool = False) -> list[Column]:
    """Sort expressions of a library order; missing values come last and titles break ties; ``reverse`` turns all of it round.

    ``slept`` and ``completed`` are the orders of those tabs, the newest first.
    """
    status = F.create_map(*[F.lit(x) for pair in STATUS_ORDER.items() for x in pair])[F.col("status")]
    falling = {
        "recent": F.col("last_played_at"), "hours": F.col("hours"), "progress": F.col("percent"), "added": F.col("added_at"), "status": status,
        "slept": F.col("slept_at") if mode == "slept" else None, "completed": F.col("completed_at") if mode == "completed" else None,
    }
    rising = {"title": [], "duration": [F.col("estimate")]}
    first = [(falling[mode], True)] if mode in falling else [(c, False) for c in rising[mode]]
    keys = [*first, (F.col("title"), False), (F.col("appid"), False)]
    if reverse:
        return [c.asc_nulls_first() if down else c.desc_nulls_first() for c, down in keys]
    return [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in keys]


def positions(df: DataFrame, modes: list[str], reverse: bool = False) -> DataFrame:
    """Position of every game in its user's library, one column per order.

    Each order has a shuffle of its own by user and order: in one stage, a task would hold a library in as many sorts as there are orders.
    """
    own = lambda m: Window.partitionBy(F.struct("user_id", F.lit(m).alias("mode"))).orderBy(*sort_keys(m, reverse))
    for m in modes:
        df = df.withColumn(f"by_{m}", F.row_number().over(own(m)).cast("long"))
    return df.select("user_id", "appid", *[f"by_{m}" for m in modes])


def protected_ids(pins: DataFrame, snoozes: DataFrame, picks: DataFrame) -> DataFrame:
    """Games (``user_id``, ``appid``) that a clean-up must not ask about: pinned, snoozed or the current pick."""
    every = pins.select("user_id", "appid").unionByName(snoozes.select("user_id", "appid")).unionByName(picks.select("user_id", "appid"))
    return every.filter("appid is not null").distinct()


def settled(games: DataFrame, candidates: DataFrame, standing: DataFrame) -> DataFrame:
    """Active games that need no review: neither a candidate of the clean-up nor under a standing verdict."""
    keys = ["user_id", "appid"]
    active = games.filter(~F.col("status").isin("Completed", "Slept"))
    return active.join(candidates.select(*keys), keys, "left_anti").join(standing.select(*keys).distinct(), keys, "left_anti")


def recent_activity(df: DataFrame, k: int = SHOWN) -> DataFrame:
    """The k games that each user played last."""
    played = df.filter((F.col("hours") > 0) & F.col("last_played_at").isNotNull())
    order = Window.partitionBy("user_id").orderBy(*sort_keys("recent"))
    return played.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("user_id", "rank", "appid", "title")


def showcase(df: DataFrame, k: int = SHOWN) -> DataFrame:
    """The latest k completions of a user; the k most played games where nothing is completed.

    Each list is cut per user before the two meet.
    """
    finished = F.coalesce((F.col("status") == "Completed") & F.col("last_played_at").isNotNull(), F.lit(False))
    rows = df.withColumn("finished", finished).filter(F.col("finished") | (F.col("hours") >= 1))
    order = (F.when(F.col("finished"), F.col("last_played_at")).desc_nulls_last(), F.col("hours").desc(), F.col("appid"))
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "finished").orderBy(*order))).filter(F.col("rank") <= k)
    any_finished = F.max("finished").over(Window.partitionBy("user_id"))
    return top.withColumn("_any", any_finished).filter(F.col("finished") | ~F.col("_any")).select("user_id", "rank", "appid", "finished")


def playtime_totals(df: DataFrame) -> DataFrame:
    """Whole minutes and number of played games per user, as a day's snapshot stores them."""
    minutes = F.greatest(F.lit(0), half_up(F.coalesce("hours", F.lit(0.0)) * 60)).cast("long")
    return df.groupBy("user_id").agg(F.sum(minutes).alias("total_minutes"), F.count_if(minutes > 0).alias("played_games"))


def pin_progress(pins: DataFrame, library: DataFrame) -> DataFrame:
    """Pinned games still open, in slot order, with the hours gained since they were pinned.

    ``pins`` has ``user_id``, ``slot``, ``appid`` and ``hours_at_pin``; a game that is gone, completed or slept is
    dropped, and without hours at the time of pinning there is no gain to tell.
    """
    still = library.filter("status not in ('Completed', 'Slept')").select("user_id", "appid", "hours")
    gained = F.when(F.col("hours_at_pin").isNotNull(), F.greatest(F.lit(0.0), F.coalesce("hours", F.lit(0.0)) - F.col("hours_at_pin")))
    rows = pins.join(still, ["user_id", "appid"]).withColumn("gained", F.round(gained, 6))
    return rows.select("user_id", "slot", "appid", "gained", (F.col("gained") > 0.1).alias("started"))


def draw_history(draws: DataFrame, catalog: DataFrame, now: Column, k: int = HISTORY) -> DataFrame:
    """The latest k draws of each user under a calendar label, with their last event; unknown games keep a null title."""
    per = draws.groupBy("user_id", "draw_no").agg(
        F.first("appid").alias("appid"), F.first("drawn_at").alias("drawn_at"), F.count("event").alias("n_events"),
        F.max_by("event", F.struct("created_at", "event_id")).alias("last_event"),
    )
    newest = Window.partitionBy("user_id").orderBy(F.desc("drawn_at"), F.desc("draw_no"))
    kept = per.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= k)
    today = F.to_date("drawn_at") == F.to_date(now)
    label = F.when(today, "Today").otherwise(F.date_format("drawn_at", "EEEE d MMM"))
    return kept.join(catalog.select("appid", "title"), "appid", "left").select("user_id", "rank", "appid", "title", label.alias("label"), "n_events", "last_event")


def reconcile(owned: DataFrame, current: DataFrame) -> DataFrame:
    """Ownership after an import: games absent from the latest payload go back to the wishlist."""
    seen = current.select("user_id", "appid").distinct().withColumn("_seen", F.lit(True))
    return owned.join(seen, ["user_id", "appid"], "left").withColumn("ownership", F.when(F.col("_seen"), "Owned").otherwise("Wishlist")).drop("_seen")


def device_facts(wanted: DataFrame, verified: DataFrame, playable: DataFrame, mac: DataFrame) -> DataFrame:
    """Handheld grade (3 verified, 2 playable) and desktop support of wanted games; games in no index are left out."""
    marked = wanted.select("appid").distinct()
    for name, index in (("_verified", verified), ("_playable", playable), ("platform_mac", mac)):
        marked = marked.join(index.select("appid").distinct().withColumn(name, F.lit(True)), "appid", "left")
    grade = F.when(F.col("_verified"), 3).when(F.col("_playable"), 2).alias("deck_compatibility")
    return marked.select("appid", grade, "platform_mac").filter("deck_compatibility is not null or platform_mac")
