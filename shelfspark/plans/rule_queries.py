"""Registered queries of genres, classification, decks, labels and learned taste."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genres, labels, numeric
from ..functions.rules import MOODS
from ..functions.text import clean_name, content_hash, owner_bounds, redact, split_genres
from ..operators import classify, draw, preferences, scoring
from ..session import written
from ..sources import adapters
from . import queries as base

RAW_GENRES = (
    "Action / RPG", "Indie, Early Access", "casual; CASUAL | Puzzle", "Massively Multiplayer", "unknown", "Role  Playing / Story Rich", "Sandbox, Early Access",
    "Weird Tag", "Software Training/Utilities", "action , Shooter", "Early Access", "",
)
TAG_SETS = (
    {"Action": 100.0, "MMO": 70.0, "PvP": 60.0}, {"Story Rich": 90.0, "Clicker": 95.0}, {"Open World Survival Craft": 50.0, "Building": 100.0},
    {"Co-op": 80.0, "casual": 40.0, "Casual": 30.0, " Puzzle ": 40.0}, {"Idler": 12.4, "Old": 0.0, "Bad": -3.0}, {"Live Service": 5.0, "Sandbox": 4.0, "rpg": 4.0},
)


def pick(k, values):
    """The (k mod n)-th of several literals or columns."""
    columns = [v if not isinstance(v, (str, int, float, type(None))) else F.lit(v) for v in values]
    return F.element_at(F.array(*columns), (k % len(values) + 1).cast("int"))


def tag_sets(k):
    maps = [F.create_map(*[F.lit(x) for pair in tags.items() for x in pair]) for tags in TAG_SETS]
    return F.element_at(F.array(*maps), (k % len(TAG_SETS) + 1).cast("int"))


def part(s: SparkSession, d: str) -> DataFrame:
    return adapters.read(s, d, "part").withColumn("k", F.col("p_partkey"))


def spread(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """``part`` over all cores: the row groups of a small file would leave costly expressions to a task or two."""
    return part(s, d).select("k", *columns).repartition("k")


def top_level_genres(s, d):
    title = F.concat_ws(" ", "p_name", F.when(F.col("k") % 5 == 0, "Rally"))
    rows = spread(s, d, "p_name").select("k", title.alias("title"), split_genres(pick(F.col("k"), RAW_GENRES)).alias("labels"), pick(F.col("k"), RAW_GENRES).alias("raw"))
    of = F.col("labels"), F.col("title")
    return rows.select(
        F.col("k").alias("p_partkey"), F.array_join(genres.top_levels(*of), "|").alias("tops"), genres.normalised_labels(*of).alias("stored"), genres.display_label(*of).alias("shown"),
        genres.primary_genre(*of).alias("first"), F.array_join(genres.preference_genres(*of), "|").alias("keys"), genres.matches_top_level(*of, "Casual").alias("casual"),
        F.array_join(genres.split_labels(F.col("raw")), "|").alias("parts"),
    )


def tag_maps(s, d):
    tags = tag_sets(F.col("k"))
    sane = F.map_entries(genres.sane_tags(tags))
    return part(s, d).select(
        F.col("k").alias("p_partkey"), F.array_join(genres.tag_names(tags), "|").alias("names"), F.array_join(genres.tag_genres(tags, 2), "|").alias("genres"),
        F.array_join(F.array_sort(F.transform(sane, lambda e: F.concat_ws(":", e["key"], e["value"].cast("long")))), "|").alias("sane"),
        F.size(genres.positive_tags(tags)).cast("long").alias("positive"), classify.top_vote(tags).alias("top_vote"),
        F.array_join(F.array_sort(classify.dominant(tags)), "|").alias("dominant"),
    )


def classified(s: SparkSession, d: str) -> DataFrame:
    """Catalogue rows with kinds, lengths, tags and labels of every sort."""
    k = F.col("k")
    rows = part(s, d).select(
        (k + 1).alias("appid"), F.concat_ws(" ", "p_name", F.when(k % 37 == 0, "Factorio")).alias("title"), pick(k, RAW_GENRES).alias("genre"),
        pick(k, (None, "unknown", "finite", "endless", None)).alias("kind"), F.when(k % 3 == 0, F.col("p_size") * 10).alias("story"),
        F.when(k % 2 == 0, F.col("p_size") * F.when(k % 4 == 0, 300).otherwise(30)).alias("completion"), tag_sets(k).alias("tags"),
        F.array(pick(k, ("Survival", "Puzzle", "MMO"))).alias("categories"), (F.col("p_size") / 3).alias("hours"), pick(k, ("Completed", "Slept", "In Progress", "Not Started")).alias("status"),
        F.when(k % 7 == 1, (k % 130).cast("double")).alias("stored"),
    )
    return rows.withColumn("estimate", scoring.estimate_minutes(F.col("story"), F.lit(None).cast("int"), F.col("completion")))


def endless(kind: str = "kind"):
    return classify.is_endless(F.col(kind), F.col("story"), F.col("completion"), F.col("estimate"), F.col("title"), F.col("genre"))


def endless_rule(s, d):
    labels_of = genres.split_labels(F.col("genre"))
    return classified(s, d).select(
        "appid", endless().alias("endless"), classify.endless_shape(F.col("story"), F.col("completion")).alias("shape"), classify.story_driven(F.col("tags")).alias("story_driven"),
        classify.strong_replay(F.col("tags"), labels_of, F.col("categories")).alias("replay"),
        classify.should_mark_endless(F.col("kind"), [F.col("story"), F.col("completion")], F.col("tags"), labels_of, F.col("categories")).alias("mark"),
    )


def progress_guess(s, d):
    rows = classified(s, d).withColumn("endless", endless())
    rows = rows.withColumn("guess", classify.guessed_hours(F.col("estimate"), F.col("endless"), F.col("title"), F.col("genre")))
    rows = rows.withColumn("percent", classify.progress_of(F.col("status"), F.col("endless"), F.col("hours"), F.col("estimate"), F.col("stored"), F.col("guess")))
    status = classify.status_from_progress(F.col("percent"), F.col("endless"), F.col("hours"))
    return rows.select("appid", "guess", "percent", status.alias("status"), classify.length_label(F.col("endless"), F.col("guess")).alias("length"))


def genre_keys(s: SparkSession, d: str) -> DataFrame:
    """Genres in which preferences count, found once per game and by all cores."""
    games = adapters.facts(s, d).select("appid", "labels", "title").repartition("appid")
    return games.select("appid", genres.preference_genres(F.col("labels"), F.col("title")).alias("genres"))


def taste(s: SparkSession, d: str, library: DataFrame, games: DataFrame) -> DataFrame:
    rows = written(base.tallies(s, d), "tallies")
    return preferences.adjustment(games, rows, preferences.globals_of(rows), "intense", library=library)


def preference_adjustment(s, d):
    games = written(adapters.user_games(s, d).select("user_id", "appid").join(genre_keys(s, d), "appid"), "games")
    return taste(s, d, games, games).select("user_id", "appid", F.round("points", 5).alias("points"), "reason")


def taste_pick(s, d):
    """The softmax pick where taste counts."""
    owned = written(adapters.user_games(s, d).select("user_id", "appid", "status", "hours"), "owned")
    final = written(base.final(s, d, base.lib(s, d, owned)).drop("probability"), "final")
    games = final.select("user_id", "appid", genres.preference_genres(F.col("labels"), F.col("title")).alias("genres"))
    rows = final.join(taste(s, d, owned.join(genre_keys(s, d), "appid"), games), ["user_id", "appid"])
    return draw.pick(draw.softmax(rows.withColumn("value", F.col("value") + F.col("points")), "value"), base.user_u()).select("user_id", "rank", "appid")


def deferred_deck(s, d):
    pool = base.pool(s, d)
    deferred = base.lib(s, d).filter("appid % 4 = 0").select("user_id", "appid", (-F.col("appid")).alias("pos"))
    return draw.deferred_deck(pool, deferred).select("user_id", "place", "appid")


def deck_without_winner(s, d):
    deck = draw.deck(base.pool(s, d))
    left = draw.without_winner(deck, deck.filter((F.col("rank") == 1) | (F.col("rank") == 3) & (F.col("user_id") % 2 == 0)).filter("rank = if(user_id % 2 = 0, 3, 1)"))
    return draw.finalists(left).select("user_id", "rank", "appid")


def match_reasons(s, d):
    said = draw.reasons("evening", "intense", "new", base.CHOSEN, base.now())
    deck = draw.deck(base.pool(s, d)).withColumn("why", F.array_join(said, "; "))
    return deck.select("user_id", "rank", "appid", labels.match_label(F.col("score")).alias("label"), "why")


def match_insights(s, d):
    pool = base.pool(s, d)
    sizes = pool.groupBy("user_id").agg(F.count("*").alias("pool_size"))
    rows = draw.deck(pool).join(sizes, "user_id").withColumn("i", F.explode(draw.insights("evening", "intense", base.CHOSEN, F.col("pool_size"), base.now())))
    return rows.select("user_id", "appid", "i.kind", "i.strength", "i.headline")


def mood_labels(s, d):
    """Tags of the moods that reach 3, and the labels behind each mood."""
    rows = scoring.described(adapters.catalog(s, d))
    tagged = F.array_join(F.filter(F.array(*[F.when(F.col("moods")[m.replace("-", "_")] >= 3, m) for m in MOODS]), lambda x: x.isNotNull()), "|")
    why = [F.array_join(draw.mood_contributors(F.col("labels"), m), "|").alias(m.replace("-", "_")) for m in MOODS]
    return rows.select("appid", tagged.alias("moods"), *why)


def display_labels(s, d):
    """Labels of owned games; those of a game alone are made once in the catalogue, by all cores."""
    games = scoring.described(adapters.catalog(s, d).repartition("appid")).select(
        "appid", labels.review_count(F.col("review_total")).alias("reviews"), labels.money(F.col("price_cents")).alias("price"), labels.duration_label(F.col("estimate")).alias("length"),
        labels.ordinal(F.col("appid")).alias("nth"), classify.confidence(F.col("review_total") % 40).alias("trust"), classify.minutes_of(F.col("review_total") - 100).alias("minutes"),
    )
    rows = adapters.user_games(s, d).join(games, "appid")
    days = F.floor((F.unix_micros(base.now()) - F.unix_micros("last_played_at")) / labels.DAY)
    return rows.select(
        "user_id", "appid", labels.dormancy_headline(F.col("last_played_at"), base.now()).alias("paused"), labels.age_label(days).alias("age"), "reviews", "price", "length",
        labels.hours_label(F.col("hours") * 37).alias("hours"), "nth", "trust", "minutes", labels.day_key(F.col("added_at")).alias("day"), labels.days_between(F.col("added_at"), base.now()).alias("days"),
    )


def relative_ages(s, d):
    """Ages from texts such as "3d ago" or "Added 1999-01-05"."""
    k = F.col("k")
    text = pick(k, (F.concat((k % 50).cast("string"), F.lit("d ago")), F.concat((k % 9).cast("string"), F.lit(" w ago")), F.lit("Added 1999-01-05"), F.lit("Not played recently"), F.lit("2y ago"), F.lit("6h ago"), F.lit("1m ago")))
    days = labels.age_days(text, base.now())
    return part(s, d).select(F.col("k").alias("p_partkey"), F.when(F.isnan(days) | (days == float("inf")), None).otherwise(F.round(days, 6)).alias("days"))


def share_cards(s, d):
    """Headline and lines of a card per user."""
    from ..operators import stats

    b = stats.backlog_stats(base.lib(s, d))
    said = F.concat(labels.money(F.col("completed_cents")), F.lit(" of "), labels.money(F.col("library_cents")), F.lit(" finished"))
    games = F.concat(F.col("completed_games").cast("string"), F.lit(" of "), F.col("total_games").cast("string"))
    return b.select("user_id", said.alias("headline"), "value_percent", games.alias("games"), labels.hours_label(F.col("total_hours")).alias("hours"), "unplayed_games")


def recap_lines(s, d):
    return base.visit_recap(s, d).select("user_id", labels.recap_line(F.col("minutes"), F.col("games_finished")).alias("line"))


def clean_values(s, d):
    """Names, owner ranges, ids, hashes, secrets and retry times."""
    k = F.col("k")
    spaced = F.concat(F.lit("  "), F.initcap("p_name"), F.lit("  é "), F.col("p_type"), F.lit("\t"))
    owners = F.concat(F.format_number(k * 1000, 0), F.lit(" .. "), F.format_number(k * 2000, 0))
    secret = F.concat(F.lit("call Bearer abc."), k.cast("string"), F.lit(" client_secret=x"), k.cast("string"), F.lit("&n=1"))
    raw_id = pick(k, (k.cast("string"), F.concat(F.lit("0"), k.cast("string")), F.lit("4294967296"), F.lit("-1"), F.lit("x")))
    return part(s, d).select(
        k.alias("p_partkey"), clean_name(spaced).alias("name"), owner_bounds(owners)["low"].alias("low"), owner_bounds(owners)["high"].alias("high"),
        numeric.uint32_or_null(raw_id).alias("id"), content_hash(F.col("p_name"), F.col("p_type")).alias("hash"), redact(secret).alias("hidden"),
        numeric.backoff_minutes(k % 12).alias("backoff"),
    )


NAMES = (
    "top_level_genres tag_maps endless_rule progress_guess preference_adjustment taste_pick deferred_deck deck_without_winner match_reasons match_insights "
    "mood_labels display_labels relative_ages share_cards recap_lines clean_values"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}
