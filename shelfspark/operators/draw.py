"""Draws: eligibility funnel, pool, deck, finalists, softmax and uniform picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.genres import display_key
from ..functions.numeric import half_up
from ..functions.rules import MOOD_RULES, MOODS
from ..functions.text import genre_key, mood_tag
from . import scoring

DECK, TEMPERATURE = 64, 15.0


def stages(df: DataFrame, goal: str, genres: list[str]) -> DataFrame:
    """Add the funnel's conditions: active, of a chosen genre, eligible for the goal."""
    chosen = keyed(F.array(*map(F.lit, genres))) if genres else None
    return df.withColumns(
        {
            "is_active": ~F.col("status").isin("Completed", "Slept"),
            "genre_ok": F.arrays_overlap(scoring.label_keys(df), chosen) if genres else F.lit(True),
            "goal_ok": scoring.goal_eligible(goal, F.col("status"), F.col("hours"), F.col("endless"), F.col("percent")),
        }
    )


def funnel(df: DataFrame, goal: str, genres: list[str]) -> DataFrame:
    """Rows left after each stage, per user, in one aggregation."""
    s = stages(df, goal, genres)
    return s.groupBy("user_id").agg(
        F.count("*").alias("owned"), F.count_if("is_active").alias("active"),
        F.count_if(F.col("is_active") & F.col("genre_ok")).alias("genre"),
        F.count_if(F.col("is_active") & F.col("genre_ok") & F.col("goal_ok")).alias("goal"),
    )


def keyed(labels: Column) -> Column:
    """Canonical keys of labels, as both sides of a genre match are compared."""
    return F.transform(labels, genre_key)


def funnel_stages(games: DataFrame, snoozed: DataFrame, goal: str | None, genres: list[str], members: DataFrame | None = None, deck_size: int = DECK) -> DataFrame:
    """The stages of every user's funnel that apply, as (``user_id``, ``place``, ``stage``, ``count``, ``detail``).

    ``games`` are owned rows (``user_id``, ``appid``, ``status``, ``hours``, ``percent``, ``endless``, ``labels``), ``snoozed`` and ``members`` (of the collection to draw from)
    hold ``user_id``, ``appid``.  A collection draw ignores genres and goal.  Genres match by canonical keys; at most three may be chosen.  The stage ``active`` stands
    where games are completed or asleep and tells how many, ``snoozes`` where a snooze takes something away, ``shortlist`` where more games
    are left than the deck holds.  All counts come from one aggregation.
    """
    if len(genres) > 3:
        raise ValueError("Select no more than 3 genres.")
    mark = lambda df, name: df.select("user_id", "appid").distinct().withColumn(name, F.lit(True))
    rows = games.join(mark(snoozed, "_snoozed"), ["user_id", "appid"], "left")
    rows = rows.join(mark(members, "_member"), ["user_id", "appid"], "left") if members is not None else rows.withColumn("_member", F.lit(True))
    if members is not None:
        genres, goal = [], None
    active = ~F.col("status").isin("Completed", "Slept")
    inside = active & F.coalesce(F.col("_member"), F.lit(False))
    of_genre = inside & F.arrays_overlap(keyed(F.col("labels")), keyed(F.array(*map(F.lit, genres)))) if genres else inside
    of_goal = of_genre & scoring.goal_eligible(goal, F.col("status"), F.col("hours"), F.col("endless"), F.col("percent")) if goal else of_genre
    left = of_goal & F.col("_snoozed").isNull()
    counted = {"library": F.lit(True), "completed": F.col("status") == "Completed", "slept": F.col("status") == "Slept", "active": active, "inside": inside, "genres": of_genre, "goal": of_goal, "available": left}
    per = rows.groupBy("user_id").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counted.items()])
    removed = F.concat_ws(" · ", *[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(label))) for c, label in (("completed", " completed"), ("slept", " asleep"))])
    nothing = F.lit(None).cast("string")
    known = [
        ("library", F.col("library"), nothing, F.lit(True)), ("active", F.col("active"), removed, F.col("completed") + F.col("slept") > 0), ("collection", F.col("inside"), nothing, F.lit(members is not None)),
        ("genres", F.col("genres"), nothing, F.lit(bool(genres))), ("goal", F.col("goal"), nothing, F.lit(goal not in (None, "surprise"))), ("snoozes", F.col("available"), nothing, F.col("goal") > F.col("available")),
        ("available", F.col("available"), nothing, F.lit(True)), ("shortlist", F.lit(deck_size).cast("long"), nothing, F.col("available") > deck_size),
    ]
    each = [F.when(shown, F.struct(F.lit(name).alias("stage"), count.alias("count"), detail.alias("detail"))) for name, count, detail, shown in known]
    return per.select("user_id", F.posexplode(F.array_compact(F.array(*each))).alias("pos", "s")).select("user_id", (F.col("pos") + 1).alias("place"), "s.*")


def by_rank(*keys: str) -> list[Column]:
    return [F.col("score").desc(), F.col("title"), F.col("appid"), *map(F.col, keys)]


def deck(df: DataFrame, limit: int = DECK) -> DataFrame:
    """The best ``limit`` rows per user by score, title and id, with ``rank``."""
    own = Window.partitionBy("user_id").orderBy(*by_rank())
    return df.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= limit)


def finalists(df: DataFrame) -> DataFrame:
    """All of up to five; else 40 percent of the deck, between 3 and 20."""
    n = F.count("*").over(Window.partitionBy("user_id"))
    cut = F.when(n <= 5, n).otherwise(F.least(F.lit(20), F.greatest(F.lit(3), F.ceil(0.4 * n))))
    return df.withColumn("_cut", cut).filter("rank <= _cut").drop("_cut")


def softmax(df: DataFrame, value: str) -> DataFrame:
    """Add ``probability``: softmax of ``value`` within a user at the fixed temperature."""
    own = Window.partitionBy("user_id")
    weight = F.exp((F.col(value) - F.max(value).over(own)) / TEMPERATURE)
    return df.withColumn("_w", weight).withColumn("probability", F.col("_w") / F.sum("_w").over(own)).drop("_w")


def pick(df: DataFrame, u: Column) -> DataFrame:
    """The row per user where the cumulative probability in rank order first reaches ``u``."""
    upto = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    reached = df.withColumn("_c", F.round(F.sum("probability").over(upto), 9)).filter(F.col("_c") >= u)
    first = Window.partitionBy("user_id").orderBy("rank")
    return reached.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "_c")


def quick_pick(df: DataFrame, u: Column, winners: DataFrame | None = None) -> DataFrame:
    """A uniform pick per user: row floor(u * n) in rank order, without the previous winner (``winners``: user, game) unless it is alone."""
    df = df if winners is None else without_winner(df, winners)
    n = F.count("*").over(Window.partitionBy("user_id"))
    return df.withColumn("_n", n).filter(F.col("rank") - 1 == F.floor(u * F.col("_n"))).drop("_n")


def deferred_deck(pool: DataFrame, deferred: DataFrame, limit: int = DECK) -> DataFrame:
    """The deck with deferred games at its end: what is left by rank, then ``deferred`` (user, game, pos) in its order; adds ``place``."""
    rows = pool.join(deferred.select("user_id", "appid", F.col("pos").alias("_pos")), ["user_id", "appid"], "left")
    order = Window.partitionBy("user_id").orderBy(F.col("_pos").isNotNull(), "_pos", *by_rank())
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("_pos")


def without_winner(pool: DataFrame, winners: DataFrame) -> DataFrame:
    """Rows of a ranked pool without the previous winner of each user, unless it is the only one; ranked anew."""
    n = F.count("*").over(Window.partitionBy("user_id"))
    rows = pool.withColumn("_n", n).join(winners.select("user_id", "appid", F.lit(True).alias("_won")), ["user_id", "appid"], "left")
    kept = rows.filter(F.col("_won").isNull() | (F.col("_n") == 1)).drop("_n", "_won")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("rank")))


def mood_contributors(labels: Column, mood: str, limit: int = 3) -> Column:
    """The labels that add most to a mood, each tag once, ties in label order."""
    k = MOODS.index(mood)
    table = F.create_map(*[F.lit(x) for tag, rule in MOOD_RULES.items() if rule[k] > 0 for x in (tag, rule[k])])
    tagged = F.transform(labels, lambda x, i: F.struct(F.coalesce(table[mood_tag(x)], F.lit(0)).alias("weight"), (-i).alias("back"), x.alias("label"), mood_tag(x).alias("tag")))
    once = F.filter(tagged, lambda e, i: (e["weight"] > 0) & ~F.exists(F.slice(tagged, 1, i), lambda y: y["tag"] == e["tag"]))
    return F.transform(F.slice(F.reverse(F.array_sort(once)), 1, limit), lambda e: e["label"])


def _fit(ratio: Column, high: str, middle: str, low: str) -> Column:
    return F.when(ratio >= 0.93, high).when(ratio >= 0.8, middle).otherwise(low)


SESSIONS = {"short": "Short Session", "evening": "Evening Session", "weekend": "Weekend Session"}


def reasons(session: str | None, mood: str | None, goal: str | None, genres: list[str], now: Column, taste: Column | None = None) -> Column:
    """Up to four reasons for a library row: session, mood, goal, pause, genres, taste, appeal, in this order."""
    out: list[Column] = []
    if session:
        name = SESSIONS[session].lower()
        ratio = scoring.session_points(session, F.col("fits"), F.col("endless"), F.col("remaining")) / 30
        out.append(F.when(F.col("endless"), "Endless · play any length").otherwise(_fit(ratio, f"Ideal {name} length", f"Good {name} length", f"{SESSIONS[session]} fit")))
    if mood:
        shown, score = mood.title(), F.col("moods")[mood.replace("-", "_")]
        out.append(F.when(score >= 7, f"Perfect {shown} match").when(score >= 5, f"Strong {shown} match").when(score >= 3, f"Solid {shown} match"))
    if goal == "new":
        out.append(F.when(F.col("hours") == 0, "Unplayed").otherwise("Barely sampled"))
    if goal == "finish":
        left = F.greatest(F.lit(1), half_up(F.col("remaining")).cast("long"))
        out.append(F.when(F.col("estimate").isNull(), F.concat(F.col("percent").cast("string"), F.lit("% complete"))).otherwise(F.concat(left.cast("string"), F.lit("h left"))))
    if goal == "surprise":
        out.append(F.lit("Wildcard"))
    out.append(labels.dormancy_reason(F.col("last_played_at"), now))
    if genres:
        own = F.transform("labels", genre_key)
        shared = F.filter(F.array(*[F.lit(g) for g in genres]), lambda g: F.array_contains(own, genre_key(g)))
        names = F.array_join(F.transform(shared, lambda g: display_key(genre_key(g), "rpg")), " · ")
        out.append(F.when(F.size(shared) > 0, names))
    if taste is not None:
        out.append(taste)
    out.append(labels.appeal_label(scoring.appeal(F.col("review_positive"), F.col("review_total"))["kind"]))
    return F.slice(F.filter(F.array(*out), lambda x: x.isNotNull()), 1, 4)


def insights(session: str, mood: str, genres: list[str], pool_size: Column, now: Column) -> Column:
    """array<struct<kind, strength, headline>> that explains a ranked row of a draw for something new."""
    name, score = SESSIONS[session].lower(), F.col("moods")[mood.replace("-", "_")]
    ratio = scoring.session_points(session, F.col("fits"), F.col("endless"), F.col("remaining")) / 30
    drivers = F.size(mood_contributors(F.col("labels"), mood))
    own = F.transform("labels", genre_key)
    shared = F.filter(F.array(*[F.lit(g) for g in genres]), lambda g: F.array_contains(own, genre_key(g)))
    said = F.array_join(F.transform(shared, lambda g: display_key(genre_key(g), "rpg")), " and ")
    liked = scoring.appeal(F.col("review_positive"), F.col("review_total"))
    of = F.concat(F.lit(" of "), pool_size.cast("string"), F.lit(" games"))

    def one(when: Column, kind: str, strength: Column, headline: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), strength.alias("strength"), headline.alias("headline")))

    grade = lambda x, high, low: F.when(x >= high, "perfect").when(x >= low, "strong").otherwise("good")
    paused = labels.dormancy_headline(F.col("last_played_at"), now)
    every = [
        one(pool_size > 1, "selection", F.when(F.col("rank") <= 3, "perfect").when(F.col("rank") <= 10, "strong").otherwise("good"),
            F.when(F.col("rank") == 1, F.concat(F.lit("Best fit"), of)).otherwise(F.concat(F.lit("Ranked "), labels.ordinal(F.col("rank")), of))),
        one(F.lit(True), "session", grade(ratio, 0.93, 0.8), F.when(F.col("endless"), "Plays to any length").otherwise(_fit(ratio, f"Ideal {name} length", f"Good {name} length", f"Workable {name} length"))),
        one((score >= 1) | (drivers > 0), "mood", grade(score, 7, 5), F.concat(F.when(score >= 7, "Perfect").when(score >= 5, "Strong").otherwise("Fair"), F.lit(f" {mood.title()} match"))),
        one(F.lit(True), "goal", F.when(F.col("hours") == 0, "perfect").otherwise("strong"), F.when(F.col("hours") == 0, "Never played").otherwise("Barely sampled")),
        one(paused.isNotNull(), "dormancy", F.lit("strong"), paused),
        one(F.size(shared) > 0, "genre", F.when(F.size(shared) == len(genres), "perfect").otherwise("strong"), F.concat(said, F.lit(", as asked"))),
        one(liked["kind"] != "none", "appeal", F.when(liked["points"] >= 3, "perfect").when(liked["points"] > 0, "strong").otherwise("good"), labels.appeal_label(liked["kind"])),
    ]
    return F.filter(F.array(*every), lambda x: x.isNotNull())


def explanation(session: str | None, mood: str | None, goal: str | None, genres: list[str], pool_size: Column, now: Column, taste: Column | None = None, preference_points: Column | None = None) -> Column:
    """array<struct<kind, strength, headline, detail>>: the case for a ranked row (``rank``, ``score`` and a library row) of a draw.

    What the draw did not use is not claimed: without a session, mood, goal or genres their lines are left out, as are those whose evidence is
    missing.  ``taste`` is the learned line of the pick (null where there is none), graded by ``preference_points``.
    """
    text = lambda x: x.cast("string")
    plain = lambda x: F.regexp_replace(text(x), r"\.0$", "")
    grade = lambda x, high, low: F.when(x >= high, "perfect").when(x >= low, "strong").otherwise("good")
    left, hours = F.when(~F.col("endless"), F.col("remaining")), F.col("estimate") / 60
    every: list[Column] = []

    def say(when: Column, kind: str, strength: Column, headline: Column, detail: Column) -> None:
        every.append(F.when(when, F.struct(F.lit(kind).alias("kind"), strength.alias("strength"), headline.alias("headline"), detail.alias("detail"))))

    of = F.concat(F.lit(" of "), text(pool_size), F.lit(" games"))
    say(
        pool_size > 1, "selection", F.when(F.col("rank") <= 3, "perfect").when(F.col("rank") <= 10, "strong").otherwise("good"),
        F.when(F.col("rank") == 1, F.concat(F.lit("Best fit"), of)).otherwise(F.concat(F.lit("Ranked "), labels.ordinal(F.col("rank")), of)),
        F.concat(F.lit("Scored "), text(F.col("score")), F.lit("/100 against everything else your setup allows.")),
    )
    if session:
        name = SESSIONS[session].lower()
        ratio = scoring.session_points(session, F.col("fits"), F.col("endless"), F.col("remaining")) / 30
        about = F.when(left < 1, "Under an hour left").otherwise(F.concat(F.lit("Roughly "), labels.whole(left), F.lit("h left")))
        fits = {"short": left <= 3, "evening": (left >= 10) & (left <= 30), "weekend": left > 30}[session]
        high, low = {
            "short": (" — you could see the end of it tonight.", ", so one sitting makes real progress."),
            "evening": (" — a few evenings, which is exactly the shape you asked for.", ", so an evening covers a good chunk of it."),
            "weekend": (" — enough to properly sink into over a weekend.", ", so a weekend would see it finished."),
        }[session]
        said = F.concat(about, F.when(fits, high).otherwise(low))
        say(
            F.lit(True), "session", grade(ratio, 0.93, 0.8), F.when(F.col("endless"), "Plays to any length").otherwise(_fit(ratio, f"Ideal {name} length", f"Good {name} length", f"Workable {name} length")),
            F.when(F.col("endless"), "No fixed ending, so you can stop whenever you like.").when(left.isNull(), "No length estimate yet, so this is neither helped nor penalised.").otherwise(said),
        )
    if mood:
        score, drivers, shown = F.col("moods")[mood.replace("-", "_")], mood_contributors(F.col("labels"), mood), mood.title()
        say(
            (score >= 1) | (F.size(drivers) > 0), "mood", grade(score, 7, 5), F.concat(F.when(score >= 7, "Perfect").when(score >= 5, "Strong").otherwise("Fair"), F.lit(f" {shown} match")),
            F.when(F.size(drivers) > 0, F.concat(F.lit("Tagged "), F.array_join(drivers, ", "), F.lit(f" — that is what gives it the {shown} feel.")))
            .when(score >= 5, f"Its overall tag mix reads strongly {shown}.").otherwise(f"Nothing about it pulls against a {shown} night."),
        )
    if goal == "finish":
        through, near = F.concat(F.lit("You're "), text(F.col("percent")), F.lit("% through")), text(F.greatest(F.lit(1), half_up(left)).cast("long"))
        say(
            F.col("percent") > 0, "goal", grade(F.col("percent"), 80, 40), F.when(left.isNull(), F.concat(text(F.col("percent")), F.lit("% through"))).otherwise(F.concat(F.lit("About "), near, F.lit("h from the credits"))),
            F.when(left.isNull(), F.concat(through, F.lit(", so finishing it is realistic."))).otherwise(F.concat(through, F.lit(" a game of roughly "), labels.whole(hours), F.lit("h — the ending is genuinely in reach."))),
        )
    if goal == "new":
        say(
            F.lit(True), "goal", F.when(F.col("hours") == 0, "perfect").otherwise("strong"), F.when(F.col("hours") == 0, "Never played").otherwise("Barely sampled"),
            F.when(F.col("hours") == 0, "It has been sitting in your library waiting for exactly this.").otherwise(F.concat(F.lit("Only "), plain(F.col("hours")), F.lit("h in, so there is still a whole game here."))),
        )
    paused, days = labels.dormancy_headline(F.col("last_played_at"), now), labels.days_between(F.col("last_played_at"), now)
    last = F.concat(F.lit("Last played "), F.date_format("last_played_at", "MMMM yyyy"))
    ending = F.when(days >= 365, ". This is exactly the kind of game the Vault exists to resurface.").when(days >= 60, ", so it is well overdue another look.").otherwise(".")
    say(paused.isNotNull(), "dormancy", F.lit("strong"), paused, F.concat(last, ending))
    if genres:
        own, chosen = keyed(F.col("labels")), F.array(*map(F.lit, genres))
        shared = F.filter(chosen, lambda g: F.array_contains(own, genre_key(g)))
        names = lambda gs, by: F.array_join(F.transform(gs, lambda g: display_key(genre_key(g), "rpg")), by)
        said = F.concat(F.lit("You filtered for "), names(chosen, ", "), F.lit(" and this matches "), text(F.size(shared)), F.lit(f" of {len(genres)}."))
        say(F.size(shared) > 0, "genre", F.when(F.size(shared) == len(genres), "perfect").otherwise("strong"), F.concat(names(shared, " and "), F.lit(", as asked")), said)
    total, liked = F.col("review_total"), scoring.appeal(F.col("review_positive"), F.col("review_total"))
    share = F.concat(labels.whole(F.least(F.lit(1.0), F.col("review_positive") / F.nullif(total, F.lit(0))) * 100), F.lit("% positive "))
    count = labels.review_count(total)
    why = (
        F.when(liked["kind"] == "phenomenon", F.concat(share, F.lit("across "), count, F.lit(" reviews — this one is a landmark."))).when(liked["kind"] == "acclaimed", F.concat(share, F.lit("across "), count, F.lit(" reviews.")))
        .when(liked["kind"] == "hidden-gem", F.concat(share, F.lit("from only "), count, F.lit(" reviews — beloved by the few who found it.")))
        .when(liked["kind"] == "divisive", F.concat(F.lit("Only "), share, F.lit("across "), count, F.lit(" reviews, so expect a rough edge or two.")))
    )
    say(liked["kind"] != "none", "appeal", F.when(liked["points"] >= 3, "perfect").when(liked["points"] > 0, "strong").otherwise("good"), labels.appeal_label(liked["kind"]), why)
    if taste is not None:
        points = preference_points if preference_points is not None else F.lit(0.0)
        say(taste.isNotNull(), "taste", F.when(points >= 5, "perfect").otherwise("strong"), taste, F.lit("Drawn from what you have actually launched and liked before, not what you told us."))
    return F.array_compact(F.array(*every))
