"""Row-level scoring: durations, progress, moods, sessions, fit score, appeal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, half_up
from ..functions.rules import MOOD_PAIRS, MOOD_RULES, MOODS
from ..functions.text import genre_key, mood_tag


def estimate_minutes(*estimates: Column) -> Column:
    """Mean of the positive estimates to the nearest hour, one hour at least; null without any."""
    known = F.filter(F.array(*[e.cast("double") for e in estimates]), lambda x: x > 0)
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.when(F.size(known) > 0, F.greatest(half_up(mean / 60) * 60, F.lit(60)))


def progress(status: Column, endless: Column, hours: Column, estimate: Column) -> Column:
    """Percent done: 100 if completed, 99 if endless, else hours against the estimate, 99 at most."""
    ratio = clamp(half_up(hours * 6000 / estimate), 0, 99)
    return F.when(status == "Completed", 100).when(endless, 99).when(estimate.isNotNull(), ratio).otherwise(0).cast("long")


def remaining_hours(estimate: Column, percent: Column) -> Column:
    return estimate * F.greatest(F.lit(0.05), 1 - clamp(percent, 0, 99) / 100) / 60


def session_fits(endless: Column, remaining: Column) -> Column:
    """Sessions that a game can be played in; fits run upward from the shortest."""
    names = [F.lit(x) for x in ("short", "evening", "weekend")]
    return (
        F.when(endless | remaining.isNull() | (remaining <= 10), F.array(*names))
        .when(remaining <= 30, F.array(*names[1:]))
        .otherwise(F.array(names[2]))
    )


def mood_scores(labels: Column) -> Column:
    """struct of one score per mood: rule sums over distinct tags plus pair bonuses, between -10 and 10."""
    tags = F.array_distinct(F.transform(labels, mood_tag))
    has = lambda names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))

    def score(k: int) -> Column:
        table = F.create_map(*[F.lit(x) for tag, rule in MOOD_RULES.items() if rule[k] for x in (tag, rule[k])])
        rules = F.aggregate(tags, F.lit(0), lambda acc, t: acc + F.coalesce(table[t], F.lit(0)))
        bonus = [F.when(has(a) & has(b), v[k]).otherwise(0) for a, b, v in MOOD_PAIRS if v[k]]
        return clamp(sum(bonus, rules), -10, 10)

    return F.struct(*[score(k).alias(m.replace("-", "_")) for k, m in enumerate(MOODS)])


def session_points(session: str, fits: Column, endless: Column, remaining: Column) -> Column:
    """Up to 30 points for how well the remaining hours fill a session."""
    if session == "short":
        fit = F.when(remaining <= 3, 30).when(remaining <= 6, 28).otherwise(26)
    elif session == "evening":
        fit = F.when((remaining >= 10) & (remaining <= 30), 30).when(remaining >= 6, 26).otherwise(22)
    else:
        fit = F.when(remaining > 30, 30).when(remaining >= 15, 26).otherwise(21)
    return (
        F.when(~F.array_contains(fits, session), 0).when(endless, 27 if session == "weekend" else 24)
        .when(remaining.isNull(), 20).otherwise(fit)
    )


def mood_points(score: Column) -> Column:
    steps = [(7, 30), (5, 27), (3, 23), (1, 18), (-1, 13), (-3, 8)]
    out = F.when(score >= steps[0][0], steps[0][1])
    for at, points in steps[1:]:
        out = out.when(score >= at, points)
    return out.otherwise(3)


def new_game_points(hours: Column) -> Column:
    return F.when(hours <= 0, 30).when(hours <= 0.25, 27).otherwise(24)


def finish_points(percent: Column, remaining: Column) -> Column:
    near = F.when(remaining <= 2, 10).when(remaining <= 5, 9).when(remaining <= 10, 8).when(remaining <= 20, 6).otherwise(4)
    return F.least(F.lit(30), half_up(8 + F.least(F.lit(12.0), 0.12 * percent) + near)).cast("int")


def goal_eligible(goal: str, status: Column, hours: Column, endless: Column, percent: Column) -> Column:
    if goal == "new":
        return (status == "Not Started") & (hours <= 0.5)
    if goal == "finish":
        return ~endless & ((status == "In Progress") | ((percent > 0) & (percent < 100)))
    return F.lit(True)


def appeal(positive: Column, total: Column) -> Column:
    """struct<points, kind>: how broadly and how well a game is liked; 0 and none below 50 reviews."""
    share = F.when(total > 0, F.least(F.lit(1.0), positive / total)).otherwise(0.0)
    volume = F.log10(F.greatest(F.lit(1.0), total.cast("double")))
    reach, liked = clamp((volume - 2.5) / 3.5, 0.0, 1.0), clamp((share - 0.5) / 0.35, 0.0, 1.0)
    trusted = total >= 50
    hype = F.when(trusted, reach * liked).otherwise(0.0)
    gem = F.when(trusted, clamp((share - 0.8) / 0.2, 0.0, 1.0) * clamp((3.6 - volume) / 2, 0.0, 1.0)).otherwise(0.0)
    low = trusted & (share < 0.55)
    kind = (
        F.when(low, "divisive").when(gem >= 0.3, "hidden-gem").when(hype >= 0.6, "phenomenon")
        .when((hype >= 0.3) & (share >= 0.9), "acclaimed").otherwise("none")
    )
    return F.struct(clamp(4 * hype + 4 * gem - F.when(low, 3.0).otherwise(0.0), -6.0, 6.0).alias("points"), kind.alias("kind"))


def described(catalog: DataFrame) -> DataFrame:
    """The catalogue with what depends on its row alone: estimate in minutes, mood scores, rating out of 10, kind of appeal, keys of labels."""
    estimate = estimate_minutes(F.col("main_story"), F.col("main_extras"), F.col("completionist"))
    rating = F.when(F.col("review_total") > 0, half_up(F.col("review_positive") * 10 / F.col("review_total"))).otherwise(0)
    kind, keys = appeal(F.col("review_positive"), F.col("review_total"))["kind"], F.transform("labels", genre_key)
    return catalog.withColumns({"estimate": estimate, "moods": mood_scores(F.col("labels")), "rating": rating.cast("long"), "appeal_kind": kind, "label_keys": keys})


def library(owned: DataFrame, catalog: DataFrame) -> DataFrame:
    """The scored read model: every owned game with its catalogue facts and derived columns."""
    joined = owned.join(described(catalog), "appid")
    joined = joined.withColumn("percent", progress(F.col("status"), F.col("endless"), F.col("hours"), F.col("estimate")))
    joined = joined.withColumn("remaining", remaining_hours(F.col("estimate"), F.col("percent")))
    return joined.withColumn("fits", session_fits(F.col("endless"), F.col("remaining")))


def label_keys(df: DataFrame) -> Column:
    """Canonical keys of a row's labels; library rows have them."""
    return F.col("label_keys") if "label_keys" in df.columns else F.transform("labels", genre_key)


def fit_score(df: DataFrame, session: str | None = None, mood: str | None = None, goal: str | None = None, genres: list[str] | None = None) -> DataFrame:
    """Add ``score``: percent of the points that the supplied choices make available."""
    parts: list[tuple[Column, int]] = []
    if session:
        parts.append((session_points(session, F.col("fits"), F.col("endless"), F.col("remaining")), 30))
    if mood:
        parts.append((mood_points(F.col("moods")[mood.replace("-", "_")]), 30))
    if goal == "new":
        parts.append((new_game_points(F.col("hours")), 30))
    if goal == "finish":
        parts.append((finish_points(F.col("percent"), F.col("remaining")), 30))
    if genres:
        chosen = F.array(*[genre_key(F.lit(g)) for g in genres])
        own = label_keys(df)
        parts.append((10.0 * F.size(F.filter(chosen, lambda g: F.array_contains(own, g))) / len(genres), 10))
    available = sum(p for _, p in parts)
    earned = sum((c for c, _ in parts), F.lit(0.0))
    return df.withColumn("score", (half_up(100 * earned / available) if available else F.lit(0)).cast("long"))
