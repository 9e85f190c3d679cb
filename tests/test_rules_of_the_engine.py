"""Cases that decide between readings of a rule: appeal, clean-up, presets, statistics, recap, exclusions, work in flight."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import catalogue, playtime, scoring, stats

NOW = dt.datetime(2026, 7, 20)
SCHEMA = (
    "user_id long, appid long, title string, status string, hours double, percent long, endless boolean, estimate double, price_cents long, "
    "review_positive long, review_total long, last_played_at timestamp, completed_at timestamp, priority string, rating long, labels array<string>, "
    "duration_status string, tags_status string"
)
BASE = {
    "user_id": 1, "title": "t", "status": "Not Started", "hours": 0.0, "percent": 0, "endless": False, "estimate": None, "price_cents": 0, "review_positive": 0,
    "review_total": 0, "last_played_at": None, "completed_at": None, "priority": "Medium", "rating": 0, "labels": ["Action"], "duration_status": "ready", "tags_status": "ready",
}


def games(spark, *rows):
    full = [{**BASE, "appid": k + 1, **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in full], SCHEMA)


def ago(days):
    return NOW - dt.timedelta(days=days)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "positive, total, kind",
    [
        (540, 1000, "divisive"), (560, 1000, "none"), (960_000, 1_000_000, "phenomenon"), (28_500, 30_000, "acclaimed"), (25_000, 30_000, "none"),
        (196, 200, "hidden-gem"), (49, 49, "none"), (0, 0, "none"), (70, 60, "hidden-gem"),
    ],
)
def test_appeal_kinds_by_trust_and_order(spark, positive, total, kind):
    assert one(spark, scoring.appeal(F.lit(positive), F.lit(total))).kind == kind


def queue(spark, df, protected=(), verdicts=()):
    p = spark.createDataFrame([(1, k) for k in protected], "user_id long, appid long")
    v = spark.createDataFrame([(1, k, a, at) for k, a, at in verdicts], "user_id long, appid long, action string, reviewed_at timestamp")
    return stats.purge_queue(df, p, v, F.lit(NOW)).orderBy("rank").collect()


def test_played_games_without_a_date_are_idle_for_ever(spark):
    got = queue(spark, games(spark, {"hours": 3.0, "percent": 20}, {"hours": 3.0, "last_played_at": ago(100)}, {"hours": 3.0, "percent": 60, "last_played_at": ago(400)}))
    assert [(r.appid, r.category, r.confidence) for r in got] == [(1, "stalled", 1.5), (3, "dormant", 1.0)]


def test_reviews_move_the_queue(spark):
    got = queue(spark, games(spark, {}, {"review_positive": 960_000, "review_total": 1_000_000}, {"review_positive": 400, "review_total": 1000}, {"price_cents": 50}))
    assert [(r.appid, r.signal, r.confidence) for r in got] == [(3, "cut", 5.5), (1, None, 3.5), (4, None, 3.5), (2, "keep", 1.0)]


def test_fresh_verdicts_rest(spark):
    minute = dt.timedelta(minutes=1)
    seen = [(1, "keep", ago(179)), (2, "keep", ago(181)), (3, "sleep", NOW - 4 * minute), (4, "pin", NOW - 6 * minute)]
    got = queue(spark, games(spark, {}, {}, {}, {}, {}, {"status": "Slept"}), protected=[5], verdicts=seen)
    assert {r.appid for r in got} == {2, 4}


def test_presets(spark):
    df = games(
        spark, {"status": "Sampled", "percent": 5, "hours": 1.0, "last_played_at": ago(30)}, {"priority": "Must Play", "status": "Completed"},
        {"hours": 4.0, "estimate": 720.0, "percent": 70, "status": "In Progress", "last_played_at": ago(180)}, {"endless": True, "status": "Slept"},
    )
    names = ("nearly-finished", "quick-wins", "recently-played", "fallen-off", "endless-rotation", "untouched", "in-progress", "must-play", "unplayed", "short")
    got = {(r.appid, r.preset) for r in stats.smart_members(df, names, F.lit(NOW)).collect()}
    assert got == {
        (1, "recently-played"), (1, "in-progress"), (2, "must-play"), (2, "unplayed"), (3, "nearly-finished"), (3, "quick-wins"), (3, "fallen-off"),
        (3, "in-progress"), (4, "unplayed"),
    }


def test_library_and_backlog(spark):
    df = games(
        spark, {"status": "Completed", "percent": 100, "hours": 10.0, "price_cents": 2000, "completed_at": ago(3), "rating": 8},
        {"status": "Completed", "percent": 100, "hours": 0.5, "price_cents": 10, "completed_at": ago(3)}, {"percent": 8, "hours": 0.5, "rating": 9},
        {"percent": 99, "endless": True, "hours": 2.0, "price_cents": 1000}, {"status": "Completed", "hours": 0.0, "price_cents": 500},
    )
    s = stats.library_stats(df).first()
    assert (s.total, s.completed, s.in_progress, s.hours, s.avg_rating) == (5, 3, 1, 13.0, 8.5)
    b = stats.backlog_stats(df).first()
    assert (b.total_games, b.priced_games, b.unplayed_games, b.unplayed_cents, b.total_hours) == (5, 4, 1, 500, 13)
    assert (b.best_value_appid, b.latest_completed_appid, b.value_percent) == (1, 1, 72)


def test_recaps(spark):
    today = dt.date(2026, 7, 20)
    day = lambda k: today - dt.timedelta(days=k)
    users = spark.createDataFrame([(k,) for k in range(1, 8)], "user_id long")
    daily = spark.createDataFrame([(1, day(1), 60), (1, day(9), 500), (2, day(0), 19), (3, day(1), 19), (4, day(0), 300), (6, day(6), 30)], "user_id long, day date, minutes long")
    visits = spark.createDataFrame([(1, day(5)), (2, day(3)), (3, day(3)), (4, day(0)), (5, day(2)), (6, day(31))], "user_id long, visited date")
    finished = spark.createDataFrame([(3, day(2)), (5, day(1)), (5, day(2)), (4, day(0))], "user_id long, completed_at date")
    got = {r.user_id: (r.minutes, r.games_finished, r.windowed) for r in playtime.visit_recap(users, daily, visits, finished, F.lit(today)).collect()}
    assert got == {1: (60, 0, False), 3: (19, 1, False), 5: (0, 1, False), 6: (30, 0, True)}


@pytest.mark.parametrize(
    "title, labels, kind, rule",
    [
        ("Game Public Test", [], "game", "release_channel:public_test"), ("X PTR", [], "game", "release_channel:ptr"), ("Alphabeta", [], "game", None),
        ("Demo of War", [], "", None), ("Beta", ["Utilities", "Software"], "game", "steam_label:utilities"), ("Beta", ["Utilities"], "DLC", "steam_type:dlc"),
        ("Test Realm beta", [], None, "release_channel:test_environment"), ("Staging", None, None, "release_channel:staging"),
    ],
)
def test_exclusions(spark, title, labels, kind, rule):
    column = F.lit(None).cast("array<string>") if labels is None else F.array(*map(F.lit, labels)).cast("array<string>")
    assert one(spark, catalogue.exclusion(column, F.lit(title), F.lit(kind).cast("string"))) == rule


def test_work_in_flight(spark):
    df = games(spark, {"tags_status": "processing"}, {"duration_status": "failed"}, {"labels": ["Unknown"], "duration_status": None, "tags_status": None}, {"labels": None})
    r = stats.enrichment(df).first()
    assert (r.total, r.processing, r.ready, r.percent_ready) == (4, 2, 2, 50)
