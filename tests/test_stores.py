"""Stored tables, genres and decks against their SQL; cases that the tables do not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import genres, labels
from shelfspark.operators import classify, draw, merges, preferences
from shelfspark.plans import rule_queries, store_queries

from .test_entry import test_against_sql as against_sql


@pytest.mark.parametrize("name", rule_queries.NAMES + store_queries.NAMES)
def test_stores_against_sql(spark, name):
    against_sql(spark, name)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def words(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


def test_genres(spark):
    assert one(spark, genres.top_levels(words("Indie", "RPG", "Action RPG"), F.lit(""))) == ["RPG", "Casual"]
    assert one(spark, genres.top_levels(words("Odd"), F.lit("Kart Rally"))) == ["Racing"]
    assert one(spark, genres.top_levels(words(), F.lit("Zed"))) == []
    assert one(spark, genres.normalised_labels(words("rpg", "Open  World", "RPG"), F.lit(""))) == "RPG / Adventure / Open World"
    assert one(spark, genres.display_label(words("Action", "Early Access", "Shooter"), F.lit(""))) == "Action / Shooter"
    assert one(spark, genres.display_label(words("Action", "Early Access"), F.lit(""))) == "Action / Early Access"
    assert one(spark, genres.display_key(F.lit("turn-based"))) == "Turn Based" and one(spark, genres.display_key(F.lit("rpg"))) == "RPG"


@pytest.mark.parametrize(
    "tags, replay",
    [
        ({"Massively Multiplayer": 45.0, "Platformer": 100.0}, False), ({"Open World Survival Craft": 100.0}, True), ({"Story Rich": 100.0, "Clicker": 100.0}, False),
        ({"Story Rich": 100.0, "MMO": 100.0}, True), ({"Live Service": 10.0, "PvP": 10.0, "Action": 100.0}, True), ({}, False),
    ],
)
def test_replay_signs(spark, tags, replay):
    column = F.create_map(*[F.lit(x) for p in tags.items() for x in p]).cast("map<string,double>")
    assert one(spark, classify.strong_replay(column, words(), words())) is replay


@pytest.mark.parametrize("story, completion, shape", [(60, 720, True), (60, 719, False), (0, 12_001, True), (None, 12_000, False), (60, 0, False)])
def test_shapes(spark, story, completion, shape):
    assert one(spark, classify.endless_shape(F.lit(story).cast("int"), F.lit(completion))) is shape


def test_bracketed_undos(spark):
    at = lambda k: dt.datetime(2024, 1, 1, k)
    claims = spark.createDataFrame([(1, 1, at(1), 1), (1, 1, at(2), 2), (1, 1, at(5), 5), (1, 2, at(9), 9)], "user_id long, appid long, at timestamp, event_id long")
    undos = spark.createDataFrame([(1, 1, at(0), 0), (1, 1, at(3), 3), (1, 1, at(4), 4), (1, 1, at(6), 6), (1, 1, at(7), 7)], claims.schema)
    got = {r.event_id: r.undone for r in merges.undone(claims, undos).collect()}
    assert got == {1: True, 2: True, 5: True, 9: False}


def test_rebuild_leaves_a_table_alone_without_rows(spark):
    table, rows = spark.createDataFrame([(1, 1)], "k long, v long"), spark.createDataFrame([(2, 5)], "k long, v long")
    assert [tuple(r) for r in merges.rebuild(table, rows).collect()] == [(2, 5)]
    assert [tuple(r) for r in merges.rebuild(table, rows.limit(0)).collect()] == [(1, 1)]


def test_cold_start_is_served_the_population(spark):
    rows = spark.createDataFrame([(1, "any", "rpg", 30.0, 30.0), (1, "any", "__baseline__", 40.0, 80.0)], "user_id long, context string, genre string, positive double, total double")
    games = spark.createDataFrame([(1, 10, ["rpg"]), (2, 10, ["rpg"]), (2, 11, ["casual"]), (2, 12, [])], "user_id long, appid long, genres array<string>")
    got = {(r.user_id, r.appid): (r.points, r.reason) for r in preferences.adjustment(games, rows, preferences.globals_of(rows), "chill").collect()}
    assert got[1, 10][0] > got[2, 10][0] > 2.5 and got[2, 10][1] == "RPG lands well for you"
    assert got[2, 11] == got[2, 12] == (0.0, None)


def test_winner_goes_unless_alone(spark):
    pool = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "user_id long, rank int, appid long")
    won = spark.createDataFrame([(1, 10), (2, 12)], "user_id long, appid long")
    assert sorted((r.user_id, r.rank, r.appid) for r in draw.without_winner(pool, won).collect()) == [(1, 1, 11), (2, 1, 12)]


def test_labels(spark):
    now = F.lit(dt.datetime(2024, 3, 1))
    ages = {"3d ago": 3.0, "2w ago": 14.0, "Added 2024-02-20": 10.0, "Not played recently": float("inf"), "": float("inf")}
    assert {x: one(spark, labels.age_days(F.lit(x), now)) for x in ages} == ages
    assert [one(spark, labels.age_label(F.lit(x))) for x in (364.9, 366.0, 800.0, 31.0, 2.5)] == ["12mo", "1 year", "2 years", "1mo", "2d"]
    assert [one(spark, labels.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 112, 121)] == ["1st", "2nd", "3rd", "4th", "11th", "112th", "121st"]
    assert [one(spark, labels.money(F.lit(c))) for c in (0, 120, 9999, 211_345)] == ["$0.00", "$1.20", "$99.99", "$2,113"]
