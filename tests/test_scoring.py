import pytest
from pyspark.sql import functions as F

from shelfspark.functions import numeric, text
from shelfspark.operators import catalogue, draw, playtime, scoring, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "positive, total, kind", [(1_200_000, 1_500_000, "phenomenon"), (133, 141, "hidden-gem"), (200, 600, "divisive"), (3, 3, "none")]
)
def test_appeal_kinds(spark, positive, total, kind):
    got = one(spark, scoring.appeal(F.lit(positive), F.lit(total)))
    assert got.kind == kind and -6 <= got.points <= 6 and (kind != "none" or got.points == 0)


@pytest.mark.parametrize("parts, minutes", [((600, 900, 1500), 1020), ((10, 20, None), 60), ((0, None, -5), None)])
def test_estimate(spark, parts, minutes):
    assert one(spark, scoring.estimate_minutes(*[F.lit(p).cast("int") for p in parts])) == minutes


@pytest.mark.parametrize("hours, estimate, percent", [(17.5, 2580, 41), (10.1, 780, 78), (500.0, 60, 99)])
def test_progress(spark, hours, estimate, percent):
    assert one(spark, scoring.progress(F.lit("In Progress"), F.lit(False), F.lit(hours), F.lit(float(estimate)))) == percent


def test_full_score_and_missing_choices(spark):
    row = spark.createDataFrame([(["Action"], 0.0, 180.0, 0, False)], "labels array<string>, hours double, estimate double, percent long, endless boolean")
    row = row.withColumn("remaining", scoring.remaining_hours(F.col("estimate"), F.col("percent")))
    row = row.withColumn("fits", scoring.session_fits(F.col("endless"), F.col("remaining")))
    row = row.withColumn("moods", F.struct(F.lit(0).alias("brain_off"), F.lit(0).alias("chill"), F.lit(7).alias("intense")))
    assert scoring.fit_score(row, "short", "intense", "new", ["Action"]).first().score == 100
    assert scoring.fit_score(row).first().score == 0


def test_moods_and_labels(spark):
    got = one(spark, scoring.mood_scores(F.array(F.lit("Action"), F.lit("HORROR"), F.lit("horror"))))
    assert (got.brain_off, got.chill, got.intense) == (0, -5, 9)
    assert one(spark, text.unique_ignoring_case(F.array(F.lit("RPG"), F.lit("rpg"), F.lit("Action")))) == ["RPG", "Action"]
    assert one(spark, text.split_genres(F.lit("Action / rpg|RPG; unknown"))) == ["Action", "rpg"]


def test_title_keys(spark):
    title = F.lit("Pokémon™")
    keys = [one(spark, f(title)) for f in (text.words_key, text.ascii_words_key, text.folded_key)]
    assert keys == ["poke montm", "pok mon", "pokemontm"]
    assert one(spark, text.title_variants(F.lit("Game™ (2019)"))) == ["Game™ (2019)", "Game (2019)", "Game"]


def test_shrinkage_equals_prior_without_evidence(spark):
    assert one(spark, numeric.shrunk_rate(F.lit(0.0), F.lit(0.0), F.lit(0.3), 8.0)) == pytest.approx(0.3)


def test_ids(spark):
    got = [one(spark, numeric.uint32_or_null(F.lit(x))) for x in ("0", "4294967296", "1.5", "4294967295")]
    assert got == [None, None, None, 4294967295]


def deck(spark, n):
    rows = spark.range(n).select(F.lit(1).alias("user_id"), F.col("id").alias("appid"), F.lit("t").alias("title"), (100 - F.col("id")).alias("score"))
    return draw.deck(rows)


@pytest.mark.parametrize("n, kept", [(3, 3), (5, 5), (6, 3), (30, 12), (72, 20)])
def test_finalists(spark, n, kept):
    assert draw.finalists(deck(spark, n)).count() == kept


def test_softmax_reaches_every_row(spark):
    probs = draw.softmax(draw.finalists(deck(spark, 10)), "score")
    assert probs.agg(F.sum("probability")).first()[0] == pytest.approx(1)
    picked = {draw.pick(probs, F.lit(i / 40)).first().appid for i in range(41)}
    assert picked == {r.appid for r in probs.collect()}
    assert {draw.quick_pick(deck(spark, 10), F.lit(i / 10)).first().appid for i in range(10)} == set(range(10))


def test_series(spark):
    import datetime as dt

    day = lambda k: dt.date(2024, 1, 20) - dt.timedelta(k)
    daily = spark.createDataFrame([(1, day(k), m) for k, m in enumerate((0, 45, 30, 20, 0, 90))], "user_id long, day date, minutes long")
    assert playtime.streaks(daily, F.lit(day(0))).first().streak == 3
    totals = spark.createDataFrame([(1, day(1), 900), (1, day(0), 100)], "user_id long, day date, total_minutes long")
    assert playtime.gains(totals).first().minutes == 0


def test_catalogue(spark):
    ranking = spark.createDataFrame([(1, "count", 1, 9.0), (1, "count", 5, 3.0), (2, "revenue", 1, 9.0)], "appid long, metric string, rank int, value double")
    fused = catalogue.fuse_ranks(ranking, 10).collect()
    assert [(r.appid, r.rank) for r in fused] == [(1, 1), (2, 2)] and fused[0].score == pytest.approx(0.5 / 61)
    a = spark.createDataFrame([(1, "A", 1)], "appid long, name string, rank int")
    b = spark.createDataFrame([(1, "B", 4), (2, "C", 2)], "appid long, name string, rank int")
    assert {(r.appid, r.name, r.conflict) for r in catalogue.merge_cohorts(a, b).collect()} == {(1, "A", True), (2, "C", False)}
    tags = F.create_map(F.lit("b"), F.lit(143.0), F.lit("a"), F.lit(143.0), F.lit("c"), F.lit(0.0))
    assert one(spark, catalogue.tag_labels(tags, 5)) == ["a", "b"]


def test_empty_library(spark):
    schema = (
        "user_id long, status string, percent long, hours double, price_cents long, last_played_at timestamp, completed_at timestamp, appid long, endless boolean, "
        "estimate double, rating long"
    )
    empty = spark.createDataFrame([], schema)
    assert stats.library_stats(empty).count() == stats.backlog_stats(empty).count() == stats.completion_queue(empty).count() == 0
