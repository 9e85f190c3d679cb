"""Payload checks, nested JSON, landed files, import merges and plan checks: SQL twins, brute force, failing inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import catalogue, draw, merges, semistructured, validation
from shelfspark.plans import intake_queries, shelf_queries
from shelfspark.session import shared_path
from shelfspark.sources import landed, parsers

from .test_entry import test_against_sql as against_sql


@pytest.mark.parametrize("name", intake_queries.NAMES + shelf_queries.NAMES)
def test_intake_against_sql(spark, name):
    against_sql(spark, name)


def holds(value, pattern, top=True):
    if isinstance(pattern, dict):
        return isinstance(value, dict) and all(k in value and holds(value[k], p, False) for k, p in pattern.items())
    if isinstance(pattern, list):
        return isinstance(value, list) and all(any(holds(x, p, False) for x in value) for p in pattern)
    same = lambda x: type(x) is not bool and type(pattern) is not bool and isinstance(x, (int, float)) and isinstance(pattern, (int, float)) and x == pattern or type(x) is type(pattern) and x == pattern
    return same(value) or (top and isinstance(value, list) and any(map(same, value)))


def test_containment_by_brute_force(spark):
    rnd = random.Random(8)

    def made(depth):
        kind = rnd.randrange(8 if depth else 6)
        if kind < 6:
            return [None, True, False, rnd.randrange(3), rnd.randrange(3) + 0.5, rnd.choice("ab")][kind]
        return {rnd.choice("xyz"): made(depth - 1) for _ in range(rnd.randrange(3))} if kind == 6 else [made(depth - 1) for _ in range(rnd.randrange(4))]

    values = [made(3) for _ in range(150)] + [[[1, 2], [3]], {"x": {"y": [1, {"z": None}]}}, {}, []]
    patterns = [made(2) for _ in range(25)] + [[[1]], {"x": {"y": [{"z": None}]}}, {}, [], None, [[], []]]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)] + [(-1, None), (-2, "{no")], "k long, j string").select("k", F.try_parse_json("j").alias("v")).cache()
    for p in patterns:
        got = {r.k for r in df.filter(semistructured.contains(F.col("v"), p)).select("k").collect()}
        assert got == {k for k, v in enumerate(values) if holds(v, p)}, p


def test_partial_runs_at_any_depth(spark):
    def partial(value):
        if isinstance(value, list):
            return any(map(partial, value))
        if not isinstance(value, dict):
            return False
        if isinstance(value.get("failures"), list) and value["failures"]:
            return True
        counted = (v for k, v in value.items() if k in ("failed", "failures", "retried", "deferred") or k.lower().endswith("deferred"))
        return any(isinstance(v, (int, float)) and not isinstance(v, bool) and v > 0 for v in counted) or any(map(partial, value.values()))

    summaries = [
        {}, [], [{"failed": 3}], {"a": [[{"b": {"tagsDeferred": 1}}]]}, {"failed": 0, "failures": [], "x": {"failures": [0]}}, {"failed": True}, {"failed": "2"}, {"failures": 2},
        {"a": {"b": {"c": {"d": {"e": [{"retried": 0.5}]}}}}}, {"deferred": -1}, {"Failed": 3}, 5, None,
    ]
    df = spark.createDataFrame([(k, json.dumps(s)) for k, s in enumerate(summaries)], "k long, j string").select("k", F.parse_json("j").alias("s"))
    got = {r.k: r.status for r in semistructured.run_status(df, "k", "s").collect()}
    assert got == {k: "partial" if isinstance(s, dict) and partial(s) else "succeeded" for k, s in enumerate(summaries)}
    counts = {(r.k, r.key): r.count_ for r in semistructured.numeric_counts(df, ["k"], "s").withColumnRenamed("count", "count_").collect()}
    assert counts == {(4, "failed"): 0, (7, "failures"): 2, (9, "deferred"): -1, (10, "Failed"): 3}


def check(spark, schema, *payloads):
    rows = [(k, p if isinstance(p, str) or p is None else json.dumps(p)) for k, p in enumerate(payloads)]
    out = validation.checked(spark.createDataFrame(rows, "k long, p string"), "p", schema).orderBy("k").collect()
    return [(r.violations, r.row) for r in out]


def test_all_violations_of_a_form(spark):
    draw_of = lambda **x: {"game_id": "0a1b2c3d-0000-4000-8000-000000000001", "steam_app_id": 3, "session": None, "mood": None, "goal": None, "collection_id": None, "selected_genres": [], "eligible_pool_count": 0, "reroll_index": 0, **x}
    got = check(spark, validation.GAME, {"title": " a\t", "rating": " 7 ", "date_added": None, "notes": "  "}, {"title": None, "zz": 1, "b": 2, "hours_played": "x"}, None, "7", "{")
    assert got[0][0] == [] and (got[0][1].title, got[0][1].rating, got[0][1].date_added, got[0][1].notes, got[0][1].priority) == ("a", 7.0, None, "", "Medium")
    assert [v for v, _ in got[1:]] == [["title:type", "hours_played:type", "b:unknown_key", "zz:unknown_key"], ["payload:object"], ["payload:object"], ["payload:object"]]
    got = check(spark, validation.DRAW, draw_of(), draw_of(session="short", mood="chill", goal="new", selected_genres=["a"]), draw_of(collection_id="c", goal="new"), draw_of(mood="chill"), draw_of(selected_genres=["a"], more=1), draw_of(finalist_appids=[1, 2.5], session=4))
    assert [v for v, _ in got] == [[], [], ["draw:collection_with_filters"], ["draw:partial_choice"], ["draw:quick_with_genres"], ["session:type", "finalist_appids:item"]]
    got = check(spark, validation.COLLECTION, {"name": "n", "kind": "smart"}, {"name": "n", "kind": "smart", "rules": {"preset": "short"}, "other": 1}, {"name": "", "rules": {"preset": "none"}})
    assert [v for v, _ in got] == [["preset:required"], [], ["name:too_small", "preset:choice"]] and got[1][1].preset == "short"
    df = validation.checked(spark.createDataFrame([(1, '{"name":"n"}'), (2, "{}")], "k long, p string"), "p", validation.COLLECTION)
    good, bad = validation.split(df)
    assert [(r.k, r.name) for r in good.collect()] == [(1, "n")] and [(r.k, r.violations) for r in bad.collect()] == [(2, ["name:required"])]


def test_manifests_must_hold_their_array(spark):
    folder = shared_path(spark, "manifests")
    spark.createDataFrame([('{"games":\n[{"appid":1}, {"appid":2}]}',)], "value string").coalesce(1).write.text(folder)
    assert [r.appid for r in landed.read_manifests(spark, folder, "games", "appid long").orderBy("appid").collect()] == [1, 2]
    with pytest.raises(Exception, match="must contain a results array"):
        landed.read_manifests(spark, folder, "results", "appid long").collect()


def test_consolidated_attempts(spark):
    rows = [(1, "ready", 1), (1, "failed", 2), (2, "unavailable", 1), (2, "unavailable", 2), (2, "failed", 3), (3, "ready", 1), (3, "non_game", 2), (0, "ready", 1), (None, "ready", 1), (4, None, 1)]
    df = spark.createDataFrame(rows, "appid long, status string, attempt long")
    assert {r.appid: (r.status, r.attempt, r.unavailable_attempts) for r in landed.consolidated(df, "attempt").collect()} == {1: ("ready", 1, 0), 2: ("failed", 3, 2), 3: ("non_game", 2, 0), 4: (None, 1, 0)}
    wanted = spark.createDataFrame([(k,) for k in range(1, 6)], "appid long")
    assert sorted(r.appid for r in landed.to_fetch(wanted, df).collect()) == [2, 4, 5] and sorted(r.appid for r in landed.misses(wanted, df).collect()) == [2, 4, 5]
    dated = spark.createDataFrame([("2024-01-02",), ("2024-01-10",)], "source_updated_at string")
    assert landed.newest_source_date(dated).first().newest == "2024-01-10" and landed.newest_source_date(dated.limit(0)).first().newest is None


def test_cohorts_fail_inside_the_plan(spark):
    cohort = lambda *rows: spark.createDataFrame(list(rows), "appid long, name string, rank long")
    good = cohort((1, "a", 1), (2, "b", 2))
    for bad, message in ((cohort((1, "a", 1), (1, "a", 2)), "owners cohort repeats id 1"), (cohort((1, " ", 1)), "empty name"), (cohort((0, "x", 1)), "invalid id"), (cohort((None, "x", 1)), "invalid id")):
        with pytest.raises(Exception, match=message):
            catalogue.merge_sources(bad, good, "owners", "metrics").collect()
    with pytest.raises(Exception, match="metrics cohort contains"):
        catalogue.merge_sources(good, cohort((3, None, 1)), "owners", "metrics").collect()
    merged = catalogue.merge_sources(good, cohort((2, "c", 9), (2, "d", 5)), "owners", "metrics")
    assert {r.appid: (r.name, r.rank_b, r.sources, r.alternate) for r in merged.collect()} == {1: ("a", None, "owners", None), 2: ("b", 5, "owners+metrics", "d")}
    df, seen = catalogue.counted(good, "appid")
    df.write.format("noop").mode("overwrite").save()
    catalogue.expect_rows(seen, 2, "owners")
    with pytest.raises(ValueError, match="has 2 rows; expected 3"):
        catalogue.expect_rows(seen, 3, "owners")


def test_owner_pages_fail_inside_the_plan(spark):
    page = lambda raw: parsers.owner_page(spark.createDataFrame([(0, raw)], "page long, raw string"), "raw", "page", 2, strict=True).collect()
    entry = lambda key, appid: f'"{key}": {{"appid":{appid},"name":"n","owners":""}}'
    assert [r.rank for r in page("{" + entry(5, 5) + "," + entry(4, 4) + "}")] == [1, 2]
    for raw, message in (("{" + entry(5, 5) + "}", "has 1 entries; expected 2"), ("{" + entry(5, 5) + "," + entry(5, 5) + "}", "duplicate ids"), ("{" + entry(5, 5) + "," + entry(4, 6) + "}", "malformed row of id 4")):
        with pytest.raises(Exception, match=message):
            page(raw)


def test_details_need_a_title(spark):
    schema = "appid long, title string, steam_type string, deck_compatibility long, review_positive long, review_total long, price_currency string, price_initial long, price_final long, discount_percent long"
    catalog = spark.createDataFrame([], "appid long, name string, normalized_name string, steam_type string, deck_compatibility long, review_positive long, review_negative long, price_currency string, price_initial long, price_final long, discount_percent long, fetched_at timestamp")
    with pytest.raises(Exception, match="metadata without a title: 4"):
        merges.merged_details(catalog, spark.createDataFrame([(4, " ", None, None, None, None, None, None, None, None)], schema), F.current_timestamp()).collect()


def test_rebuilds_by_signals(spark):
    table, none = spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([], "k long")
    assert merges.rebuild(table, none).count() == 1 and merges.rebuild(table, none, signals=table).count() == 0
    assert merges.rebuild(table, none, sweep=True).count() == 0 and merges.rebuild(table, none, signals=none).count() == 1


def test_bootstrap_plan_gathers_each_source_once(spark):
    plan = intake_queries.bootstrap(spark, "/root/testdata/sf0.001")
    users = spark.range(5).select(F.col("id").alias("u"))
    sources = {c: spark.range(20).select((F.col("id") % 4).alias("u"), F.col("id").alias(c)) for c in ("a", "b", "c")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nested = catalogue.nested_sources(users, sources, "u")
        assert nested._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
        assert {r.u: (len(r.a), r.b[0].b if r.b else None) for r in nested.collect()}[4] == (0, None)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count() == 50


def test_genres_meet_by_canonical_keys(spark):
    games = spark.createDataFrame([(1, 1, "Not Started", 0.0, 0, False, ["Sci Fi"]), (1, 2, "Completed", 3.0, 100, False, ["RPG"]), (1, 3, "Not Started", 0.0, 0, False, ["Puzzle"])], "user_id long, appid long, status string, hours double, percent long, endless boolean, labels array<string>")
    nobody = spark.createDataFrame([], "user_id long, appid long")
    got = {r.stage: (r["count"], r.detail) for r in draw.funnel_stages(games, nobody, "new", ["science-fiction"]).collect()}
    assert got == {"library": (3, None), "active": (2, "1 completed"), "genres": (1, None), "goal": (1, None), "available": (1, None)}
    snoozed = games.filter("appid = 1").select("user_id", "appid")
    assert [(r.stage, r["count"]) for r in draw.funnel_stages(games, snoozed, None, [], deck_size=0).orderBy("place").collect()] == [("library", 3), ("active", 2), ("snoozes", 1), ("available", 1), ("shortlist", 0)]
    with pytest.raises(ValueError, match="no more than 3"):
        draw.funnel_stages(games, nobody, None, ["a", "b", "c", "d"])


def test_explanations_claim_what_the_draw_used(spark):
    schema = "rank long, score long, fits array<string>, endless boolean, remaining double, estimate double, percent long, hours double, labels array<string>, moods struct<intense:long>, last_played_at timestamp, review_positive long, review_total long"
    row = spark.createDataFrame([(1, 88, ["short"], False, 1.02, 1020.0, 94, 16.0, ["Horror"], (7,), None, 0, 0)], schema)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    told = lambda *setup: {i.kind: i for i in row.select(draw.explanation(*setup, F.lit(3), now).alias("i")).first().i}
    assert set(told(None, None, None, [])) == {"selection"}
    goal = told("short", None, "finish", [])["goal"]
    assert (goal.strength, goal.headline) == ("perfect", "About 1h from the credits") and "94%" in goal.detail and "17h" in goal.detail
    assert all(i.detail for i in told("short", "intense", "finish", ["horror"]).values()) and "genre" in told("short", "intense", "finish", ["HORROR"])
