"""Results that hold for any order of the rows and any size of a user's library."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from shelfspark.operators import preferences, semistructured, shelf, validation
from shelfspark.sources import adapters
from tests.test_entry import SF


def test_minutes_of_a_day_do_not_depend_on_the_order_of_its_events(spark, tmp_path):
    values = [[0.1, 0.7, 0.2], [0.2, 0.1, 0.7], [0.7, 0.2, 0.1]]  # sums of doubles on both sides of 1
    rows = [(u, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), v) for u, of in enumerate(values) for i, v in enumerate(of)]
    frame = pd.DataFrame(rows, columns=["user_id", "ts", "value"]).assign(ts=lambda f: f["ts"].astype("datetime64[us]"))
    frame.to_parquet(tmp_path / "events.parquet")
    assert {(r.user_id, r.total_minutes) for r in adapters.snapshots(spark, str(tmp_path)).collect()} == {(u, 1) for u in range(3)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert con.execute(entry.oracle_sql()["snapshots_newest"]).fetchdf()["high"].tolist() == [1, 1, 1]


def optimised(spark, query, folder=SF):
    return entry.queries()[query](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("query", "schema"), [("payloads_checked", validation.GAME), ("draws_checked", validation.DRAW)])
def test_payloads_are_read_once_and_by_all_cores(spark, query, schema):
    plan = optimised(spark, query)
    assert "RepartitionByExpression" in plan  # a small file has one row group, and so one task
    kinds = len(schema.fields) + sum(f.kind == "list" for f in schema.fields) * 2  # and those of the items of lists
    assert 0 < plan.count("schema_of_variant") + plan.count("SchemaOfVariant") <= 3 * kinds


def test_levels_of_a_walk_are_computed_once(spark):
    rows = spark.sql("""SELECT 1 AS id, parse_json('{"a":[{"failed":1}],"b":{"c":{"failed":2}}}') AS v""")
    found = semistructured.walk(rows, ["id"], "v", lambda key, value: key == "failed")
    assert {(r.depth, r.key) for r in found.select("depth", "key").collect()} == {(3, "failed")}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_each_library_order_has_a_stage(spark):
    rows = spark.sql("SELECT id % 2 AS user_id, id AS appid, CAST(id % 3 AS STRING) AS title, id % 5 AS hours FROM range(40)")
    placed = shelf.positions(rows, ["title", "hours"])
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = {r.appid: (r.by_title, r.by_hours) for r in placed.filter("user_id = 0").collect()}
    assert got[0] == (1, 17) and got[4] == (8, 2) and sorted(p for p, _ in got.values()) == list(range(1, 21))


def test_genre_rows_are_spread(spark):
    assert "RepartitionByExpression" in optimised(spark, "top_level_genres")


def test_genres_of_taste_are_found_once_and_games_not_exploded(spark):
    plan = optimised(spark, "preference_adjustment")
    assert "RLIKE" not in plan and "Generate" not in plan and "l_orderkey" not in plan


def test_a_taste_pick_reads_the_library_once(spark):
    assert "l_orderkey" not in optimised(spark, "taste_pick")


def test_weights_of_taste_come_from_the_whole_library(spark):
    library = spark.sql("SELECT 1 AS user_id, 1 AS appid, array('rpg', 'action') AS genres UNION ALL SELECT 1, 2, array('action') UNION ALL SELECT 1, 3, array('action') UNION ALL SELECT 2, 4, NULL")
    rows = spark.sql("SELECT 1 AS user_id, 'any' AS context, g AS genre, p AS positive, 4.0D AS total FROM VALUES ('rpg', 4.0D), ('action', 0.0D), ('__baseline__', 2.0D) AS t(g, p)")
    of = lambda games: {r.appid: r.points for r in preferences.adjustment(games, rows, preferences.globals_of(rows), "chill", library=library).collect()}
    every, some = of(library), of(library.filter("appid in (1, 4)"))
    assert set(every) == {1, 2, 3, 4} and some == {1: every[1], 4: 0.0} and every[2] == every[3] < every[1]


def test_orders_are_not_asked_for_each_use_of_a_library(spark):
    assert "o_orderkey" not in optimised(spark, "match_details")
    settled = optimised(spark, "settled_games")
    assert settled.count("Relation [o_orderkey") == 2  # fresh verdicts and standing ones
    assert "Aggregate [l_orderkey" not in settled and "Aggregate [l_orderkey" not in optimised(spark, "purge_queue")


def test_labels_of_a_game_are_made_before_its_owners_are_joined(spark):
    assert "format_number" not in optimised(spark, "display_labels").split("Join")[0]


def test_rows_of_a_task_do_not_grow_with_the_orders(spark, monkeypatch):
    rows = lambda: sorted(map(str, adapters.user_games(spark, SF).collect()))
    whole = rows()
    monkeypatch.setattr(adapters, "TASK_ROWS", 1000)
    assert rows() == whole
    plan = adapters.user_games(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3 and adapters.user_games(spark, SF).rdd.getNumPartitions() == 6
