import pytest
from pyspark.sql import functions as F

from shelfspark.operators import shelf

from .test_entry import test_against_sql as against_sql

NEW = "library_orders recent_activity showcase playtime_totals pin_progress draw_history ownership_reconcile device_facts".split()


@pytest.mark.parametrize("name", NEW)
def test_shelf_against_sql(spark, name):
    against_sql(spark, name)


def test_showcase_falls_back_to_most_played(spark):
    rows = [(1, 10, "Completed", 2.0, "2024-01-01"), (1, 11, "Not Started", 90.0, None), (2, 12, "In Progress", 5.0, None), (2, 13, "In Progress", 0.5, None)]
    df = spark.createDataFrame(rows, "user_id long, appid long, status string, hours double, at string").withColumn("last_played_at", F.to_timestamp("at"))
    assert {(r.user_id, r.appid) for r in shelf.showcase(df).collect()} == {(1, 10), (2, 12)}


def test_pins_without_hours_or_game(spark):
    pins = spark.createDataFrame([(1, 1, 10, None), (1, 2, 11, 1), (1, 3, 12, 9), (1, 4, 99, 0)], "user_id long, slot int, appid long, hours_at_pin long")
    games = spark.createDataFrame([(1, 10, 3.0, "In Progress"), (1, 11, 3.0, "In Progress"), (1, 12, 3.0, "Not Started")], "user_id long, appid long, hours double, status string")
    got = {r.slot: (r.gained, r.started) for r in shelf.pin_progress(pins, games).collect()}
    assert got == {1: (None, None), 2: (2.0, True), 3: (0.0, False)}
