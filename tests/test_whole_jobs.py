"""Queries that do the whole job beside one whose SQL keeps a cut."""

from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from shelfspark.sources import parsers
from shelfspark.streaming import events as live
from tests.test_entry import SF, TABLES


#: sf0.01 has 2000 games, more than the 1000 ranks that the cut queries take.
WHOLE = {n: SF.replace("sf0.001", "sf0.01") for n in entry.queries() if n.startswith("whole_")} | {"dedupe_events": SF, "page_hrefs": SF}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_against_sql(spark, name):
    con, folder = duckdb.connect(), WHOLE[name]
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, folder).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    text = lambda x: "null" if pd.isna(x) else f"{x:.5f}" if isinstance(x, (int, float)) else str(x)
    key = lambda df: sorted(tuple(map(text, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def test_rankings_hold_every_game(spark):
    folder = WHOLE["whole_quality_gate"]
    games = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_partkey").distinct().count()
    gate = entry.queries()["whole_quality_gate"](spark, folder).first()
    assert games > 1000 and (gate.rows, gate.keys) == (3 * games, games)
    assert entry.queries()["whole_dedupe_first_wins"](spark, folder).count() == games


def test_repeats_count_from_the_last_accepted(spark):
    begin = datetime(2024, 1, 1)
    rows = [(k, 1, "click", begin + timedelta(minutes=m)) for k, m in enumerate((0, 9, 11, 21, 22, 9000))] + [(9, 2, "click", begin), (10, 1, "view", begin)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").repartition(3)
    assert sorted(r.event_id for r in live.accepted(df, ["user_id", "event_type"]).collect()) == [0, 2, 4, 5, 9, 10]


def test_streams_write_parquet_not_driver_memory(spark):
    for name in ("rate_window", "dedupe_window", "pin_state"):
        out = entry.queries()[name](spark, SF)
        assert out.count() and all(f.endswith(".parquet") for f in out.inputFiles()), name


def test_pins_carry_over_batches(spark):
    begin = datetime(2024, 1, 1)
    rows = [(k, 1, g, e, begin + timedelta(minutes=k)) for k, (g, e) in enumerate([(5, "pinned"), (6, "pinned"), (5, "pinned"), (7, "pinned"), (8, "pinned"), (6, "unpinned"), (9, "pinned")])]
    df = spark.createDataFrame([*rows, (9, 2, 4, "unpinned", begin)], "event_id long, user_id long, appid long, event string, ts timestamp").repartition(3)
    assert {r.user_id: r.pins for r in live.fold_pins(df).collect()} == {1: [5, 7, 9], 2: []}
    halves = live.fold_pins(df.filter("event_id >= 4"), live.fold_pins(df.filter("event_id < 4")))
    assert {r.user_id: r.pins for r in halves.collect()} == {1: [5, 7, 9], 2: []}


def test_hrefs_of_awkward_anchors(spark):
    html = """<html lang="en"><a href="/x">x</a><A class='k' HREF = '/y?a="1"'>y</A><a href="/x">x</a><a name="z"><abbr href="/no">"""
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert sorted(map(tuple, parsers.page_hrefs(df, "page_id", "html").collect())) == [(1, "/x"), (1, '/y?a="1"')]


def test_vendor_payloads(spark):
    games = '{"response":{"game_count":3,"games":[{"appid":1,"name":" A ","playtime_forever":90},{"appid":2,"name":"","playtime_forever":5},{"name":"C"}]}}'
    out = parsers.owned_games(spark.createDataFrame([(7, games)], "user_id long, raw string"), "raw").collect()
    assert [(r.user_id, r.appid, r.title, r.hours, r.status) for r in out] == [(7, 1, "A", 1.5, "In Progress")]
    page = spark.createDataFrame([('{"30":{"appid":30,"name":"B"},"9":{"appid":9,"name":""},"4":{"appid":4,"name":"D"}}', 1)], "raw string, page long")
    assert sorted((r["rank"], r.appid) for r in parsers.owner_page(page, "raw", "page", 1000).collect()) == [(1001, 30), (1003, 4)]
