import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
CHECKED = ["draw_pool_topk", "preference_points", "backlog_stats", "playtime_streaks", "purge_queue", "duration_cascade", "rate_window"]


def text(x):
    """One text for a value of either engine: dates and times at midnight are alike."""
    if not isinstance(x, (list, tuple, dict, np.ndarray)) and pd.isna(x):
        return "null"
    if isinstance(x, dt.date):
        return str(pd.Timestamp(x).tz_localize(None))
    return f"{x:.5f}" if isinstance(x, (int, float)) else str(x)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(tuple(map(text, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def test_scoring_plan_has_no_python(spark):
    plan = entry.queries()["draw_pool_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "WindowGroupLimit" in plan
