"""Registered queries of library orders by tab and reversed, protected and settled games, searches, reports and cleaned fields, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import collections, shelf
from ..sources import adapters, landed
from . import queries as base
from .intake_oracles import spot, w
from .oracles import ACTIVE, DRAWS, LIB, NOW, OWN
from .rule_queries import part, pick


def with_sleep(s: SparkSession, d: str) -> DataFrame:
    return base.lib(s, d).withColumn("slept_at", F.when(F.col("status") == "Slept", F.col("added_at")))


def tab_orders(s, d):
    """The orders of the sleeping and the completed tab."""
    rows = with_sleep(s, d)
    slept = shelf.positions(rows.filter("status = 'Slept'"), ["slept"]).select("user_id", "appid", F.lit("slept").alias("tab"), F.col("by_slept").alias("place"))
    done = shelf.positions(rows.filter("status = 'Completed'"), ["completed"]).select("user_id", "appid", F.lit("completed").alias("tab"), F.col("by_completed").alias("place"))
    return slept.unionByName(done)


def reversed_orders(s, d):
    """Library orders turned round, ties and missing values included."""
    return shelf.positions(base.lib(s, d), ["recent", "title", "duration", "status"], reverse=True)


def protected_games(s, d):
    """Pinned and snoozed games and current picks of every user."""
    picks = adapters.draws(s, d).groupBy("user_id").agg(F.max_by("appid", F.struct("drawn_at", "draw_no")).alias("appid"))
    return shelf.protected_ids(adapters.pins(s, d), adapters.user_games(s, d).filter("appid % 6 = 0"), picks)


def settled_games(s, d):
    """Active games that the clean-up does not ask about and that no standing verdict concerns."""
    library = base.purge_library(s, d)
    standing = base.purge_standing(s, d, library).filter("not superseded")
    return shelf.settled(library, base.purge_queue(s, d, library), standing).select("user_id", "appid")


def search_jobs(s, d):
    """Titles and years to search for: approved aliases before the catalogue."""
    k = F.col("k")
    games = part(s, d).filter("k % 5 <> 0").select((k + 1).alias("appid"), F.col("p_name").alias("name"), F.when(k % 3 != 0, F.make_date(2000 + k % 20, F.lit(1), F.lit(2))).alias("release_date"))
    aliases = part(s, d).filter("k % 4 = 0").select((k + 1).alias("appid"), F.upper("p_name").alias("search_title"), F.when(k % 8 == 0, 1990 + k % 9).cast("int").alias("release_year"), pick(k / 4, ("approved", "pending")).alias("review_status"))
    return landed.search_titles(part(s, d).select((k + 1).alias("appid")), games, aliases)


def duration_reports(s, d):
    """Matched rows of two report files, the last one wins, and the statuses of all rows."""
    k, n = F.col("k"), F.col("n")
    rows = part(s, d).select("k", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select(
        F.when(k % 13 != 0, k + 1).alias("appid"), pick(k + n, ("matched", "matched", "no_match", None)).alias("match_status"), pick(k, ("error", None)).alias("status"), F.when(k % 7 == 3, "other").otherwise("hltb").alias("provider"),
        k.cast("double").alias("provider_game_id"), (k % 6 + n / 2).alias("main_story_minutes"), (k * 10.0 + n).alias("main_extra_minutes"), F.lit(None).cast("double").alias("completionist_minutes"), n.alias("checked_at"), "n",
    )
    last, counts = landed.duration_report(rows, "hltb", "n")
    own = last.select(F.lit("row").alias("kind"), F.col("appid").cast("string").alias("id"), "provider_game_id", "main_story_minutes", "main_extra_minutes", F.lit(None).cast("long").alias("n"))
    nothing = F.lit(None).cast("long")
    return own.unionByName(counts.select(F.lit("count").alias("kind"), F.col("status").alias("id"), nothing.alias("provider_game_id"), nothing.alias("main_story_minutes"), nothing.alias("main_extra_minutes"), "n"))


def metadata_rows(s, d):
    """Catalogue rows of raw metadata."""
    k = F.col("k")
    raw = part(s, d).select(
        (k + 1).cast("string").alias("steam_appid"), F.concat(F.lit("  "), "p_name").alias("name"), F.when(k % 3 == 0, " own key ").alias("normalized_name"), pick(k, ("Dev", " ", None)).alias("developer"), F.col("p_brand").alias("publisher"), pick(k, ("3", "x", None, "1.5")).alias("deck_compatibility"),
        pick(k, ("10", "-4", None, "7.0")).alias("review_positive"), F.lit("12").alias("review_negative"), pick(k, ("usd", "EUR", " USD ", None)).alias("price_currency"), (k * 10).cast("string").alias("price_initial"), F.when(k % 2 == 0, "").otherwise("99").alias("price_final"),
        pick(k, ("20", "140", "-1", "")).alias("discount_percent"), F.when(k % 2 == 0, "2001-02-03 04:05:06").otherwise("").alias("metadata_fetched_at"),
    )
    return landed.catalogue_rows(raw, base.now()).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


def clean_fields(s, d):
    """Notes without what imports have written, presets as they are edited, waits that servers ask for."""
    k = F.col("k")
    notes = pick(k, (F.concat(F.lit(" Imported from Steam account. AppID: "), k.cast("string")), "ADDED FROM STEAM SEARCH. appid: 7", F.concat(F.lit(" mine "), k.cast("string")), None, F.lit("Imported from Steam account. AppID: 7 and more")))
    preset = pick(k, ("backlog", "unplayed", "in-progress", "short", "must-play", "fallen-off", None))
    header = pick(k, ("12", " 1.5 ", "Sat, 01 Dec 2001 00:10:00 GMT", "Wed, 21 Oct 1998 07:28:00 GMT", "soon", None, "-3"))
    return part(s, d).select("k", text.user_notes(notes).alias("notes"), collections.editable_preset(preset).alias("preset"), numeric.retry_after_ms(header, base.now()).alias("wait"))


NAMES = "tab_orders reversed_orders protected_games settled_games search_jobs duration_reports metadata_rows clean_fields".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as core_sql

    core = core_sql()
    rank = lambda order: f"row_number() OVER (PARTITION BY user_id ORDER BY {order})"
    p = "p AS (SELECT p_partkey AS k, p_name, p_brand FROM part)"
    return {
        "tab_orders": w(LIB, f"""SELECT user_id, appid, 'slept' AS tab, {rank('added_at DESC, title, appid')} AS place FROM lib WHERE status = 'Slept'
            UNION ALL SELECT user_id, appid, 'completed', {rank('completed_at DESC NULLS LAST, title, appid')} FROM lib WHERE status = 'Completed'"""),
        "reversed_orders": w(LIB, f"""SELECT user_id, appid, {rank('last_played_at NULLS FIRST, title DESC, appid DESC')} AS by_recent, {rank('title DESC, appid DESC')} AS by_title, {rank('estimate DESC NULLS FIRST, title DESC, appid DESC')} AS by_duration,
            {rank("list_position(['Slept', 'Not Started', 'In Progress', 'Completed'], status), title DESC, appid DESC")} AS by_status FROM lib"""),
        "protected_games": w(f"""{OWN}, {DRAWS}, slots AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY added_at, appid) <= 5)""",
            "SELECT user_id, appid FROM slots UNION SELECT user_id, appid FROM own WHERE appid % 6 = 0 UNION (SELECT user_id, arg_max(appid, (drawn_at, k)) FROM draws GROUP BY 1)"),
        "settled_games": f"""WITH l AS (WITH {LIB} SELECT user_id, appid FROM lib WHERE {ACTIVE}), q AS ({core['purge_queue']}), st AS ({core['purge_standing']})
            SELECT user_id, appid FROM l ANTI JOIN q USING (user_id, appid) ANTI JOIN (SELECT * FROM st WHERE NOT superseded) USING (user_id, appid)""",
        "search_jobs": w(p, """SELECT k + 1 AS appid, CASE WHEN k % 8 = 0 THEN upper(p_name) WHEN k % 5 <> 0 THEN p_name END AS title, CASE WHEN k % 8 = 0 THEN 1990 + k % 9 WHEN k % 5 <> 0 AND k % 3 <> 0 THEN 2000 + k % 20 END AS release_year FROM p"""),
        "duration_reports": w(f"""{p}, r AS (SELECT k, n, {spot('k + n', ["'matched'", "'matched'", "'no_match'", "NULL"])} AS m, {spot('k', ["'error'", "NULL"])} AS s FROM p, (SELECT unnest([0, 1]) AS n)),
            l AS (SELECT k, max(n) AS n FROM r WHERE m = 'matched' AND k % 7 <> 3 AND k % 13 <> 0 GROUP BY 1)""",
            """SELECT 'row' AS kind, CAST(k + 1 AS VARCHAR) AS id, nullif(k, 0) AS provider_game_id, CASE WHEN n = 0 AND k % 6 > 0 THEN k % 6 END AS main_story_minutes, nullif(k * 10 + n, 0) AS main_extra_minutes, NULL::BIGINT AS n FROM l
            UNION ALL SELECT 'count', CASE WHEN m = 'matched' THEN m ELSE coalesce(s, 'unknown') END, NULL, NULL, NULL, count(*) FROM r GROUP BY 2"""),
        "metadata_rows": w(p, f"""SELECT k + 1 AS appid, p_name AS name, CASE WHEN k % 3 = 0 THEN 'own key' ELSE lower(p_name) END AS normalized_name, CASE WHEN k % 3 = 0 THEN 'Dev' END AS developer, p_brand AS publisher, CASE WHEN k % 4 = 0 THEN 3 END AS deck_compatibility,
            {spot('k', ['10', '0', '0', '7'])} AS review_positive, 12 AS review_negative, CASE WHEN k % 4 IN (0, 2) THEN 'USD' END AS price_currency, k * 10 AS price_initial, CASE WHEN k % 2 = 1 THEN 99 END AS price_final, {spot('k', ['20', '100', '0', '0'])} AS discount_percent,
            CASE WHEN k % 2 = 0 THEN '2001-02-03 04:05:06' ELSE strftime({NOW}, '%Y-%m-%d %H:%M:%S') END AS fetched_at FROM p"""),
        "clean_fields": w(p, f"""SELECT k, CASE CAST(k % 5 AS INT) WHEN 2 THEN 'mine ' || k WHEN 4 THEN 'Imported from Steam account. AppID: 7 and more' ELSE '' END AS notes,
            {spot('k', ["'untouched'", "'untouched'", "'recently-played'", "'quick-wins'", "'nearly-finished'", "'fallen-off'", "'nearly-finished'"])} AS preset, {spot('k', ['12000', '1500', '600000', '0', 'NULL', 'NULL', 'NULL'])} AS wait FROM p"""),
    }
