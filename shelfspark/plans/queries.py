"""Registered queries of the backlog engine; clock and randomness are constants."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rules import LEGACY_PRESETS, PRESETS
from ..operators import catalogue, draw, playtime, preferences, scoring, shelf, stats
from ..session import shared_path, written
from ..sources import adapters, parsers
from ..streaming import events as live

CHOSEN = ["Action", "RPG", "Strategy"]
TODAY = date(2024, 1, 30)


def now():
    return adapters.ts(adapters.NOW_ORDERS)


def clock():
    return adapters.ts(adapters.NOW_EVENTS)


def lib(s: SparkSession, d: str, owned: DataFrame | None = None) -> DataFrame:
    return scoring.library(adapters.user_games(s, d) if owned is None else owned, adapters.catalog(s, d))


def pool(s: SparkSession, d: str, goal: str = "new", games: DataFrame | None = None) -> DataFrame:
    """What a draw may take; ``games`` are library rows that have been written already."""
    rows = draw.stages(lib(s, d) if games is None else games, goal, CHOSEN).filter("is_active and genre_ok and goal_ok")
    return scoring.fit_score(rows, "evening", "intense", goal, CHOSEN)


def final(s: SparkSession, d: str, games: DataFrame | None = None) -> DataFrame:
    rows = draw.finalists(draw.deck(pool(s, d, games=games))).withColumn("appeal", scoring.appeal(F.col("review_positive"), F.col("review_total")))
    return draw.softmax(rows.withColumn("value", F.col("score") + F.col("appeal.points")), "value")


def user_u():
    return (F.col("user_id") % 1000 + 0.5) / 1000


def draw_pool_topk(s, d):
    return draw.finalists(draw.deck(pool(s, d))).select("user_id", "rank", "appid", "score")


def draw_pool_finish(s, d):
    return draw.deck(pool(s, d, "finish")).select("user_id", "rank", "appid", "score")


def eligibility_funnel(s, d):
    return draw.funnel(lib(s, d), "new", CHOSEN)


def mood_and_sessions(s, d):
    rows = lib(s, d)
    m = lambda k: F.col("moods")[k].cast("long").alias(k)
    return rows.select("user_id", "appid", "percent", F.array_join("fits", ",").alias("fits"), m("brain_off"), m("chill"), m("intense"))


def appeal(s, d):
    rows = adapters.catalog(s, d).withColumn("a", scoring.appeal(F.col("review_positive"), F.col("review_total")))
    return rows.select("appid", F.round("a.points", 6).alias("points"), F.col("a.kind").alias("kind"))


def softmax_probabilities(s, d):
    return final(s, d).select("user_id", "rank", "appid", F.round("probability", 6).alias("probability"))


def softmax_pick(s, d):
    return draw.pick(final(s, d), user_u()).select("user_id", "rank", "appid")


def quick_pick(s, d):
    return draw.quick_pick(draw.deck(pool(s, d)), user_u()).select("user_id", "rank", "appid")


def tallies(s, d):
    return preferences.tally(preferences.event_signals(adapters.draws(s, d), adapters.facts(s, d), clock()))


def preference_tally(s, d):
    return tallies(s, d)


def preference_globals(s, d):
    return preferences.globals_of(tallies(s, d))


def genre_idf(s, d):
    return preferences.rarity_weights(adapters.catalog(s, d)).select("genre", "df", F.round("weight", 6).alias("weight"))


def preference_points(s, d):
    rows = written(tallies(s, d), "tallies")  # read four times
    return preferences.points(rows, preferences.globals_of(rows), "intense")


def library_stats(s, d):
    return stats.library_stats(lib(s, d))


def backlog_stats(s, d):
    return stats.backlog_stats(lib(s, d))


def best_value_topk(s, d):
    return stats.best_value(lib(s, d))


def enrichment_progress(s, d):
    return stats.enrichment(lib(s, d))


def tab_counts(s, d):
    return stats.tabs(lib(s, d))


def playtime_gains(s, d):
    return playtime.gains(adapters.snapshots(s, d))


def playtime_streaks(s, d):
    return playtime.streaks(playtime.gains(adapters.snapshots(s, d)), F.lit(TODAY))


def playtime_rollup(s, d):
    return playtime.trailing(playtime.gains(adapters.snapshots(s, d)), F.lit(TODAY))


def visit_recap(s, d):
    """Last visits are the first views; finished games are dated by their id, as the tables' orders are older than their events."""
    visits = adapters.read(s, d, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("visited"))
    owned = adapters.user_games(s, d)
    finished = owned.filter("status = 'Completed'").select("user_id", F.date_sub(F.lit(TODAY), (F.col("appid") % 400).cast("int")).alias("completed_at"))
    users = adapters.read(s, d, "events").select("user_id").unionByName(owned.select("user_id"))
    return playtime.visit_recap(users, playtime.gains(adapters.snapshots(s, d)), visits, finished, F.lit(TODAY))


def smart_collections(s, d):
    return stats.smart_members(lib(s, d), PRESETS + LEGACY_PRESETS, now())


def collection_counts(s, d):
    return smart_collections(s, d).groupBy("user_id", "preset").agg(F.count("*").alias("n"))


def completion_queue(s, d):
    return stats.completion_queue(lib(s, d))


def verdicts(s: SparkSession, d: str) -> DataFrame:
    """Clean-up verdicts: open orders, by priority."""
    return verdict_rows(s, d).distinct()


def verdict_rows(s: SparkSession, d: str) -> DataFrame:
    """The verdicts as often as an order holds a game, for readers that take the newest or distinct ones anyway."""
    action = F.element_at(F.array(*map(F.lit, ("sleep", "keep", "pin", "complete"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    orders = adapters.read(s, d, "orders").filter("o_orderstatus <> 'F'")
    items = adapters.read(s, d, "lineitem").select("l_orderkey", "l_partkey")
    joined = orders.join(items, orders.o_orderkey == items.l_orderkey)
    return joined.select(
        (F.col("o_custkey") % adapters.USERS).alias("user_id"), (F.col("l_partkey") + 1).alias("appid"), action.alias("action"),
        F.col("o_orderdate").cast("timestamp").alias("reviewed_at"), F.col("o_orderkey").alias("review_id"),
    )


def purge_library(s: SparkSession, d: str) -> DataFrame:
    """What the clean-up reads of the library, built once: protected games and standing verdicts come from it, too."""
    return written(lib(s, d).select("user_id", "appid", "title", "status", "hours", "last_played_at", "endless", "estimate", "percent", "price_cents", "appeal_kind"), "library")


def purge_queue(s, d, library: DataFrame | None = None):
    rows = purge_library(s, d) if library is None else library
    return stats.purge_queue(rows, rows.filter(F.col("appid") % 13 == 0).select("user_id", "appid"), verdict_rows(s, d), now())


def purge_standing(s, d, library: DataFrame | None = None):
    newest = Window.partitionBy("user_id", "appid").orderBy(F.col("reviewed_at").desc(), F.col("review_id").desc())
    latest = verdict_rows(s, d).withColumn("k", F.row_number().over(newest)).filter("k = 1")
    rows = lib(s, d) if library is None else library
    joined = latest.join(rows.select("user_id", "appid", "status"), ["user_id", "appid"])
    return joined.select("user_id", "appid", "action", "status", stats.superseded(F.col("action"), F.col("status")).alias("superseded"))


def review_tally(s, d):
    return preferences.tally(preferences.review_signals(verdict_rows(s, d), adapters.catalog(s, d), now()))


def rrf_cohort(s, d):
    return catalogue.fuse_ranks(adapters.rankings(s, d), 100)


def cohorts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names, ranked = adapters.catalog(s, d).select("appid", "title"), adapters.rankings(s, d)
    a = catalogue.fuse_ranks(ranked, 100).join(names, "appid").select("appid", F.col("title").alias("name"), "rank")
    ranks = ranked.filter("metric = 'revenue' and rank <= 100").join(names, "appid")
    b = ranks.select("appid", F.when(F.col("appid") % 5 == 0, F.upper("title")).otherwise(F.col("title")).alias("name"), "rank")
    return a, b


def cohort_full_outer_merge(s, d):
    return catalogue.merge_cohorts(*cohorts(s, d))


def dedupe_first_wins(s, d):
    return catalogue.first_wins(adapters.rankings(s, d), "appid", F.col("rank"), F.col("metric")).select("appid", "metric", "rank")


def dedupe_last_wins(s, d):
    orders = adapters.read(s, d, "orders")
    terminal = F.col("o_orderstatus") == "F"
    rows = catalogue.overlay(orders, "o_custkey", terminal, F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus")


def coverage_anti(s, d):
    a, b = cohorts(s, d)
    return b.join(a, "appid", "left_anti").select("appid", "rank")


def eligible_semi(s, d):
    a, b = cohorts(s, d)
    return b.join(a, "appid", "left_semi").select("appid", "rank")


def whole_rrf_cohort(s, d):
    return catalogue.fuse_ranks(adapters.rankings(s, d), 100)


def whole_cohort_merge(s, d):
    return catalogue.merge_cohorts(*cohorts(s, d))


def whole_coverage_anti(s, d):
    a, b = cohorts(s, d)
    return b.join(a, "appid", "left_anti").select("appid", "rank")


def whole_eligible_semi(s, d):
    a, b = cohorts(s, d)
    return b.join(a, "appid", "left_semi").select("appid", "rank")


def whole_dedupe_first_wins(s, d):
    return catalogue.first_wins(adapters.rankings(s, d), "appid", F.col("rank"), F.col("metric")).select("appid", "metric", "rank")


def whole_quality_gate(s, d):
    return catalogue.quality(adapters.rankings(s, d), "appid", "metric")


def duration_cascade(s, d):
    wanted = adapters.catalog(s, d).select("appid")
    part = adapters.read(s, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    mapping = part.filter("k % 10 <> 3").select((F.col("k") + 1).alias("appid"), F.explode(F.when(F.col("k") % 10 == 4, F.array("k", F.col("k") + 100000)).otherwise(F.array("k"))).alias("game_id"))
    direct = part.filter("p_size % 3 <> 0").select(F.col("k").alias("game_id"), (F.col("p_size") * 60).alias("minutes"))
    parents = part.filter("k % 2 = 0").select(F.col("k").alias("game_id"), (F.col("k") + 1).alias("parent_id"))
    return catalogue.duration_cascade(wanted, mapping, direct, parents)


def tag_rank(s, d):
    per = adapters.read(s, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg((F.sum("l_quantity") - 50).alias("w"))
    tags = per.groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "w"))).alias("tags"))
    return tags.select((F.col("l_partkey") + 1).alias("appid"), F.array_join(catalogue.tag_labels(F.col("tags"), 2), ",").alias("labels"))


def exclusion_rules(s, d):
    marks = ["Beta", "Playtest", "public-test", "Test Server", "PTR", "Staging branch", "Alphabeta"]
    title = F.concat_ws(" ", "title", F.element_at(F.array(*map(F.lit, [*marks, None])), (F.col("appid") % 8 + 1).cast("int")))
    labels = F.when(F.col("appid") % 11 == 0, F.array(F.lit("Utilities"))).otherwise(F.col("labels"))
    kind = F.when(F.col("appid") % 17 == 0, "DLC").otherwise("game")
    return adapters.catalog(s, d).select("appid", catalogue.exclusion(labels, title, kind).alias("matched_rule"))


def title_normalise(s, d):
    part = adapters.read(s, d, "part")
    shown = F.concat(F.initcap("p_name"), F.lit(" (2019) - Deluxe Edition"))
    return part.select(
        "p_partkey", text.words_key(shown).alias("words"), text.ascii_words_key(shown).alias("ascii"), text.folded_key(shown).alias("folded"),
        text.title_key(shown).alias("title"), F.array_join(text.title_variants(shown), "|").alias("variants"),
    )


def genre_labels(s, d):
    raw = F.concat_ws(" / ", F.col("p_type"), F.lower("p_type"), "p_brand", F.lit("Unknown"))
    return adapters.read(s, d, "part").select("p_partkey", F.array_join(text.split_genres(raw), "|").alias("genres"), text.genre_key(F.col("p_type")).alias("key"))


def status_histogram(s, d):
    return lib(s, d).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("hours"), 2).alias("hours"))


def quality_gate(s, d):
    return catalogue.quality(adapters.rankings(s, d), "appid", "metric")


def page_link_scan(s, d):
    return parsers.page_links(adapters.read(s, d, "pages"), "html", r'<html lang="([a-z]+)"')


def page_hrefs(s, d):
    return parsers.page_hrefs(adapters.read(s, d, "pages"), "page_id", "html")


def event_stream(s: SparkSession, d: str, types: list[str]) -> DataFrame:
    """The events as a file stream."""
    one = adapters.read(s, d, "events")
    stream = s.readStream.schema(one.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("event_type").isin(*types))


def _checkpoint() -> str:
    return shared_path(SparkSession.getActiveSession(), "stream")


def rate_window(s, d):
    windows = live.rate_windows(event_stream(s, d, ["click", "view"]), 1, 3600, "1 day")
    return live.run_once(windows, shared_path(s, "rate_window"), _checkpoint(), "complete")


def dedupe_window(s, d):
    rows = live.drop_repeats(event_stream(s, d, ["error", "signup"]), ["user_id", "event_type"], "40 days")
    return live.run_once(rows.select("user_id", "event_type"), shared_path(s, "dedupe_window"), _checkpoint())


def dedupe_events(s, d):
    """The events of all types without repeats within 10 minutes."""
    rows = adapters.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.accepted(rows.select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"])


def pin_state(s, d):
    kind = F.when(F.col("event_type") == "signup", "pinned").otherwise("unpinned")
    rows = event_stream(s, d, ["signup", "error"]).select("user_id", "ts", "event_id", (F.col("event_id") % 50).alias("appid"), kind.alias("event"))
    return live.run_pins(rows, shared_path(s, "pin_state"), _checkpoint())


def library_orders(s, d):
    return shelf.positions(lib(s, d), ["recent", "title", "hours", "progress", "added", "duration", "status"])


def recent_activity(s, d):
    return shelf.recent_activity(lib(s, d))


def showcase(s, d):
    return shelf.showcase(lib(s, d))


def playtime_totals(s, d):
    return shelf.playtime_totals(adapters.user_games(s, d))


def pin_progress(s, d):
    return shelf.pin_progress(adapters.pins(s, d), lib(s, d))


def draw_history(s, d):
    return shelf.draw_history(adapters.draws(s, d), adapters.catalog(s, d), clock())


def ownership_reconcile(s, d):
    """The latest payload lacks one in nine of the owned games."""
    owned = adapters.user_games(s, d).select("user_id", "appid")
    return shelf.reconcile(owned, owned.filter("(user_id + appid) % 9 <> 0"))


def device_facts(s, d):
    games = adapters.read(s, d, "part").select((F.col("p_partkey") + 1).alias("appid"), "p_size")
    index = lambda k: games.filter(F.col("p_size") % k == 0)
    return shelf.device_facts(games, index(5), index(3), index(4))


NAMES = (
    "draw_pool_topk draw_pool_finish eligibility_funnel mood_and_sessions appeal softmax_probabilities softmax_pick quick_pick "
    "preference_tally preference_globals genre_idf preference_points review_tally library_stats backlog_stats best_value_topk "
    "enrichment_progress tab_counts playtime_gains playtime_streaks playtime_rollup visit_recap smart_collections collection_counts "
    "completion_queue purge_queue purge_standing rrf_cohort cohort_full_outer_merge dedupe_first_wins dedupe_last_wins coverage_anti "
    "eligible_semi duration_cascade tag_rank exclusion_rules title_normalise genre_labels status_histogram quality_gate "
    "page_link_scan rate_window dedupe_window pin_state library_orders recent_activity showcase playtime_totals pin_progress draw_history "
    "ownership_reconcile device_facts dedupe_events "
    "whole_rrf_cohort whole_cohort_merge whole_coverage_anti whole_eligible_semi whole_dedupe_first_wins whole_quality_gate page_hrefs"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}
