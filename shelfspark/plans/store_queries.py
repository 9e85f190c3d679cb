"""Registered queries of stored tables: scans, collections, merges and vendor payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalogue, collections, merges, stats
from ..sources import adapters, parsers
from . import queries as base
from .rule_queries import part, pick, tag_sets

USED = ("untouched", "quick-wins")
CHANGED = "2001-11-30 12:00:00"


def owned(s: SparkSession, d: str) -> DataFrame:
    return adapters.user_games(s, d)


def quarantined(s: SparkSession, d: str) -> DataFrame:
    """Catalogue entries a person or a rule has set aside."""
    return adapters.catalog(s, d).filter("appid % 13 = 0").select("appid")


def shelves(s: SparkSession, d: str) -> DataFrame:
    """Three custom and two smart collections per user and the system's own one."""
    k = F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 5, 6)))).alias("k")
    rows = owned(s, d).select("user_id").distinct().select("user_id", k)
    number = F.col("user_id") * 10 + F.col("k")
    return rows.select(
        "user_id", number.alias("collection_id"), F.when(F.col("k") == 0, "system").when(F.col("k") < 5, "custom").otherwise("smart").alias("kind"),
        F.concat(pick(F.col("k"), ("Entire Vault", "Best of", "Two Player", "Late nights", "", "Unplayed", "Two hours")), F.lit(" "), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("k") == 5, USED[0]).when(F.col("k") == 6, USED[1]).alias("preset"), F.date_add(F.lit("2001-01-01").cast("date"), (number * 37 % 100).cast("int")).alias("updated_at"),
    )


def links(s: SparkSession, d: str) -> DataFrame:
    """Memberships of the custom collections; some of games that are gone."""
    rows = owned(s, d).filter("appid % 7 in (1, 2, 3)")
    appid = F.when(F.col("appid") % 5 == 0, F.col("appid") + 100_000).otherwise(F.col("appid"))
    return rows.select((F.col("user_id") * 10 + F.col("appid") % 7).alias("collection_id"), "user_id", appid.alias("appid"), (F.col("appid") % 4).alias("position"), F.col("added_at").alias("created_at"))


def smart(s: SparkSession, d: str) -> DataFrame:
    return collections.smart_links(shelves(s, d), base.lib(s, d), USED, base.now())


def titled(s: SparkSession, d: str) -> DataFrame:
    return owned(s, d).join(adapters.catalog(s, d).select("appid", "title"), "appid")


def games_listing(s, d):
    """Owned games that are not quarantined, by title."""
    rows = titled(s, d).join(quarantined(s, d), "appid", "left_anti")
    return rows.select("user_id", "appid", F.row_number().over(Window.partitionBy("user_id").orderBy("title", "appid")).alias("place"))


def find_game(s, d):
    return titled(s, d).filter("user_id = 7 and appid % 13 <> 0").orderBy("appid").limit(1).select("user_id", "appid", "title", "status")


def library_search(s, d):
    """Text search over titles and labels, with the tab of a status."""
    rows, text = base.lib(s, d), "wid"
    hit = F.contains(F.lower("title"), F.lit(text)) | F.contains(F.lower(F.array_join("labels", " ")), F.lit("horror"))
    return rows.filter(hit & stats.active()).select("user_id", "appid")


def device_filter(s, d):
    """Games that run on a device: grade 2 or more on the handheld, or the desktop system; unknown ones are left out."""
    facts = base.device_facts(s, d)
    handheld = facts.filter("deck_compatibility >= 2").select("appid", F.lit("deck").alias("mode"))
    return handheld.unionByName(facts.filter("platform_mac").select("appid", F.lit("mac").alias("mode")))


def catalogue_in_list(s, d):
    """Pruned catalogue columns of the ids that users have drawn or reviewed."""
    ids = adapters.draws(s, d).select("appid").union(base.verdicts(s, d).select("appid")).distinct()
    return adapters.catalog(s, d).join(ids, "appid", "left_semi").select("appid", "genre", "price_cents")


def reviews_newest(s, d):
    """Clean-up verdicts of each user, the latest first, ten of them."""
    rows = merges.newest_per(base.verdicts(s, d), "user_id", 10, F.desc("reviewed_at"), F.desc("review_id"), F.asc("appid"))
    return rows.select("user_id", "appid", "action", "review_id")


def review_counts(s, d):
    """Reviewed games by their current status, per user."""
    return base.purge_standing(s, d).groupBy("user_id", "status").agg(F.count("*").alias("n"), F.count_if("superseded").alias("superseded"))


def snapshots_newest(s, d):
    rows = merges.newest_per(adapters.snapshots(s, d), "user_id", 60, F.desc("day"))
    return rows.groupBy("user_id").agg(F.count("*").alias("days"), F.min("total_minutes").alias("low"), F.max("total_minutes").alias("high"))


def nested_history(s, d):
    """The latest 50 draws of each user with their events, newest first, in one array."""
    event = F.struct("created_at", "event_id", "event")
    per = adapters.draws(s, d).groupBy("user_id", "draw_no").agg(F.first("appid").alias("appid"), F.first("drawn_at").alias("drawn_at"), F.reverse(F.array_sort(F.collect_list(event))).alias("e"))
    kept = merges.newest_per(per, "user_id", 50, F.desc("drawn_at"), F.desc("draw_no"))
    return kept.select("user_id", "draw_no", "appid", F.array_join(F.transform("e", lambda x: x["event"]), ">").alias("events"))


def vault_state(s, d):
    """Pins by slot, games that still sleep in a snooze and the current pick of each user."""
    pins = adapters.pins(s, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "appid"))), lambda x: x["appid"].cast("string")), ",").alias("pins"))
    until = F.when(F.col("appid") % 9 != 0, F.date_add(F.to_date("added_at"), (F.col("appid") % 2500).cast("int")))
    asleep = owned(s, d).filter("appid % 6 = 0").filter(until.isNull() | (until > F.to_date(base.now())))
    snoozed = asleep.groupBy("user_id").agg(F.count("*").alias("snoozed"), F.min("appid").alias("first_snoozed"))
    chosen = adapters.draws(s, d).groupBy("user_id").agg(F.max_by("appid", F.struct("drawn_at", "draw_no")).alias("pick"))
    every = owned(s, d).select("user_id").distinct()
    return every.join(pins, "user_id", "left").join(snoozed, "user_id", "left").join(chosen, "user_id", "left").select("user_id", "pins", F.coalesce("snoozed", F.lit(0)).alias("snoozed"), "first_snoozed", "pick")


def guest_pool(s, d):
    """Popular games for guests: 300 by rank, reviews and id, less quarantined ones, 250 of them, neutral."""
    c = adapters.catalog(s, d).withColumn("popularity", F.when(F.col("appid") % 3 == 0, F.col("appid") % 50))
    top = c.orderBy(F.asc_nulls_last("popularity"), F.desc_nulls_last("review_total"), "appid").limit(300)
    rating = F.when(F.col("review_total") > 0, F.least(F.lit(10), F.floor(F.col("review_positive") * 10 / F.col("review_total") + 0.5))).otherwise(0)
    left = top.join(quarantined(s, d), "appid", "left_anti").orderBy(F.asc_nulls_last("popularity"), F.desc_nulls_last("review_total"), "appid").limit(250)
    return left.select(F.concat(F.lit("guest-"), F.col("appid").cast("string")).alias("id"), F.lit("Not Started").alias("status"), rating.cast("long").alias("rating"), F.array_join("labels", " / ").alias("genre"))


def play_history(s, d):
    """What a library shows of its owner: counts, play time and dates; missing if 25 games or more show neither."""
    played, dated = F.max(F.col("hours") > 0), F.max(F.col("last_played_at").isNotNull())
    rows = owned(s, d).withColumn("hours", F.when(F.col("user_id") % 3 != 0, F.col("hours")).otherwise(0.0)).withColumn("last_played_at", F.when(F.col("user_id") % 6 != 0, F.col("last_played_at")))
    missing = (F.count("*") >= 25) & ~F.max((F.col("hours") > 0) | F.col("last_played_at").isNotNull())
    return rows.groupBy("user_id").agg(F.count("*").alias("games"), played.alias("playtime"), dated.alias("last_played"), missing.alias("missing"))


def completion_values(s, d):
    """What the games waiting for a completion are worth, and those that are settled."""
    queue = base.completion_queue(s, d).join(adapters.catalog(s, d).select("appid", "price_cents"), "appid")
    return queue.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("price_cents").alias("cents"))


def completion_asked_again(s, d):
    """The completion queue without games dismissed at a play time they have not outgrown: by a quarter, three hours at least."""
    rows = base.lib(s, d).select("user_id", "appid", "hours")
    at = F.when(F.col("appid") % 2 == 0, F.round(F.col("hours") * F.when(F.col("appid") % 4 == 0, 0.9).otherwise(0.5), 2))
    dismissed = rows.withColumn("at", at).filter("at is not null").filter(F.col("hours") < F.col("at") + F.greatest(F.lit(3.0), 0.25 * F.col("at")))
    return base.completion_queue(s, d).join(dismissed.select("user_id", "appid"), ["user_id", "appid"], "left_anti").select("user_id", "appid", "confidence")


def milestones(s, d):
    """What is said of the latest completion of each user, by the hours since pinning and the number of completions."""
    done = base.lib(s, d).filter("status = 'Completed'")
    latest = done.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by(F.struct("appid", "hours"), F.struct("completed_at", "appid")).alias("g"))
    pins = adapters.pins(s, d).select("user_id", "appid", "hours_at_pin")
    rows = latest.select("user_id", "n", "g.*").join(pins, ["user_id", "appid"], "left")
    n, said = F.col("n"), F.col("n").cast("string")
    gained = F.coalesce(F.col("hours_at_pin").isNotNull() & (F.col("hours") - F.col("hours_at_pin") > 0.1), F.lit(False))
    headline = F.when(gained, "You called it, and you finished it").when(n == 1, "First one down").when(n % 10 == 0, F.concat(said, F.lit(" games finished"))).when(n % 5 == 0, F.concat(said, F.lit(" down"))).otherwise("Another one finished")
    return rows.select("user_id", "appid", headline.alias("headline"), F.when(gained | (n == 1) | (n % 10 == 0), "big").otherwise("standard").alias("spectacle"))


def collection_details(s, d):
    custom = collections.custom_links(links(s, d), titled(s, d)).select("collection_id", "appid", (F.col("place") - 1).alias("place"))
    return custom.unionByName(smart(s, d).select("collection_id", "appid", F.col("position").alias("place")))


def collection_list(s, d):
    return collections.counted(shelves(s, d), links(s, d), smart(s, d)).select("user_id", "rank", "collection_id", "game_count")


def collection_index(s, d):
    return collections.collections_of_games(links(s, d), smart(s, d)).select("user_id", "appid", F.array_join("collection_ids", ",").alias("ids"))


def collection_page(s, d):
    """A collection's page: its games in order without quarantined ones."""
    kept = titled(s, d).join(quarantined(s, d), "appid", "left_anti")
    return collections.custom_links(links(s, d), kept).select("collection_id", "place", "appid")


def collection_search(s, d):
    found = collections.search(shelves(s, d), " TWO ").unionByName(collections.search(shelves(s, d), "vault"))
    return found.select("user_id", "rank", "collection_id")


def collection_positions(s, d):
    return collections.next_positions(shelves(s, d).filter("kind = 'custom'"), links(s, d))


def collection_edits(s, d):
    """Memberships after adding, moving and removing games; collections that end in 3 of every fifth user become smart."""
    rows = links(s, d)
    edits = rows.filter("appid % 3 = 0").select("collection_id", "user_id", "appid", F.when(F.col("appid") % 2 == 0, "remove").otherwise("add").alias("action"), (F.col("position") + 10).alias("position"), "created_at", F.lit(1).alias("at"))
    later = edits.filter("appid % 6 = 0").select("collection_id", "user_id", "appid", F.lit("add").alias("action"), F.lit(99).cast("long").alias("position"), "created_at", F.lit(2).alias("at"))
    turned = shelves(s, d).filter("kind = 'custom' and collection_id % 10 = 3 and user_id % 5 = 0").select("collection_id")
    return collections.edited_links(rows, edits.unionByName(later), turned).select("collection_id", "appid", "position")


def imported(s: SparkSession, d: str) -> DataFrame:
    """An import of games as it arrives: ids repeat, some ids and names are missing."""
    rows = adapters.read(s, d, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_partkey") + 1).alias("appid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"),
        F.when(F.col("l_linenumber") == 6, " ").otherwise(F.concat(F.lit(" Game "), (F.col("l_orderkey") % 5).cast("string"))).alias("title"),
        pick(F.col("l_orderkey"), ("Unknown", "Indie", "Utilities / Action", "")).alias("genre"), F.lit(0).cast("long").alias("rating"), F.lit(None).cast("long").alias("price_cents"),
    )
    return rows


def stub_rows(s, d):
    """The catalogue after an import: ids it lacks get a stub."""
    stubs = merges.stubs(imported(s, d)).select("appid", "name", "normalized_name")
    known = adapters.catalog(s, d).filter("appid % 2 = 0").select("appid", F.col("title").alias("name"), F.lower("title").alias("normalized_name"))
    return merges.insert_absent(known, stubs, ["appid"])


def import_enriched(s, d):
    """The last row of each imported id with the catalogue's names, genres and ratings."""
    last = merges.last_of(imported(s, d).filter("appid > 0 and trim(title) <> ''"), ["appid"], F.desc("at")).drop("at")
    facts = adapters.catalog(s, d).filter("appid % 3 <> 0").select(
        "appid", F.col("title").alias("name"), F.when(F.col("appid") % 4 != 0, F.col("labels")).otherwise(F.array().cast("array<string>")).alias("genres"), tag_sets(F.col("appid")).alias("tags"),
        "review_positive", "review_total", "price_cents",
    )
    return merges.enriched(last, facts).select("appid", F.trim("title").alias("title"), "genre", "rating", "price_cents")


def manual(s: SparkSession, d: str) -> DataFrame:
    """Manual decisions on catalogue entries."""
    return adapters.read(s, d, "labels").select((F.col("doc_id") + 1).alias("appid"), F.when(F.col("toxic") == 1, "excluded").otherwise("allowed").alias("review_status"))


def quarantine(s, d):
    """Quarantined entries after an import: detected ones that nobody has decided on, beside those already there."""
    last = merges.last_of(imported(s, d).filter("trim(title) <> ''"), ["appid"], F.desc("at"))
    found = merges.detected(last, manual(s, d).filter("appid % 4 <> 0")).select("appid", "matched_rule")
    held = adapters.catalog(s, d).filter("appid % 10 = 0").select("appid", F.lit("old").alias("matched_rule"))
    return merges.upsert(held, found, ["appid"])


def decisions(s, d):
    """Whether entries stay out: a manual decision before the rule."""
    rows = adapters.catalog(s, d).join(manual(s, d), "appid", "left")
    rule = catalogue.exclusion(F.col("labels"), F.when(F.col("appid") % 3 == 0, F.concat("title", F.lit(" beta"))).otherwise(F.col("title")))
    return rows.select("appid", merges.decided(rule, F.col("review_status")).alias("out"))


def status_changes(s, d):
    """Games after a new status for one in four: times kept, set or cleared, progress bounded."""
    rows = base.lib(s, d).withColumn("slept_at", F.when(F.col("status") == "Slept", F.col("added_at")))
    to = F.when(F.col("appid") % 4 == 0, pick(F.col("appid") + F.col("user_id"), ("Completed", "Slept", "In Progress"))).otherwise(F.col("status"))
    changed = merges.with_status(rows, to, F.lit(CHANGED).cast("timestamp"))
    return changed.select("user_id", "appid", "status", "percent", F.date_format("completed_at", "yyyy-MM-dd HH").alias("completed"), F.date_format("slept_at", "yyyy-MM-dd HH").alias("slept"))


def shelf_restored(s, d):
    rows = base.lib(s, d).withColumn("slept_at", F.when(F.col("status") == "Slept", F.col("added_at"))).filter("appid % 3 = 0")
    return merges.restored(rows).select("user_id", "appid", "status", F.coalesce("completed_at", "slept_at").isNull().alias("cleared"))


def deleted_games(s, d):
    """Memberships left after one in nine games is deleted."""
    gone = owned(s, d).filter("(user_id + appid) % 9 = 0").select("user_id", "appid")
    return merges.delete_keys(links(s, d), gone, ["user_id", "appid"]).groupBy("collection_id").agg(F.count("*").alias("n"))


def preferences_rebuilt(s, d):
    """Stored tallies after a rebuild: all rows new, nothing older stays."""
    rows = base.tallies(s, d).withColumn("stamp", F.lit(2))
    older = rows.filter("user_id % 2 = 0").withColumn("positive", F.lit(-1.0)).withColumn("stamp", F.lit(1)).unionByName(rows.limit(0))
    gone = older.select((F.col("user_id") + 1000).alias("user_id"), *[c for c in rows.columns if c != "user_id"])
    return merges.rebuild(older.unionByName(gone), rows).groupBy("stamp").agg(F.count("*").alias("n"), F.round(F.sum("positive"), 3).alias("positive"))


def daily_snapshots(s, d):
    """Daily totals after the day of the import was captured again."""
    today = F.lit("2024-01-30").cast("date")
    minutes = F.greatest(F.lit(0), F.floor(F.col("hours") * 60 + 0.5)).cast("long")
    captured = owned(s, d).groupBy("user_id").agg(F.sum(minutes).alias("total_minutes")).select("user_id", today.alias("day"), "total_minutes")
    held = adapters.snapshots(s, d).select("user_id", "day", F.col("total_minutes").cast("long").alias("total_minutes"))
    return merges.upsert(held, captured, ["user_id", "day"])


def completion_claims(s, d):
    """Completion claims (every event but errors) with those that an undo (an error) took back."""
    rows = adapters.read(s, d, "events").select("user_id", (F.col("event_id") % 3).alias("appid"), F.col("ts").cast("timestamp").alias("at"), "event_id", "event_type")
    claims, undos = rows.filter("event_type <> 'error'").drop("event_type"), rows.filter("event_type = 'error'").drop("event_type")
    return merges.undone(claims, undos).select("user_id", "appid", "event_id", "undone")


def draw_log(s, d):
    """The stored log (even events) after new ones (odd) of each user's newest 50 draws; those of other draws have no parent."""
    events = adapters.draws(s, d).select("user_id", F.concat_ws("-", "user_id", "draw_no").alias("draw_id"), "event_id", "drawn_at", "draw_no")
    kept = merges.newest_per(events.select("user_id", "draw_id", "drawn_at", "draw_no").distinct(), "user_id", 50, F.desc("drawn_at"), F.desc("draw_no"))
    return merges.append_known(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), kept, "draw_id").select("draw_id", "event_id")


def estimates_due(s, d):
    """Duration estimates per game and provider with the day they are due again."""
    rows = adapters.read(s, d, "lineitem").select(
        (F.col("l_partkey") + 1).alias("appid"), F.col("l_returnflag").alias("provider"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"),
        F.when(F.col("l_quantity") > 25, "matched").otherwise("no_duration").alias("status"),
    )
    return merges.duration_rows(rows, base.now()).select("appid", "provider", "status", "refresh_on")


def duration_import(s, d):
    """Rows of a duration file: refused ones with the reason, unknown games, and the rest."""
    k = F.col("k")
    rows = part(s, d).select(
        F.when(k % 11 == 0, -k).otherwise(k + 1).alias("appid"), F.when(k % 5 != 0, F.when(k % 17 == 0, -1).otherwise(F.col("p_size") * 60)).alias("minutes"),
        pick(k, ("high", "medium", "low", "sure")).alias("trust"), (k % 3 == 0).alias("known"),
    )
    problem = merges.import_problem(F.col("appid"), [F.col("minutes")], F.col("trust"))
    return rows.select("appid", F.coalesce(problem, F.when(~F.col("known"), "unknown game"), F.lit("updated")).alias("outcome"))


def mapping_cohort(s, d):
    """Rankings by provider id joined with the ids of games, N to M, best rank per metric, fused."""
    ranked = base.adapters.rankings(s, d).select(F.floor(F.col("appid") / 2).alias("game_id"), "metric", "rank", "value")
    mapped = part(s, d).select(F.floor(F.col("k") / 2).alias("game_id"), (F.floor(F.col("k") / 3) + 1).alias("appid"), F.col("p_name").alias("name"))
    best = ranked.groupBy("game_id", "metric").agg(F.min("rank").alias("rank"), F.min_by("value", "rank").alias("value"))
    ids = mapped.select("game_id", "appid").distinct()
    return catalogue.fuse_ranks(best.join(ids, "game_id").select("appid", "metric", "rank", "value"), 200).select("appid", "score", "best_rank", "rank")


def title_fallback(s, d):
    """Games found by title: same platform, same title, a year apart at most; none, one or several."""
    from ..functions.text import title_key

    k = F.col("k")
    wanted = part(s, d).filter("k % 4 = 0").select((k + 1).alias("appid"), title_key(F.concat("p_name", F.lit(" "), (k % 60).cast("string"))).alias("key"), (2000 + k % 9).alias("year"))
    found = part(s, d).filter("k % 3 <> 0").select(k.alias("game_id"), title_key(F.concat(F.upper("p_name"), F.lit("™ "), (k % 60).cast("string"))).alias("key"), F.when(k % 5 != 0, 2000 + k % 10).alias("there"))
    near = F.col("there").isNull() | (F.abs(F.col("there") - F.col("year")) <= 1)
    hits = wanted.join(found, "key").filter(near).groupBy("appid").agg(F.count_distinct("game_id").alias("n"), F.min("game_id").alias("game_id"))
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return wanted.select("appid").join(hits, "appid", "left").select("appid", status.alias("status"), F.when(F.col("n") == 1, F.col("game_id")).alias("game_id"))


def detail_payloads(s, d):
    """Store payloads, landed as JSON, as typed rows."""
    k = F.col("k")
    data = F.struct(
        F.lit(" Game ").alias("type"), F.when(k % 9 != 0, F.concat("p_name", F.lit(" "))).alias("name"), (k % 6 == 0).alias("is_free"), F.array(F.lit(" A "), F.lit(""), F.col("p_brand")).alias("developers"),
        F.array(F.struct(F.lit("1").alias("id"), F.lit("Action ").alias("description")), F.struct(F.lit("2").alias("id"), F.col("p_type").alias("description"))).alias("genres"),
        F.array(F.struct(F.lit(2).alias("id"), F.lit(" ").alias("description"))).alias("categories"), F.struct((k % 4 == 0).alias("mac")).alias("platforms"),
        F.struct(pick(k, ("usd", "EUR", "US", None)).alias("currency"), (k * 10).cast("double").alias("initial"), (k * 7 - 50).cast("double").alias("final"), (k % 140 + 0.5).alias("discount_percent")).alias("price_overview"),
        F.struct(pick(k, ("9 Dec, 2020", "Dec 19, 2021", "2022-01-03", "soon")).alias("date")).alias("release_date"),
    )
    raw = F.to_json(F.create_map(k.cast("string"), F.struct((k % 8 != 0).alias("success"), data.alias("data"))))
    return parsers.store_details(part(s, d).select("k", raw.alias("raw")), "k", "raw")


def small_payloads(s, d):
    """Review totals, grades, players and tags from landed JSON."""
    k = F.col("k")
    review = F.format_string('{"success":1,"query_summary":{"total_positive":%d,"total_reviews":%d}}', k * 3 % 50, k % 50)
    grade = F.format_string('{"success":%d,"results":{"resolved_category":%d}}', k % 2, k % 4)
    player = F.when(k % 3 == 0, '{"response":{"players":[]}}').otherwise(F.format_string('{"response":{"players":[{"steamid":"%d","personaname":"n"},{"steamid":"0"}]}}', k))
    tags = F.format_string('{"appid":%d,"tags":{" Indie  Game":%d,"A":2.5}}', F.when(k % 4 == 0, 0).otherwise(k), k % 7)
    rows = part(s, d).select("k", review.alias("review"), grade.alias("grade"), player.alias("player"), tags.alias("tags"))
    sums = parsers.review_summary(rows, "k", "review").join(rows.select("k", parsers.deck_grade(F.col("grade")).alias("grade")), "k")
    who = parsers.first_player(rows.select("k", "player"), "player").select("k", "steamid")
    voted = parsers.community_tags(rows, "k", "tags").select("k", F.col("tags")["Indie Game"].cast("long").alias("indie"))
    return sums.join(who, "k", "left").join(voted, "k", "left")


def page_payloads(s, d):
    """Owner pages in source order and ranking pages, with repeats across pages."""
    k = F.col("k")
    rows = part(s, d).select((k / 10).cast("int").alias("page"), "k", "p_name")
    entry = lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('": {"appid": '), i.cast("string"), F.lit(', "name": "'), F.when(k % 7 == 3, "").otherwise(F.col("p_name")), F.lit('", "owners": "1 .. 2"}'))
    listed = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-k).alias("o"), entry(F.when((k % 11 == 5) & (k >= 17), k - 16).otherwise(k + 1)).alias("e")))), lambda x: x["e"]), ", ").alias("body"))
    pages = listed.select("page", F.concat(F.lit("{"), "body", F.lit("}")).alias("raw"))
    owners = parsers.owner_pages(pages, "raw", "page", 10, 10_000).select(F.lit("owners").alias("metric"), "appid", F.col("rank").cast("long").alias("rank"))
    item = F.struct((F.floor(k / 2) * 3).alias("game_id"), k.cast("double").alias("value"))
    ranked = rows.groupBy("page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("i")))), lambda x: x["i"])).alias("raw")).withColumn("metric", F.lit("peak"))
    peak = parsers.ranked_pages(ranked, "page", "raw", 10).select("metric", F.col("game_id").alias("appid"), F.col("rank").cast("long").alias("rank"))
    return owners.unionByName(peak)


NAMES = (
    "games_listing find_game library_search device_filter catalogue_in_list reviews_newest review_counts snapshots_newest nested_history vault_state guest_pool play_history "
    "completion_values completion_asked_again milestones collection_details collection_list collection_index collection_page collection_search collection_positions collection_edits "
    "stub_rows import_enriched quarantine decisions status_changes shelf_restored deleted_games preferences_rebuilt daily_snapshots completion_claims draw_log estimates_due "
    "duration_import mapping_cohort title_fallback detail_payloads small_payloads page_payloads"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}
