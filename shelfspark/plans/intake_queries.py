"""Registered queries of payload checks, landed files, nested JSON, merges of imports and the bootstrap read, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalogue, draw, merges, semistructured, validation
from ..session import shared_path, written
from ..sources import adapters, landed, parsers
from . import queries as base
from .rule_queries import part, pick, spread
from .store_queries import links, quarantined, shelves

UUID = "0a1b2c3d-0000-4000-8000-"


def made(*parts) -> Column:
    """A text of literals and columns, side by side."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def nested_payloads(s: SparkSession, d: str) -> DataFrame:
    """Queue rows with a nested payload; some are no JSON."""
    k = F.col("k")
    text = made('{"source":{"batch":"b', k % 5, '","n":', k, ',"live":', F.when(k % 2 == 0, "true").otherwise("false"), '},"tags":["a","t', k % 3, '",null,', k % 4, '],"ids":[[', k % 7, ",1],[2,", k % 3, "]]}")
    return part(s, d).select("k", F.when(k % 19 == 0, F.lit("{broken")).when(k % 23 == 0, F.lit("[1,[2]]")).otherwise(text).alias("payload"))


def payload_contains(s, d):
    """Which patterns each payload contains, whatever its shape."""
    value = F.col("v")
    patterns = {
        "of_batch": {"source": {"batch": "b3"}}, "live_one": {"source": {"live": True}, "tags": ["t1", "a"]}, "with_null": {"tags": [None, 2]}, "of_number": {"source": {"n": 40.0}},
        "nested": {"ids": [[1, 4], [2]]}, "no_such": {"source": {"batch": {}}}, "any_object": {}, "scalar": 1,
    }
    rows = nested_payloads(s, d).select("k", F.try_parse_json("payload").alias("v"))
    return rows.select("k", *[semistructured.contains(value, p).alias(name) for name, p in patterns.items()])


def game_payloads(s: SparkSession, d: str) -> DataFrame:
    """Game forms with every kind of fault planted."""
    k = F.col("k")
    fields = [
        F.when(k % 11 == 0, '"title":"  "').when(k % 13 == 0, made('"title":"', F.repeat(F.lit("x"), 221), '"')).when(k % 17 == 0, '"title":7').when(k % 19 != 0, made('"title":" ', F.col("p_name"), ' "')),
        pick(k, (None, '"status":"Completed"', '"status":"Lost"', '"status":"In Progress"', '"status":null')), pick(k, (None, '"rating":5', '"rating":"7"', '"rating":11', '"rating":2.5', '"rating":"abc"', '"rating":null', '"rating":""', '"rating":-1')),
        pick(k, ('"hours_played":1.5', '"hours_played":-2', '"hours_played":true')), pick(k, (None, '"steam_appid":"123"', '"steam_appid":"12a"', '"steam_appid":""', '"steam_appid":null', '"steam_appid":5', '"steam_appid":"12345678901"')),
        F.when(k % 29 == 0, made('"notes":"', F.repeat(F.lit("n"), 5001), '"')), F.when(k % 31 == 0, '"extra":1,"Another":{}'), pick(k, (None, '"priority":"Must Play"', '"priority":"must play"')),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return spread(s, d, "p_name").select("k", F.when(k % 37 == 0, F.lit("[]")).when(k % 41 == 0, F.lit("{oops")).otherwise(text).alias("payload"))


def payloads_checked(s, d):
    """Typed values of accepted game forms and all violations of refused ones."""
    rows = validation.checked(game_payloads(s, d), "payload", validation.GAME)
    r = F.col("row")
    return rows.select("k", "accepted", F.array_join("violations", " ").alias("violations"), r["title"].alias("title"), r["status"].alias("status"), r["rating"].alias("rating"), r["hours_played"].alias("hours"), r["steam_appid"].alias("steam_appid"), r["store"].alias("store"))


def draw_payloads(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    choice = lambda name, values, n: pick(F.floor(k / n), (*[f'"{name}":"{v}"' for v in values], f'"{name}":null', f'"{name}":"odd"', None))
    fields = [
        F.when(k % 13 == 0, '"game_id":"x"').otherwise(made(f'"game_id":"{UUID}', F.lpad(k.cast("string"), 12, "0"), '"')), pick(k, (made('"steam_app_id":', k + 1), '"steam_app_id":0', made('"steam_app_id":', k + 1), '"steam_app_id":"4"', made('"steam_app_id":', k + 1))),
        F.when(k % 3 == 0, '"session":null,"mood":null,"goal":null').when(k % 3 == 1, '"session":"short","mood":"chill","goal":"new"').otherwise(F.nullif(F.concat_ws(",", choice("session", validation.SESSIONS, 1), choice("mood", validation.MOODS, 7), choice("goal", validation.GOALS, 5)), F.lit(""))),
        pick(k, ('"collection_id":null', '"collection_id":null', '"collection_id":"c"', '"collection_id":""')), pick(k, ('"selected_genres":[]', '"selected_genres":["a"]', '"selected_genres":[]', '"selected_genres":["a","b","c","d"]', '"selected_genres":[1]')),
        '"eligible_pool_count":4', pick(k, ('"reroll_index":0', '"reroll_index":0', '"reroll_index":1.5')), pick(k, (None, '"finalist_appids":[1,2]', '"finalist_appids":[0]', '"more":1')),
    ]
    return spread(s, d).select("k", F.concat(F.lit("{"), F.concat_ws(",", *[F.lit(f) if isinstance(f, str) else f for f in fields]), F.lit("}")).alias("payload"))


def draws_checked(s, d):
    """All violations of draw requests, rules over several fields included."""
    rows = validation.checked(draw_payloads(s, d), "payload", validation.DRAW)
    return rows.select("k", "accepted", F.array_join("violations", " ").alias("violations"))


def worker_summaries(s: SparkSession, d: str) -> DataFrame:
    """A run per order with a nested summary."""
    k = F.col("o_orderkey")
    text = F.when(k % 17 == 0, "[1]").otherwise(
        made('{"imported":', k % 50, ',"ratio":', k % 4, '.5,"note":"failed","retried":', F.when(k % 9 == 0, "2").otherwise("0"), ',"failures":[', F.when(k % 11 == 0, '{"id":1}').otherwise(""), '],"batches":[{"deep":[{"priceDeferred":',
             F.when(k % 13 == 0, "3").otherwise("0"), '}],"failed":', F.when(k % 7 == 0, '"1"').otherwise("0"), '},{"deferred":null}],"failuresSeen":4}')
    )
    rows = adapters.read(s, d, "orders").select("o_orderkey", "o_custkey").repartition("o_orderkey")  # a small file is one task
    return rows.select(k.alias("run_id"), (F.col("o_custkey")).alias("worker"), F.try_parse_json(text).alias("summary"))


def run_status(s, d):
    """Whether each run left work behind, by any count at any depth of its summary."""
    return semistructured.run_status(worker_summaries(s, d), "run_id", "summary").select("run_id", "status")


def run_totals(s, d):
    """Numbers of each run's summary with their running sums per worker."""
    counts = semistructured.numeric_counts(worker_summaries(s, d), ["worker", "run_id"], "summary")
    own = Window.partitionBy("worker", "key").orderBy("run_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select("run_id", "key", "count", F.sum("count").over(own).alias("total"))


def land_lines(s: SparkSession, d: str) -> str:
    """Three attempts for each game as line-delimited JSON, with blank and broken lines, in a new shared folder."""
    k, n = F.col("k"), F.col("n")
    status = pick(k * 3 + n * 5, ("unavailable", "ready", "failed", "non_game", "unavailable", "unavailable", "failed"))
    line = made('{"appid":', F.when(k % 21 == 0, "0").otherwise((k + 1).cast("string")), ',"status":"', status, '","attempt":', n, ',"source_updated_at":"2024-01-', F.lpad((k % 28 + 1).cast("string"), 2, "0"), '"}')
    rows = part(s, d).select("k", F.explode(F.array(*map(F.lit, range(3)))).alias("n"))
    rows = rows.select(F.when((k % 10 == 3) & (n == 1), F.substring(line, 1, 20)).when((k % 15 == 4) & (n == 2), " ").otherwise(line).alias("value"))
    folder = shared_path(s, "landed-lines")
    rows.write.text(folder)
    return folder


ATTEMPT = "appid long, status string, attempt long, source_updated_at date"


def attempts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = landed.read_lines(s, land_lines(s, d), ATTEMPT)
    return lines.filter("_broken is null"), lines.filter("_broken is not null")


def landed_attempts(s, d):
    """Attempts read back from landed lines, one row per game; broken lines are kept apart and counted by their text."""
    good, broken = attempts(s, d)
    rows = landed.consolidated(good.drop("_broken", "_file"), "attempt").select(F.lit("result").alias("kind"), F.col("appid").cast("string").alias("id"), "status", F.col("unavailable_attempts").alias("n"))
    return rows.unionByName(broken.groupBy("_broken").agg(F.count("*").alias("n")).select(F.lit("broken").alias("kind"), F.col("_broken").alias("id"), F.lit(None).cast("string").alias("status"), "n"))


def landed_misses(s, d):
    """Games of landed manifests that no result covers, and those that a run which starts again has to fetch."""
    good, _ = attempts(s, d)
    folder = shared_path(s, "landed-manifests")
    item = made('{"appid":', F.col("k") + 1, ',"name":"g"}')
    parts = part(s, d).groupBy(F.floor(F.col("k") / 500).alias("p")).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("games"))
    parts.select(F.concat(F.lit('{"version":1,\n"games":['), "games", F.lit("]}")).alias("value"), "p").write.partitionBy("p").text(folder)
    manifest = landed.read_manifests(s, folder, "games", "appid long, name string").select("appid")
    extra = part(s, d).filter("k % 12 = 0").select((F.col("k") + 1).alias("appid"), F.lit("ready").alias("status"))
    missed, left = landed.misses(manifest, good, extra), landed.to_fetch(manifest, good)
    return missed.withColumn("kind", F.lit("miss")).unionByName(left.withColumn("kind", F.lit("fetch")))


def catalog_details(s, d):
    """The catalogue after fetched details of two games in three, new ones included."""
    k = F.col("k")
    stored = part(s, d).filter("k % 4 <> 0").select(
        (k + 1).alias("appid"), F.lit("old").alias("name"), F.lit("old").alias("normalized_name"), F.lit("game").alias("steam_type"), F.when(k % 5 == 0, k % 4).alias("deck_compatibility"), (k % 90).alias("review_positive"),
        (k % 8).alias("review_negative"), F.lit("USD").alias("price_currency"), k.alias("price_initial"), k.alias("price_final"), F.lit(5).cast("long").alias("discount_percent"), F.lit("2001-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )
    details = part(s, d).filter("k % 3 <> 0").select(
        (k + 1).alias("appid"), F.concat(F.lit(" "), "p_name", F.lit(" II ")).alias("title"), F.when(k % 6 != 1, "game").alias("steam_type"), (k % 3).alias("deck_compatibility"), (k % 100 - 10).alias("review_positive"), F.when(k % 7 != 0, k % 80).alias("review_total"),
        pick(k, ("USD", "EUR", None)).alias("price_currency"), (k * 10).alias("price_initial"), F.when(k % 5 != 0, k * 9).alias("price_final"), F.when(k % 4 != 0, k % 70).alias("discount_percent"),
    )
    return merges.merged_details(stored, details, base.now()).drop("fetched_at")


def user_imports(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables after every customer's orders came as an import."""
    items, orders = adapters.read(s, d, "lineitem"), adapters.read(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    rows = items.join(orders, "l_orderkey").select(
        "user_id", F.when(F.col("l_linenumber") != 7, F.col("l_partkey") + 1).alias("appid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"),
        F.when(F.col("l_linenumber") == 6, " ").otherwise(F.concat(F.lit(" Game "), (F.col("l_partkey") % 5).cast("string"))).alias("title"), pick(F.col("l_partkey"), ("Unknown", "Indie", "Utilities / Action", "")).alias("genre"),
        F.lit(0).cast("long").alias("rating"), (F.col("l_quantity") - 10).cast("double").alias("hours"),
    )
    facts = adapters.catalog(s, d).filter("appid % 3 <> 0").select("appid", F.col("title").alias("name"), F.lower("title").alias("normalized_name"), F.array("genre").alias("genres"), F.create_map(F.lit("x"), F.lit(1.0)).alias("tags"), "review_positive", "review_total", "price_cents")
    held = facts.filter("appid % 10 = 0").select("appid", F.lit("old").alias("matched_rule"))
    decisions = part(s, d).filter("k % 14 = 2").select((F.col("k") + 1).alias("appid"))
    library = orders.filter("l_orderkey % 5 = 0").select("user_id", (F.col("l_orderkey") % 200 + 1).alias("appid")).distinct().withColumns({"status": F.lit("Completed"), "hours": F.lit(99.0)})
    last = merges.last_of(rows.filter((F.col("appid") > 0) & (F.trim("title") != "")), ["user_id", "appid"], F.desc("at"))
    return merges.import_games(written(last, "last-imports"), facts, decisions, held, library)


def import_library(s, d):
    """Every user's library after the import, upserted by user and game."""
    return user_imports(s, d)["library"].select("user_id", "appid", F.trim("title").alias("title"), "genre", "rating", "price_cents", "hours", "status", "known_before")


def import_catalog(s, d):
    """Stubs and quarantined entries of the import."""
    tables = user_imports(s, d)
    names = tables["catalog"].select("appid", F.col("name").alias("value"), F.lit("catalog").alias("kind"))
    return names.unionByName(tables["quarantine"].select("appid", F.col("matched_rule").alias("value"), F.lit("quarantine").alias("kind")))


def merged_sources(s, d):
    """Two cohorts with provenance, conflicting names and checks inside the plan."""
    k = F.col("k")
    a = part(s, d).filter("k % 3 <> 0").select((k + 1).alias("appid"), F.col("p_name").alias("name"), k.alias("rank"))
    b = part(s, d).filter("k % 2 = 0").select((k + 1).alias("appid"), F.when(k % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.explode(F.array(k + 3, k + 2)).alias("rank"))
    return catalogue.merge_sources(a, b, "owners", "metrics")


def owner_pages_checked(s, d):
    """Object pages whose number of entries and ids are checked while they are read."""
    k = F.col("k")
    entry = made('"', k + 1, '": {"appid":', k + 1, ',"name":"', F.when(k % 9 == 0, "").otherwise(F.col("p_name")), '","owners":"1 .. 2"}')
    n = part(s, d).count() // 50 * 50
    rows = part(s, d).filter(k < n).groupBy(F.floor(k / 50).alias("page")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), entry.alias("e")))).alias("es"))
    raw = F.concat(F.lit("{"), F.array_join(F.transform("es", lambda x: x["e"]), ",\n"), F.lit("}"))
    return parsers.owner_page(rows.select("page", raw.alias("raw")), "raw", "page", 50, strict=True).select("appid", "rank")


def bootstrap(s, d):
    """What a client reads at its start: games, collections, links, snoozes, draws and quarantined games nested per user."""
    owned, shelf = adapters.user_games(s, d), shelves(s, d)
    drawn = adapters.draws(s, d).select(F.col("user_id"), F.col("draw_no"), "appid").distinct()
    sources = {
        "games": owned.select("user_id", "appid", "status"), "collections": shelf.select("user_id", "collection_id", "kind"), "links": links(s, d).select("user_id", "collection_id", "appid"),
        "snoozes": owned.filter("appid % 6 = 0").select("user_id", "appid"), "draws": drawn, "hidden": owned.join(quarantined(s, d), "appid").select("user_id", "appid"),
    }
    nested = catalogue.nested_sources(owned.select("user_id").distinct(), sources, "user_id")
    return nested.select("user_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in sources], F.array_min(F.transform("games", lambda g: g["appid"])).alias("first_game"))


def funnel_setups(s, d):
    """Funnels of three setups: genres by any spelling and a goal, one without genres, and a collection draw that ignores both."""
    lib, snoozed = base.lib(s, d), adapters.user_games(s, d).filter("appid % 6 = 0").select("user_id", "appid")
    members = links(s, d).filter("collection_id % 10 = 1").select("user_id", "appid")
    setups = [("guided", draw.funnel_stages(lib, snoozed, "new", [" action", "role_playing", "STRATEGY"])), ("open", draw.funnel_stages(lib, snoozed, "surprise", [])), ("collection", draw.funnel_stages(lib, snoozed, "new", ["Action"], members))]
    rows = [stages.withColumn("setup", F.lit(name)) for name, stages in setups]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def quick_repick(s, d):
    """A second uniform pick that leaves out the first."""
    deck = draw.deck(base.pool(s, d))
    first = draw.quick_pick(deck, base.user_u()).select("user_id", "appid")
    return draw.quick_pick(deck, base.user_u(), first).select("user_id", "appid")


def match_details(s, d):
    """The whole case for the ranked picks of a draw to finish something, and of a draw without any setup."""
    taste = F.when(F.col("appid") % 5 == 0, F.concat("genre", F.lit(" lands well for you")))
    points = (F.col("appid") % 9).cast("double")

    # both draws take from the active games, each for its ranks and for its size
    owned = written(adapters.user_games(s, d).filter("status not in ('Completed', 'Slept')").select("user_id", "appid", "status", "hours", "last_played_at"), "owned")
    games = base.lib(s, d, owned)

    def told(name, goal, why):
        pool = base.pool(s, d, goal, games)
        sizes = pool.groupBy("user_id").agg(F.count("*").alias("pool_size"))
        rows = draw.deck(pool).join(sizes, "user_id").withColumn("i", F.explode(why))
        return rows.select(F.lit(name).alias("setup"), "user_id", "appid", "i.*")

    guided = draw.explanation("evening", "intense", "finish", base.CHOSEN, F.col("pool_size"), base.now(), taste, points)
    return told("finish", "finish", guided).unionByName(told("quick", "new", draw.explanation(None, None, None, [], F.col("pool_size"), base.now())))


def manual_classes(s, d):
    """Why entries stay out: decisions by hand with their notes, then the rules."""
    rows = adapters.catalog(s, d).withColumn("k", F.col("appid") - 1)
    status, note = pick(F.col("k"), ("allowed", "excluded", None, None, "excluded")), pick(F.col("k"), (None, "bad port", None, "", ""))
    rule = catalogue.exclusion(F.array(F.when(F.col("k") % 6 == 2, "Utilities").otherwise(F.col("genre"))), F.when(F.col("k") % 4 == 3, F.concat("title", F.lit(" beta"))).otherwise(F.col("title")))
    found = merges.classified(rule, status, note, F.when(F.col("k") % 10 == 1, "manual:port"))
    return rows.select("appid", found.alias("c")).select("appid", "c.*")


NAMES = (
    "payload_contains payloads_checked draws_checked run_status run_totals landed_attempts landed_misses catalog_details import_library import_catalog merged_sources "
    "owner_pages_checked bootstrap funnel_setups quick_repick manual_classes match_details"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}
