"""Registered streaming state machines and counters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import adapters
from ..streaming import events as live
from ..streaming import machines
from .queries import event_stream

TYPES = ["click", "view", "purchase", "error", "signup"]


def mapped(pairs: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[F.col("event_type")]


def pin_events(s: SparkSession, d: str) -> DataFrame:
    """All events as actions on one of twelve games, with the game to replace and the end of a snooze (one in five has none)."""
    number = F.col("event_id")
    until = F.when(number % 5 != 0, F.unix_millis("ts") + number % 20 * 86_400_000)
    action = mapped({"click": "drawn", "signup": "pinned", "error": "unpinned", "purchase": "snoozed", "view": "unsnoozed"})
    return event_stream(s, d, TYPES).select("user_id", "ts", "event_id", action.alias("event"), (number % 12).alias("appid"), (F.floor(number / 12) % 12).alias("replace"), until.alias("until"))


def pin_machine(s, d):
    """Pins, snoozes and current pick of every user after all events."""
    states = machines.run_machine(pin_events(s, d), machines.PinMachine(), shared_path(s, "pins"), shared_path(s, "pins-checkpoint"))
    snoozed = machines.snoozed_at(F.unix_millis(adapters.ts(adapters.NOW_EVENTS)))
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    return machines.newest(states).select("user_id", text(F.col("pins")).alias("pins"), text(snoozed).alias("snoozed"), "current")


def cycle_pool(s: SparkSession, d: str) -> DataFrame:
    """The games that a user has viewed or bought, by weight."""
    rows = adapters.read(s, d, "events").filter("event_type in ('view', 'purchase')").select("user_id", (F.col("event_id") % 40).alias("appid")).distinct()
    weight = F.col("appid") * 7919 % 100 + 1
    return rows.select("user_id", "appid", weight.alias("weight"), (F.lit(0) - weight * 100 + F.col("appid")).alias("rank"))


def no_repeat_cycle(s, d):
    """Every draw of every user, none repeated before its deck is exhausted."""
    number = F.col("event_id")
    kind = F.when((F.col("event_type") == "view") & (number % 4 == 0), "quick").otherwise(mapped({"click": "draw", "error": "again", "signup": "setup"}))
    rows = event_stream(s, d, TYPES).select("user_id", "ts", "event_id", kind.alias("event"), (number % 3).alias("setup"), (number * 2654435761 % (1 << 32)).alias("roll"))
    rows = rows.filter("event is not null")
    return machines.run_machine(rows, machines.DrawCycle(), shared_path(s, "cycle"), shared_path(s, "cycle-checkpoint"), cycle_pool(s, d))


def rate_counters(s, d):
    """Requests of all types per bucket, hashed key and hour, and whether they passed the limit of one."""
    rows = event_stream(s, d, TYPES).select("ts", F.col("event_type").alias("bucket"), F.sha2(F.col("user_id").cast("string"), 256).alias("key"))
    return live.run_counters(rows, shared_path(s, "counters"), shared_path(s, "counters-checkpoint"), 1, 3600)


NAMES = "pin_machine no_repeat_cycle rate_counters".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    ordered = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k"
    return {
        "pin_machine": f"""WITH RECURSIVE e AS (SELECT user_id, event_id % 12 AS g, event_id // 12 % 12 AS r, event_type AS t, CASE WHEN event_id % 5 <> 0 THEN epoch_ms(ts) + event_id % 20 * 86400000 END AS until, {ordered} FROM events),
            f(user_id, k, pins, snoozes, current) AS (
              SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], []::STRUCT(g BIGINT, until BIGINT)[], NULL::BIGINT FROM e
              UNION ALL SELECT f.user_id, e.k,
                CASE WHEN t = 'signup' AND NOT list_contains(pins, g) AND len(pins) < 3 THEN list_append(pins, g)
                  WHEN t = 'signup' AND NOT list_contains(pins, g) AND list_contains(pins, r) THEN list_transform(pins, lambda x: CASE WHEN x = r THEN g ELSE x END)
                  WHEN t = 'error' THEN list_filter(pins, lambda x: x <> g) ELSE pins END,
                CASE WHEN t = 'purchase' THEN list_append(list_filter(snoozes, lambda x: x.g <> e.g), {{'g': e.g, 'until': e.until}}) WHEN t = 'view' THEN list_filter(snoozes, lambda x: x.g <> e.g) ELSE snoozes END,
                CASE WHEN t = 'click' THEN g WHEN t = 'purchase' AND current = g THEN NULL ELSE current END
              FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1),
            l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)
            SELECT user_id, array_to_string(pins, ',') AS pins, current,
              array_to_string(list_sort(list_transform(list_filter(snoozes, lambda x: x.until IS NULL OR x.until > epoch_ms(TIMESTAMP '{adapters.NOW_EVENTS}')), lambda x: x.g)), ',') AS snoozed FROM l""",
        "no_repeat_cycle": f"""WITH RECURSIVE pools AS (SELECT user_id, list(g ORDER BY w DESC, g) AS games FROM (SELECT DISTINCT user_id, event_id % 40 AS g, event_id % 40 * 7919 % 100 + 1 AS w FROM events WHERE event_type IN ('view', 'purchase')) GROUP BY 1),
            asked AS (SELECT user_id, event_id, ts, event_id % 3 AS wanted, event_id * 2654435761 % 4294967296 AS roll, CASE WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'quick' WHEN event_type = 'click' THEN 'draw' WHEN event_type = 'error' THEN 'again' WHEN event_type = 'signup' THEN 'setup' END AS t FROM events),
            e AS (SELECT *, {ordered} FROM asked JOIN pools USING (user_id) WHERE t IS NOT NULL),
            f(user_id, k, setup, bag, deferred, current, event_id, picked) AS (
              SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM e
              UNION ALL SELECT user_id, k, setup, CASE WHEN picked IS NULL THEN bag ELSE list_append(bag, picked) END, deferred, coalesce(picked, current), event_id, picked FROM (
                SELECT *, CASE WHEN t <> 'setup' AND len(final) > 0 THEN coalesce(final[list_filter(range(1, len(final) + 1), lambda i: list_sum(ws[1:i]) * 4294967296 > roll * list_sum(ws))[1]], final[-1]) END AS picked FROM (
                SELECT *, list_transform(final, lambda x: CASE WHEN t = 'quick' THEN 1 ELSE x * 7919 % 100 + 1 END) AS ws FROM (
                SELECT *, CASE WHEN t = 'quick' OR len(rest) <= 5 THEN rest ELSE rest[1 : least(20, greatest(3, (2 * len(rest) + 4) // 5))] END AS final FROM (
                SELECT * REPLACE (CASE WHEN t <> 'setup' AND len(fresh) = 0 THEN []::BIGINT[] ELSE bag END AS bag),
                  CASE WHEN len(CASE WHEN len(fresh) = 0 THEN deck ELSE fresh END) > 1 THEN list_filter(CASE WHEN len(fresh) = 0 THEN deck ELSE fresh END, lambda x: x IS DISTINCT FROM current) ELSE CASE WHEN len(fresh) = 0 THEN deck ELSE fresh END END AS rest FROM (
                SELECT *, list_filter(deck, lambda x: NOT list_contains(bag, x)) AS fresh FROM (
                SELECT *, CASE WHEN t = 'quick' THEN games ELSE list_concat(list_filter(games, lambda x: NOT list_contains(deferred, x)), list_filter(deferred, lambda x: list_contains(games, x)))[1:64] END AS deck FROM (
                SELECT e.user_id, e.k, e.t, e.roll, e.games, e.event_id, f.current, CASE WHEN t = 'setup' THEN wanted ELSE setup END AS setup,
                  CASE WHEN t = 'setup' AND wanted IS DISTINCT FROM setup THEN []::BIGINT[] ELSE bag END AS bag,
                  CASE WHEN t = 'setup' AND wanted IS DISTINCT FROM setup THEN []::BIGINT[] WHEN t = 'again' AND list_contains(games, current) THEN list_append(list_filter(deferred, lambda x: x <> current), current) ELSE deferred END AS deferred
                FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))))))))
            SELECT user_id, event_id, picked AS appid FROM f WHERE picked IS NOT NULL""",
        "rate_counters": """SELECT event_type AS bucket, sha256(CAST(user_id AS VARCHAR)) AS key, date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) > 1 AS over FROM events GROUP BY 1, 2, 3""",
    }
