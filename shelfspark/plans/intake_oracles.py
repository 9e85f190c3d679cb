"""DuckDB SQL that gives the rows of :mod:`.intake_queries`."""

from __future__ import annotations

from ..operators import validation as v
from . import rule_oracles as rules
from .oracles import ACTIVE, APPEAL, CAT, GOALS, LIB, OWN, pool

P = "p AS (SELECT p_partkey AS k, p_name FROM part)"
_SEP = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ' ')"


def w(ctes: str, select: str) -> str:
    return f"WITH {ctes}{select if select.startswith(',') else ' ' + select}"


def spot(k: str, values: list[str]) -> str:
    return f"[{', '.join(values)}][CAST(({k}) % {len(values)} AS INT) + 1]"


def quoted(values) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


def faults(*pairs: tuple[str, str]) -> str:
    return _SEP.format(", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in pairs))


# the payloads as values, field by field: what stands in the JSON is known from k
GAME_VALUES = f"""g AS (SELECT k, k % 37 = 0 OR k % 41 = 0 AS no_object,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN repeat('x', 221) WHEN k % 17 = 0 OR k % 19 = 0 THEN NULL ELSE p_name END AS title, k % 11 <> 0 AND k % 13 <> 0 AND k % 17 = 0 AS odd_title,
  k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 19 = 0 AS no_title, {spot('k', ["'Not Started'", "'Completed'", "'Lost'", "'In Progress'", "NULL"])} AS status, k % 5 = 4 AS odd_status,
  {spot('k', ["0", "5", "7", "11", "2.5", "NULL", "0", "0", "-1"])}::DOUBLE AS rating, k % 9 = 5 AS odd_rating, {spot('k', ["1.5", "-2", "1"])}::DOUBLE AS hours,
  {spot('k', ["NULL", "'123'", "'12a'", "NULL", "NULL", "NULL", "'12345678901'"])} AS steam_appid, k % 7 = 5 AS odd_appid, k % 29 = 0 AS long_notes, k % 31 = 0 AS more, k % 3 = 2 AS odd_priority FROM p)"""
GAME_FAULTS = faults(
    ("title:required", "no_title"), ("title:type", "odd_title"), ("title:too_small", "title = ''"), ("title:too_big", "len(title) > 220"), ("status:type", "odd_status"), ("status:choice", "status = 'Lost'"), ("rating:type", "odd_rating"),
    ("rating:too_small", "rating < 0"), ("rating:too_big", "rating > 10"), ("rating:not_whole", "rating <> floor(rating)"), ("hours_played:too_small", "hours < 0"), ("priority:choice", "odd_priority"), ("notes:too_big", "long_notes"),
    ("steam_appid:type", "odd_appid"), ("steam_appid:pattern", "len(steam_appid) > 10 OR steam_appid = '12a'"), ("Another:unknown_key extra:unknown_key", "more"),
)


def choice(values, n: int, name: str) -> str:
    """Value of an optional choice, whether it is missing, and whether it is odd."""
    at = f"CAST((k // {n}) % 6 AS INT)"
    listed = ", ".join([f"'{x}'" for x in values] + ["NULL", "'odd'", "NULL"])
    return f"CASE WHEN k % 3 = 1 THEN '{dict(session='short', mood='chill', goal='new')[name]}' WHEN k % 3 = 2 THEN [{listed}][{at} + 1] END AS {name}, k % 3 = 2 AND {at} = 5 AS no_{name}"


DRAW_VALUES = f"""q AS (SELECT k, k % 13 = 0 AS odd_id, k % 5 = 1 AS low_app, k % 5 = 3 AS odd_app, {choice(v.SESSIONS, 1, 'session')}, {choice(v.MOODS, 7, 'mood')}, {choice(v.GOALS, 5, 'goal')},
  k % 4 = 2 AS of_collection, k % 4 = 3 AS blank_collection, {spot('k', ['0', '1', '0', '4', '1'])} AS n_genres, k % 5 = 4 AS odd_genre, k % 3 = 2 AS odd_index, k % 4 = 2 AS odd_finalist FROM p),
q2 AS (SELECT *, CAST(session IS NOT NULL AS INT) + CAST(mood IS NOT NULL AS INT) + CAST(goal IS NOT NULL AS INT) AS chosen FROM q)"""
DRAW_SINGLE = faults(
    ("game_id:pattern", "odd_id"), ("steam_app_id:type", "odd_app"), ("steam_app_id:too_small", "low_app"), ("session:required", "no_session"), ("session:choice", "session = 'odd'"), ("mood:required", "no_mood"), ("mood:choice", "mood = 'odd'"),
    ("goal:required", "no_goal"), ("goal:choice", "goal = 'odd'"), ("selected_genres:too_big", "n_genres > 3"), ("selected_genres:item", "odd_genre"), ("reroll_index:not_whole", "odd_index"), ("finalist_appids:item", "odd_finalist"),
)
DRAW_CROSSED = faults(
    ("draw:collection_with_filters", "of_collection AND (chosen > 0 OR n_genres > 0)"), ("draw:partial_choice", "NOT of_collection AND chosen NOT IN (0, 3)"), ("draw:quick_with_genres", "NOT of_collection AND chosen = 0 AND n_genres > 0"),
)

LANDED = f"""{P}, every AS (SELECT k, n, CASE WHEN k % 21 = 0 THEN 0 ELSE k + 1 END AS appid, {spot('k * 3 + n * 5', ["'unavailable'", "'ready'", "'failed'", "'non_game'", "'unavailable'", "'unavailable'", "'failed'"])} AS status FROM p, (SELECT unnest(range(3)) AS n)),
good AS (SELECT * FROM every WHERE NOT (k % 10 = 3 AND n = 1) AND NOT (k % 15 = 4 AND n = 2)),
broken AS (SELECT substr('{{"appid":' || appid || ',"status":"' || status, 1, 20) AS line FROM every WHERE k % 10 = 3 AND n = 1)"""
IMPORT = f"""{CAT}, facts AS (SELECT appid, title AS name, genre AS cgenre, review_positive, review_total, price_cents FROM cat WHERE appid % 3 <> 0),
raw AS (SELECT o_custkey AS user_id, l_partkey + 1 AS appid, l_orderkey * 10 + l_linenumber AS seen, 'Game ' || l_partkey % 5 AS title, {spot('l_partkey', ["'Unknown'", "'Indie'", "'Utilities / Action'", "''"])} AS genre, CAST(l_quantity - 10 AS DOUBLE) AS hours
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber NOT IN (6, 7)),
last AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY user_id, appid ORDER BY seen DESC) = 1),
games AS (SELECT user_id, l.appid, coalesce(name, title) AS title, CASE WHEN name IS NOT NULL AND genre IN ('', 'Unknown') THEN cgenre ELSE genre END AS genre,
  CAST(CASE WHEN review_total > 0 THEN floor(review_positive * 10 / review_total + 0.5) ELSE 0 END AS BIGINT) AS rating, price_cents, hours FROM last l LEFT JOIN facts f USING (appid)),
library AS (SELECT DISTINCT o_custkey AS user_id, o_orderkey % 200 + 1 AS appid FROM orders WHERE o_orderkey % 5 = 0)"""
_SUMS = "['imported', 'ratio', 'retried', 'failuresSeen']"


def funnel(name: str, goal: str, genres: str, inside: str, tail: str) -> str:
    return f"""{name} AS (SELECT user_id, count(*) AS library, count(*) FILTER (WHERE status = 'Completed') AS completed, count(*) FILTER (WHERE status = 'Slept') AS slept, count(*) FILTER (WHERE {ACTIVE}) AS active,
      count(*) FILTER (WHERE {ACTIVE} AND {inside}) AS inside, count(*) FILTER (WHERE {ACTIVE} AND {inside} AND {genres}) AS genres, count(*) FILTER (WHERE {ACTIVE} AND {inside} AND {genres} AND {goal}) AS goal,
      count(*) FILTER (WHERE {ACTIVE} AND {inside} AND {genres} AND {goal} AND appid % 6 <> 0) AS available FROM lib2 GROUP BY 1),
    {name}_s AS (SELECT '{name}' AS setup, user_id, unnest(list_filter([{{'stage': 'library', 'count': library, 'detail': NULL::VARCHAR}},
      CASE WHEN completed + slept > 0 THEN {{'stage': 'active', 'count': active, 'detail': concat_ws(' · ', CASE WHEN completed > 0 THEN completed || ' completed' END, CASE WHEN slept > 0 THEN slept || ' asleep' END)}} END,
      {tail} CASE WHEN goal > available THEN {{'stage': 'snoozes', 'count': available, 'detail': NULL::VARCHAR}} END, {{'stage': 'available', 'count': available, 'detail': NULL::VARCHAR}},
      CASE WHEN available > 64 THEN {{'stage': 'shortlist', 'count': 64, 'detail': NULL::VARCHAR}} END], lambda x: x IS NOT NULL)) AS s, FROM {name}),
    {name}_p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['library', 'active', 'collection', 'genres', 'goal', 'snoozes', 'available', 'shortlist'], s.stage)) AS place FROM {name}_s)"""


def stage(name: str, count: str) -> str:
    return f"{{'stage': '{name}', 'count': {count}, 'detail': NULL::VARCHAR}},"


def _details() -> str:
    """The lines of both setups; strengths and headlines as in the shorter query of a draw for something new."""
    grade = lambda x, high, low: f"CASE WHEN {x} >= {high} THEN 'perfect' WHEN {x} >= {low} THEN 'strong' ELSE 'good' END"
    line = lambda kind, strength, headline, detail: f"{{'kind': '{kind}', 'strength': {strength}, 'headline': {headline}, 'detail': {detail}}}"
    whole = lambda x: f"CAST(floor({x} + 0.5) AS BIGINT)"
    left, share = "CASE WHEN NOT endless THEN remaining END", "CAST(floor(least(1, review_positive / review_total) * 100 + 0.5) AS BIGINT) || '% positive '"
    selection = "CASE WHEN n > 1 THEN " + line("selection", "CASE WHEN rank <= 3 THEN 'perfect' WHEN rank <= 10 THEN 'strong' ELSE 'good' END",
        f"CASE WHEN rank = 1 THEN 'Best fit' ELSE 'Ranked ' || {rules.ORDINAL('rank')} END || ' of ' || n || ' games'", "'Scored ' || score || '/100 against everything else your setup allows.'") + " END"
    session = line("session", grade(rules.EVENING, 0.93, 0.8), f"CASE WHEN endless THEN 'Plays to any length' ELSE {rules.fit(rules.EVENING, 'Ideal evening session length', 'Good evening session length', 'Workable evening session length')} END",
        f"""CASE WHEN endless THEN 'No fixed ending, so you can stop whenever you like.' WHEN remaining IS NULL THEN 'No length estimate yet, so this is neither helped nor penalised.'
        ELSE CASE WHEN remaining < 1 THEN 'Under an hour left' ELSE 'Roughly ' || {whole('remaining')} || 'h left' END || CASE WHEN remaining >= 10 AND remaining <= 30 THEN ' — a few evenings, which is exactly the shape you asked for.' ELSE ', so an evening covers a good chunk of it.' END END""")  # fmt: skip
    mood = "CASE WHEN intense >= 1 OR drivers <> '' THEN " + line("mood", grade("intense", 7, 5), "CASE WHEN intense >= 7 THEN 'Perfect' WHEN intense >= 5 THEN 'Strong' ELSE 'Fair' END || ' Intense match'",
        "CASE WHEN drivers <> '' THEN 'Tagged ' || replace(drivers, '|', ', ') || ' — that is what gives it the Intense feel.' WHEN intense >= 5 THEN 'Its overall tag mix reads strongly Intense.' ELSE 'Nothing about it pulls against a Intense night.' END") + " END"
    goal = "CASE WHEN percent > 0 THEN " + line("goal", grade("percent", 80, 40), f"CASE WHEN ({left}) IS NULL THEN percent || '% through' ELSE 'About ' || greatest(1, {whole('remaining')}) || 'h from the credits' END",
        f"'You''re ' || percent || '% through' || CASE WHEN ({left}) IS NULL THEN ', so finishing it is realistic.' ELSE ' a game of roughly ' || {whole('estimate / 60')} || 'h — the ending is genuinely in reach.' END") + " END"
    pause = f"CASE WHEN {rules.PAUSED_LONG} IS NOT NULL THEN " + line("dormancy", "'strong'", rules.PAUSED_LONG,
        f"'Last played ' || strftime(last_played_at, '%B %Y') || CASE WHEN {rules.PAUSE_DAYS} >= 365 THEN '. This is exactly the kind of game the Vault exists to resurface.' WHEN {rules.PAUSE_DAYS} >= 60 THEN ', so it is well overdue another look.' ELSE '.' END") + " END"
    genre = f"CASE WHEN len({rules.SHARED}) > 0 THEN " + line("genre", f"CASE WHEN len({rules.SHARED}) = 3 THEN 'perfect' ELSE 'strong' END", f"array_to_string({rules.SHARED}, ' and ') || ', as asked'",
        f"'You filtered for Action, RPG, Strategy and this matches ' || len({rules.SHARED}) || ' of 3.'") + " END"
    across = f"across ' || {rules.COUNT('review_total')} || ' reviews"
    liked = "CASE WHEN kind <> 'none' THEN " + line("appeal", "CASE WHEN points >= 3 THEN 'perfect' WHEN points > 0 THEN 'strong' ELSE 'good' END", rules.LIKED,
        f"""CASE kind WHEN 'phenomenon' THEN {share} || '{across} — this one is a landmark.' WHEN 'acclaimed' THEN {share} || '{across}.'
        WHEN 'hidden-gem' THEN {share} || 'from only ' || {rules.COUNT('review_total')} || ' reviews — beloved by the few who found it.' ELSE 'Only ' || {share} || '{across}, so expect a rough edge or two.' END""") + " END"  # fmt: skip
    taste = "CASE WHEN appid % 5 = 0 THEN " + line("taste", "CASE WHEN appid % 9 >= 5 THEN 'perfect' ELSE 'strong' END", "genre || ' lands well for you'", "'Drawn from what you have actually launched and liked before, not what you told us.'") + " END"

    def of(name: str, goal_of_pool: str, lines: list[str]) -> str:
        rows = f"m AS (SELECT d.*, kind, points, (SELECT count(*) FROM scored s WHERE s.user_id = d.user_id) AS n, {rules.contributors('intense').replace(' AS intense', ' AS drivers')} FROM deck d JOIN appeals USING (appid))"
        return w(f"{pool(goal_of_pool)}, {APPEAL}, {rows}, i AS (SELECT user_id, appid, unnest(list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL)) AS i FROM m)", f"SELECT '{name}' AS setup, user_id, appid, i.* FROM (SELECT user_id, appid, i FROM i)")

    return f"SELECT * FROM ({of('finish', 'finish', [selection, session, mood, goal, pause, genre, liked, taste])}) UNION ALL SELECT * FROM ({of('quick', 'new', [selection, pause, liked])})"


def oracle_sql() -> dict[str, str]:
    return {
        "payload_contains": w(f"""{P}, q AS (SELECT k, k % 19 = 0 AS broken, k % 19 <> 0 AND k % 23 = 0 AS listed, k % 19 <> 0 AND k % 23 <> 0 AS obj FROM p)""",
            """SELECT k, obj AND k % 5 = 3 AS of_batch, obj AND k % 2 = 0 AND k % 3 = 1 AS live_one, obj AND k % 4 = 2 AS with_null, obj AND k = 40 AS of_number,
            obj AND k % 7 = 4 AS nested, false AS no_such, obj AS any_object, listed AS scalar FROM q"""),
        "payloads_checked": w(f"{P}, {GAME_VALUES}, f AS (SELECT *, CASE WHEN no_object THEN 'payload:object' ELSE {GAME_FAULTS} END AS violations FROM g)",
            """SELECT k, violations = '' AS accepted, violations, CASE WHEN violations = '' THEN title END AS title, CASE WHEN violations = '' THEN status END AS status, CASE WHEN violations = '' THEN rating END AS rating,
            CASE WHEN violations = '' THEN hours END AS hours, CASE WHEN violations = '' THEN steam_appid END AS steam_appid, CASE WHEN violations = '' THEN 'Steam' END AS store FROM f"""),
        "draws_checked": w(f"{P}, {DRAW_VALUES}, f AS (SELECT k, {DRAW_SINGLE} AS single, {DRAW_CROSSED} AS crossed FROM q2)",
            "SELECT k, single = '' AND crossed = '' AS accepted, CASE WHEN single <> '' THEN single ELSE crossed END AS violations FROM f"),
        "run_status": """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 17 <> 0 AND (o_orderkey % 9 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) THEN 'partial' ELSE 'succeeded' END AS status FROM orders""",
        "run_totals": f"""SELECT run_id, key, count, sum(count) OVER (PARTITION BY worker, key ORDER BY run_id) AS total FROM (SELECT o_orderkey AS run_id, o_custkey AS worker, unnest({_SUMS}) AS key,
            unnest([o_orderkey % 50, o_orderkey % 4 + 0.5, CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 0 END, 4]::DOUBLE[]) AS count FROM orders WHERE o_orderkey % 17 <> 0)""",
        "landed_attempts": w(LANDED, """SELECT 'result' AS kind, CAST(appid AS VARCHAR) AS id, arg_max(status, (status IN ('ready', 'non_game'), n)) AS status, count(*) FILTER (WHERE status = 'unavailable') AS n FROM good WHERE appid > 0 GROUP BY appid
            UNION ALL SELECT 'broken', line, NULL, count(*) FROM broken GROUP BY line"""),
        "landed_misses": w(LANDED, """SELECT k + 1 AS appid, 'miss' AS kind FROM p WHERE k % 12 <> 0 AND k + 1 NOT IN (SELECT appid FROM good WHERE status = 'ready')
            UNION ALL SELECT k + 1, 'fetch' FROM p WHERE k + 1 NOT IN (SELECT appid FROM good WHERE status IN ('ready', 'non_game'))"""),
        "catalog_details": w(P + """, o AS (SELECT * FROM p WHERE k % 4 <> 0), d AS (SELECT *, p_name || ' II' AS title, k % 3 = 0 AS usd, CASE WHEN k % 7 <> 0 THEN k % 80 ELSE 0 END AS total, greatest(0, k % 100 - 10) AS positive FROM p WHERE k % 3 <> 0)""",
            """SELECT coalesce(d.k, o.k) + 1 AS appid, coalesce(title, 'old') AS name, coalesce(lower(title), 'old') AS normalized_name, CASE WHEN d.k IS NULL OR d.k % 6 <> 1 THEN 'game' ELSE 'unknown' END AS steam_type,
            coalesce(CASE WHEN o.k % 5 = 0 THEN o.k % 4 END, d.k % 3) AS deck_compatibility, CASE WHEN d.k IS NULL THEN o.k % 90 ELSE positive END AS review_positive, CASE WHEN d.k IS NULL THEN o.k % 8 ELSE greatest(0, total - positive) END AS review_negative,
            CASE WHEN d.k IS NULL THEN 'USD' WHEN usd THEN 'USD' END AS price_currency, CASE WHEN d.k IS NULL THEN o.k WHEN usd THEN d.k * 10 END AS price_initial, CASE WHEN d.k IS NULL THEN o.k WHEN usd AND d.k % 5 <> 0 THEN d.k * 9 END AS price_final,
            CASE WHEN d.k IS NULL THEN 5 WHEN usd AND d.k % 4 <> 0 THEN d.k % 70 ELSE 0 END AS discount_percent FROM o FULL JOIN d ON o.k = d.k"""),
        "import_library": w(IMPORT, """SELECT coalesce(g.user_id, l.user_id) AS user_id, coalesce(g.appid, l.appid) AS appid, title, genre, rating, price_cents, coalesce(hours, 99) AS hours,
            CASE WHEN l.appid IS NOT NULL THEN 'Completed' WHEN hours > 0 THEN 'In Progress' ELSE 'Not Started' END AS status, l.appid IS NOT NULL AS known_before FROM games g FULL JOIN library l ON g.user_id = l.user_id AND g.appid = l.appid"""),
        "import_catalog": w(f"""{IMPORT}, fresh AS (SELECT appid, arg_max(title, seen) AS name FROM last WHERE appid % 3 = 0 GROUP BY 1),
            found AS (SELECT DISTINCT appid, 'steam_label:utilities' AS matched_rule FROM games WHERE genre = 'Utilities / Action' AND (appid - 1) % 14 <> 2)""",
            """SELECT appid, name AS value, 'catalog' AS kind FROM facts UNION ALL SELECT appid, name, 'catalog' FROM fresh UNION ALL SELECT appid, matched_rule, 'quarantine' FROM found
            UNION ALL SELECT appid, 'old', 'quarantine' FROM facts WHERE appid % 10 = 0 AND appid NOT IN (SELECT appid FROM found)"""),
        "merged_sources": w(f"{P}, a AS (SELECT * FROM p WHERE k % 3 <> 0), b AS (SELECT k, CASE WHEN k % 5 = 0 THEN upper(p_name) ELSE p_name END AS name FROM p WHERE k % 2 = 0)",
            """SELECT coalesce(a.k, b.k) + 1 AS appid, coalesce(p_name, name) AS name, a.k AS rank_a, b.k + 2 AS rank_b, concat_ws('+', CASE WHEN a.k IS NOT NULL THEN 'owners' END, CASE WHEN b.k IS NOT NULL THEN 'metrics' END) AS sources,
            CASE WHEN p_name <> name THEN name END AS alternate FROM a FULL JOIN b ON a.k = b.k"""),
        "owner_pages_checked": w(P, "SELECT k + 1 AS appid, k + 1 AS rank FROM p WHERE k < (SELECT count(*) FROM p) // 50 * 50 AND k % 9 <> 0"),
        "bootstrap": w(f"""{OWN}, e AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS d FROM events), drawn AS (SELECT user_id, count(DISTINCT d) AS n FROM e GROUP BY 1)""",
            """SELECT user_id, count(*) AS n_games, 6::BIGINT AS n_collections, count(*) FILTER (WHERE appid % 7 IN (1, 2, 3)) AS n_links, count(*) FILTER (WHERE appid % 6 = 0) AS n_snoozes, coalesce(max(drawn.n), 0) AS n_draws,
            count(*) FILTER (WHERE appid % 13 = 0) AS n_hidden, min(appid) AS first_game FROM own LEFT JOIN drawn USING (user_id) GROUP BY user_id"""),
        "funnel_setups": w(
            f"""{LIB}, lib2 AS (SELECT *, appid % 7 = 1 AS member FROM lib), m AS (SELECT 1),
            {funnel('guided', GOALS['new'], "genre IN ('Action', 'RPG', 'Strategy')", 'true', stage('genres', 'genres') + stage('goal', 'goal'))}, {funnel('open', 'true', 'true', 'true', '')},
            {funnel('collection', 'true', 'true', 'member AND appid % 5 <> 0', stage('collection', 'inside'))}""",
            " UNION ALL ".join(f"SELECT setup, user_id, place, s.stage AS stage, s.count AS count, s.detail AS detail FROM {n}_p" for n in ("guided", "open", "collection"))),
        "quick_repick": w(pool("new"), """, counted AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM deck), first AS (SELECT user_id, appid FROM counted WHERE rank - 1 = floor((user_id % 1000 + 0.5) / 1000 * n)),
            rest AS (SELECT c.*, row_number() OVER (PARTITION BY c.user_id ORDER BY rank) AS place, count(*) OVER (PARTITION BY c.user_id) AS left_ FROM counted c LEFT JOIN first f ON f.user_id = c.user_id AND f.appid = c.appid WHERE f.appid IS NULL OR n = 1)
            SELECT user_id, appid FROM rest WHERE place - 1 = floor((user_id % 1000 + 0.5) / 1000 * left_)"""),
        "match_details": _details(),
        "manual_classes": w(f"""{CAT}, r AS (SELECT appid, appid - 1 AS k, CASE WHEN (appid - 1) % 6 = 2 THEN 'steam_label:utilities' WHEN (appid - 1) % 4 = 3 THEN 'release_channel:beta' END AS rule FROM cat)""",
            """SELECT appid, CASE WHEN k % 5 IN (1, 4) THEN true WHEN k % 5 = 0 THEN false ELSE rule IS NOT NULL END AS out,
            CASE WHEN k % 5 = 1 THEN 'bad port' WHEN k % 5 = 4 THEN 'This AppID was manually excluded from the game catalogue.' WHEN k % 5 = 0 THEN NULL WHEN rule LIKE 'steam_label%' THEN 'Steam classified this AppID as utilities, not a game.'
              WHEN rule IS NOT NULL THEN 'The Steam title identifies this AppID as a beta, PTR, playtest, or other test environment.' END AS reason,
            CASE WHEN k % 5 = 0 THEN 'manual:allowed' WHEN k % 10 = 1 THEN 'manual:port' WHEN k % 5 IN (1, 4) THEN 'manual:excluded' ELSE rule END AS matched_rule FROM r"""),
    }
