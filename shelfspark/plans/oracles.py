"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from ..functions.rules import EVENT_SIGNALS, MOOD_PAIRS, MOOD_RULES, MOODS, REVIEW_SIGNALS

CAT = """cat AS (
  SELECT p_partkey + 1 AS appid, p_name AS title, p_size,
         CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'Casual' WHEN 'STANDARD' THEN 'Action' WHEN 'MEDIUM' THEN 'Adventure'
              WHEN 'LARGE' THEN 'Strategy' WHEN 'PROMO' THEN 'RPG' ELSE 'Simulation' END AS genre,
         ['Cozy', 'Horror', 'Puzzle', 'Roguelike', 'Story_Rich', 'Exploration', 'Competitive', 'Arcade'][CAST(p_partkey % 8 AS INT) + 1] AS tag,
         CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price_cents,
         CASE WHEN p_size % 7 <> 0 THEN greatest(60, floor((p_size * 60 + p_size * 90 + p_size * 150) / 3.0 / 60 + 0.5) * 60) END AS estimate,
         p_size % 11 = 0 AS endless,
         coalesce(n, 0) * p_size * p_size AS review_total, coalesce(kept, 0) * p_size * p_size AS review_positive,
         CASE WHEN p_size % 7 <> 0 THEN 'ready' ELSE ['pending', 'processing', 'failed'][CAST(p_partkey % 3 AS INT) + 1] END AS duration_status,
         CASE WHEN p_partkey % 16 = 3 THEN 'pending' WHEN p_partkey % 16 <> 5 THEN 'ready' END AS tags_status
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS kept FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"""
OWN = """own0 AS (
  SELECT o_custkey % 50 AS user_id, l_partkey + 1 AS appid, sum(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS quantity,
         max(l_shipdate) FILTER (WHERE l_returnflag <> 'R') AS last_played_at, min(o_orderdate) AS added_at,
         arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS urgency
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
own1 AS (SELECT *, CASE WHEN state = 'F' AND quantity IS NULL THEN 'Slept' WHEN state = 'F' THEN 'Completed' WHEN state = 'P' THEN 'In Progress' ELSE 'Not Started' END AS status FROM own0),
own AS (SELECT user_id, appid, status, CASE WHEN status = 'Not Started' THEN 0.0::DOUBLE ELSE coalesce(quantity / 10, 0.0::DOUBLE) END AS hours, last_played_at, added_at,
         CASE WHEN urgency = '1-URGENT' THEN 'Must Play' ELSE 'Medium' END AS priority, CASE WHEN status = 'Completed' THEN last_played_at END AS completed_at FROM own1)"""
_RULES = ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', {b}, {c}, {i})" for t, (b, c, i) in MOOD_RULES.items())


def _mood(k: int) -> str:
    any_of = lambda names: "list_has_any(tags, [" + ", ".join(f"'{n}'" for n in names) + "])"
    pairs = "".join(f" + CASE WHEN {any_of(a)} AND {any_of(b)} THEN {v[k]} ELSE 0 END" for a, b, v in MOOD_PAIRS if v[k])
    return f"greatest(-10, least(10, coalesce((SELECT sum(m{k}) FROM rules WHERE list_contains(tags, tag)), 0){pairs}))"


LIB = f"""{CAT}, {OWN},
rules(tag, m0, m1, m2) AS (VALUES {_RULES}),
tagged AS (SELECT DISTINCT genre, tag, list_distinct([lower(genre), lower(replace(tag, '_', ' '))]) AS tags FROM cat),
moods AS (SELECT genre, tag, {", ".join(f"CAST({_mood(k)} AS BIGINT) AS {m.replace('-', '_')}" for k, m in enumerate(MOODS))} FROM tagged),
lib0 AS (
  SELECT o.*, c.* EXCLUDE (appid), m.brain_off, m.chill, m.intense,
         CAST(CASE WHEN status = 'Completed' THEN 100 WHEN endless THEN 99 WHEN estimate IS NOT NULL THEN least(99, greatest(0, floor(hours * 6000 / estimate + 0.5))) ELSE 0 END AS BIGINT) AS percent
  FROM own o JOIN cat c USING (appid) JOIN moods m USING (genre, tag)),
lib1 AS (SELECT *, estimate * greatest(0.05::DOUBLE, 1 - least(99, percent) / 100) / 60 AS remaining FROM lib0),
lib AS (
  SELECT *, CASE WHEN endless OR remaining IS NULL OR remaining <= 10 THEN ['short', 'evening', 'weekend'] WHEN remaining <= 30 THEN ['evening', 'weekend'] ELSE ['weekend'] END AS fits
  FROM lib1)"""
ACTIVE = "status NOT IN ('Completed', 'Slept')"
CHOSEN = "['Action', 'RPG', 'Strategy']"
GOALS = {
    "new": "status = 'Not Started' AND hours <= 0.5",
    "finish": "NOT endless AND (status = 'In Progress' OR (percent > 0 AND percent < 100))",
}
EVENING = """CASE WHEN NOT list_contains(fits, 'evening') THEN 0 WHEN endless THEN 24 WHEN remaining IS NULL THEN 20
  WHEN remaining >= 10 AND remaining <= 30 THEN 30 WHEN remaining >= 6 THEN 26 ELSE 22 END"""
INTENSE = "CASE WHEN intense >= 7 THEN 30 WHEN intense >= 5 THEN 27 WHEN intense >= 3 THEN 23 WHEN intense >= 1 THEN 18 WHEN intense >= -1 THEN 13 WHEN intense >= -3 THEN 8 ELSE 3 END"
GOAL_POINTS = {
    "new": "CASE WHEN hours <= 0 THEN 30 WHEN hours <= 0.25 THEN 27 ELSE 24 END",
    "finish": """least(30, floor(8 + least(12.0::DOUBLE, 0.12::DOUBLE * percent) + CASE WHEN remaining <= 2 THEN 10 WHEN remaining <= 5 THEN 9 WHEN remaining <= 10 THEN 8 WHEN remaining <= 20 THEN 6 ELSE 4 END + 0.5::DOUBLE))""",
}


def pool(goal: str) -> str:
    return f"""{LIB},
scored AS (
  SELECT *, CAST(floor(100 * ({EVENING} + {INTENSE} + {GOAL_POINTS[goal]} + 10.0::DOUBLE * len(list_intersect([genre, tag], {CHOSEN})) / 3) / 100 + 0.5) AS BIGINT) AS score
  FROM lib WHERE {ACTIVE} AND list_has_any([genre, tag], {CHOSEN}) AND {GOALS[goal]}),
deck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, title, appid) AS rank FROM scored) WHERE rank <= 64)"""


APPEAL = """a0 AS (SELECT *, CASE WHEN review_total > 0 THEN review_positive / review_total ELSE 0 END AS share, log10(greatest(1, review_total)) AS v FROM cat),
a1 AS (SELECT *, CASE WHEN review_total >= 50 THEN least(1, greatest(0, (v - 2.5) / 3.5)) * least(1, greatest(0, (share - 0.5) / 0.35)) ELSE 0 END AS hype,
  CASE WHEN review_total >= 50 THEN least(1, greatest(0, (share - 0.8) / 0.2)) * least(1, greatest(0, (3.6 - v) / 2)) ELSE 0 END AS gem FROM a0),
appeals AS (SELECT appid, least(6, greatest(-6, 4 * hype + 4 * gem - CASE WHEN review_total >= 50 AND share < 0.55 THEN 3 ELSE 0 END)) AS points,
  CASE WHEN review_total < 50 THEN 'none' WHEN share < 0.55 THEN 'divisive' WHEN gem >= 0.3 THEN 'hidden-gem' WHEN hype >= 0.6 THEN 'phenomenon'
       WHEN hype >= 0.3 AND share >= 0.9 THEN 'acclaimed' ELSE 'none' END AS kind FROM a1)"""
FINAL = f"""{pool("new")}, {APPEAL},
counted AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM deck),
finalists AS (SELECT * FROM counted WHERE rank <= CASE WHEN n <= 5 THEN n ELSE least(20, greatest(3, ceil(0.4 * n))) END)"""
SOFT = f"""{FINAL},
weighed AS (SELECT f.*, exp((score + points - max(score + points) OVER (PARTITION BY user_id)) / 15.0) AS w FROM finalists f JOIN appeals USING (appid)),
soft AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS probability FROM weighed)"""
_SIGNALS = ", ".join(f"('{e}', {p}.0::DOUBLE, {t}.0::DOUBLE, {str(m).lower()})" for e, (p, t, m) in EVENT_SIGNALS.items())
DRAWS = """d0 AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS k FROM events),
draws AS (
  SELECT user_id, k, first_value(event_id) OVER o % (SELECT count(*) FROM part) + 1 AS appid, first_value(ts) OVER o AS drawn_at, ts AS created_at, event_id,
         [NULL, 'brain-off', 'chill', 'intense'][CAST(k % 4 AS INT) + 1] AS mood,
         CASE event_type WHEN 'purchase' THEN 'opened_on_steam' WHEN 'click' THEN 'liked' WHEN 'signup' THEN 'pinned' WHEN 'view' THEN 'drew_again'
           ELSE CASE WHEN event_id % 2 = 0 THEN 'reroll_not_interested' ELSE 'reroll_wrong_mood' END END AS event
  FROM d0 WINDOW o AS (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_TALLY = """fan AS (
  SELECT user_id, unnest([lower(genre), '__baseline__']) AS genre, positive, total, mood, mood_only FROM signals),
wide AS (
  SELECT user_id, genre, 'any' AS context, positive, total FROM fan WHERE NOT mood_only
  UNION ALL SELECT user_id, genre, mood, positive, total FROM fan WHERE mood IS NOT NULL),
tally AS (SELECT user_id, context, genre, round(sum(positive), 4) AS positive, round(sum(total), 4) AS total FROM wide GROUP BY ALL)"""
TALLY = f"""{CAT}, {DRAWS},
table_of_signals(event, positive, total, mood_only) AS (VALUES {_SIGNALS}),
recent AS (SELECT *, bool_or(event LIKE 'reroll\\_%' ESCAPE '\\') OVER (PARTITION BY user_id, k) AS reason FROM draws WHERE drawn_at >= TIMESTAMP '2024-01-31' - INTERVAL 180 DAY),
signals AS (
  SELECT user_id, genre, mood, mood_only, positive * w AS positive, total * w AS total
  FROM (SELECT *, pow(0.5, greatest(0, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(created_at)) / 86400000000 / 60) AS w FROM recent) r
  JOIN table_of_signals s USING (event) JOIN cat USING (appid) WHERE NOT (event = 'drew_again' AND reason)),
{_TALLY}"""
SNAP = """snaps AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(floor(sum(CAST(value AS DECIMAL(28, 6)))) AS BIGINT) AS m FROM events GROUP BY 1, 2),
totals AS (SELECT user_id, day, sum(m) OVER (PARTITION BY user_id ORDER BY day) AS total FROM snaps),
gains AS (SELECT user_id, day, CAST(greatest(0, total - before) AS BIGINT) AS minutes FROM (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY day) AS before FROM totals) WHERE before IS NOT NULL)"""
NOW = "TIMESTAMP '2001-12-01'"
LENGTH, IDLE = "estimate / 60", f"CASE WHEN last_played_at IS NOT NULL THEN greatest(0, floor((epoch_us({NOW}) - epoch_us(last_played_at)) / 86400000000)) END"
PRESETS = {
    "nearly-finished": f"{ACTIVE} AND NOT endless AND percent >= 65 AND percent < 100",
    "quick-wins": f"{ACTIVE} AND NOT endless AND {LENGTH} - hours > 0 AND {LENGTH} - hours <= 8",
    "recently-played": f"{ACTIVE} AND hours > 0 AND {IDLE} <= 30",
    "fallen-off": f"{ACTIVE} AND hours > 0 AND {IDLE} >= 180",
    "long-haul": f"{ACTIVE} AND NOT endless AND percent < 65 AND {LENGTH} >= 40",
    "endless-rotation": f"{ACTIVE} AND endless",
    "untouched": f"{ACTIVE} AND hours = 0",
    "backlog": "status = 'Not Started'",
    "in-progress": "status IN ('In Progress', 'Sampled')",
    "must-play": "priority = 'Must Play'",
    "unplayed": "hours = 0",
    "short": f"{ACTIVE} AND NOT endless AND {LENGTH} <= 10",
}
MEMBERS = f"{LIB}, members AS (" + " UNION ALL ".join(f"SELECT user_id, appid, '{k}' AS preset FROM lib WHERE {v}" for k, v in PRESETS.items()) + ")"
VERDICTS = """verdicts AS (
  SELECT o_custkey % 50 AS user_id, l_partkey + 1 AS appid, ['sleep', 'keep', 'pin', 'complete'][CAST(o_orderkey % 4 AS INT) + 1] AS action, o_orderdate AS reviewed_at, o_orderkey AS review_id
  FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, appid ORDER BY reviewed_at DESC, review_id DESC) AS k FROM verdicts) WHERE k = 1)"""
RANKS = """per AS (SELECT l_partkey + 1 AS appid, count(*)::DOUBLE AS count, round(sum(l_extendedprice), 2) AS revenue, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
long AS (SELECT appid, 'count' AS metric, count AS value FROM per UNION ALL SELECT appid, 'revenue', revenue FROM per UNION ALL SELECT appid, 'quantity', quantity FROM per),
ranks AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, appid) AS rank FROM long)"""
RRF = f"""{RANKS},
fused AS (SELECT appid, round(sum(CASE metric WHEN 'count' THEN 0.5 WHEN 'revenue' THEN 0.3 ELSE 0.2 END::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM ranks GROUP BY appid),
rrf AS (SELECT *, row_number() OVER (ORDER BY score DESC, best_rank, appid) AS rank FROM fused ORDER BY score DESC, best_rank, appid LIMIT 100)"""
COHORTS = f"""{RRF},
a AS (SELECT appid, p_name AS name, rank FROM rrf JOIN part ON appid = p_partkey + 1),
b AS (SELECT appid, CASE WHEN appid % 5 = 0 THEN upper(p_name) ELSE p_name END AS name, rank FROM ranks JOIN part ON appid = p_partkey + 1 WHERE metric = 'revenue' AND rank <= 100)"""
#: The whole_* queries are those over all ranks, as the others are by now.
WHOLE = {"ranks": RANKS, "rrf": RRF, "cohorts": COHORTS}
_REVIEWS = ", ".join(f"('{a}', {p}.0::DOUBLE, {t}.0::DOUBLE)" for a, (p, t) in REVIEW_SIGNALS.items())
EPS = "greatest(0.000001::DOUBLE, least(0.999999::DOUBLE, {0}))"


def _logit(x: str) -> str:
    y = EPS.format(x)
    return f"ln({y} / (1 - {y}))"


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, select: f"WITH {ctes}{select if select.startswith(',') else ' ' + select}"
    sums = lambda c, cond, a: ", ".join(f"sum({v}) FILTER (WHERE context = '{c}' AND total > 0 AND {cond}) AS {a}_{v[0]}" for v in ("positive", "total"))
    z = lambda c: f"coalesce({c}, 0)"
    return {
        "draw_pool_topk": w(FINAL, "SELECT user_id, rank, appid, score FROM finalists"),
        "draw_pool_finish": w(pool("finish"), "SELECT user_id, rank, appid, score FROM deck"),
        "eligibility_funnel": w(LIB, f"""SELECT user_id, count(*) AS owned, count(*) FILTER (WHERE {ACTIVE}) AS active,
            count(*) FILTER (WHERE {ACTIVE} AND list_has_any([genre, tag], {CHOSEN})) AS genre,
            count(*) FILTER (WHERE {ACTIVE} AND list_has_any([genre, tag], {CHOSEN}) AND {GOALS["new"]}) AS goal FROM lib GROUP BY 1"""),
        "mood_and_sessions": w(LIB, "SELECT user_id, appid, percent, array_to_string(fits, ',') AS fits, brain_off, chill, intense FROM lib"),
        "appeal": w(f"{CAT}, {APPEAL}", "SELECT appid, round(points, 6) AS points, kind FROM appeals"),
        "softmax_probabilities": w(SOFT, "SELECT user_id, rank, appid, round(probability, 6) AS probability FROM soft"),
        "softmax_pick": w(SOFT, """SELECT user_id, min(rank) AS rank, arg_min(appid, rank) AS appid
            FROM (SELECT *, round(sum(probability) OVER (PARTITION BY user_id ORDER BY rank), 9) AS c FROM soft) WHERE c >= (user_id % 1000 + 0.5) / 1000 GROUP BY 1"""),
        "quick_pick": w(pool("new"), """SELECT user_id, rank, appid FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM deck)
            WHERE rank - 1 = floor((user_id % 1000 + 0.5) / 1000 * n)"""),
        "preference_tally": w(TALLY, "SELECT * FROM tally"),
        "preference_globals": w(TALLY, "SELECT context, genre, round(sum(positive), 4) AS positive, round(sum(total), 4) AS total FROM tally GROUP BY ALL"),
        "genre_idf": w(CAT, """SELECT genre, df, round(x / avg(x) OVER (), 6) AS weight
            FROM (SELECT lower(genre) AS genre, count(*) AS df, ln(1 + (SELECT count(*) FROM cat) / count(*)) AS x FROM cat GROUP BY 1)"""),
        "preference_points": w(
            f"""{TALLY}, pop AS (SELECT context, genre, round(sum(positive), 4) AS positive, round(sum(total), 4) AS total FROM tally GROUP BY ALL),
            g AS (SELECT user_id, genre, {sums("any", "true", "ga")}, {sums("intense", "true", "gm")} FROM tally WHERE genre <> '__baseline__' GROUP BY ALL),
            b AS (SELECT user_id, {sums("any", "true", "ba")}, {sums("intense", "true", "bm")} FROM tally WHERE genre = '__baseline__' GROUP BY ALL),
            p AS (SELECT genre, {sums("any", "true", "pa")} FROM pop WHERE genre <> '__baseline__' GROUP BY ALL),
            q AS (SELECT sum(positive) AS qp, sum(total) AS qt FROM pop WHERE genre = '__baseline__' AND context = 'any'),
            s1 AS (SELECT *, ({z("qp")} + 4) / ({z("qt")} + 8) AS lvl FROM g JOIN b USING (user_id) JOIN p USING (genre), q),
            s2 AS (SELECT *, ({z("ba_p")} + 8 * lvl) / ({z("ba_t")} + 8) AS oa, ({z("pa_p")} + 4 * lvl) / ({z("pa_t")} + 4) AS pg FROM s1),
            s3 AS (SELECT *, ({z("bm_p")} + 8 * oa) / ({z("bm_t")} + 8) AS o FROM s2),
            s4 AS (SELECT *, 1 / (1 + exp(-({_logit("o")} + {_logit("pg")} - {_logit("lvl")}))) AS prior FROM s3),
            s5 AS (SELECT *, ({z("gm_p")} + 8 * (({z("ga_p")} + 8 * prior) / ({z("ga_t")} + 8))) / ({z("gm_t")} + 8) AS rate FROM s4)""",
            f"SELECT user_id, genre, round(8 * tanh(({_logit('rate')} - {_logit('o')}) / 3), 6) AS points FROM s5 WHERE ga_t IS NOT NULL OR gm_t IS NOT NULL OR pa_t IS NOT NULL"),
        "review_tally": w(
            f"""{CAT}, {VERDICTS}, table_of_signals(action, positive, total) AS (VALUES {_REVIEWS}),
            signals AS (SELECT user_id, genre, NULL::VARCHAR AS mood, false AS mood_only, positive * wt AS positive, total * wt AS total
              FROM (SELECT *, pow(0.5, greatest(0, epoch_us({NOW}) - epoch_us(reviewed_at)) / 86400000000 / 60) AS wt FROM latest WHERE reviewed_at >= {NOW} - INTERVAL 180 DAY)
              JOIN table_of_signals USING (action) JOIN cat USING (appid)), {_TALLY}""", "SELECT * FROM tally"),
        "library_stats": w(LIB, """SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'Completed') AS completed,
            count(*) FILTER (WHERE status <> 'Completed' AND (percent > 10 OR (endless AND hours > 0))) AS in_progress, floor(round(sum(hours), 6) * 10 + 0.5) / 10 AS hours,
            coalesce(floor(avg(rating) FILTER (WHERE rating > 0) * 10 + 0.5) / 10, 0) AS avg_rating, floor(avg(percent) * 10 + 0.5) / 10 AS mean_progress
            FROM (SELECT *, CASE WHEN review_total > 0 THEN floor(review_positive * 10 / review_total + 0.5) ELSE 0 END AS rating FROM lib) GROUP BY 1"""),
        "backlog_stats": w(LIB, """, s AS (
              SELECT user_id, count(*) AS total_games, count(*) FILTER (WHERE status = 'Completed') AS completed_games, CAST(sum(price_cents) AS BIGINT) AS library_cents,
                CAST(coalesce(sum(price_cents) FILTER (WHERE status = 'Completed'), 0) AS BIGINT) AS completed_cents, CAST(floor(round(sum(greatest(0, hours)), 6) + 0.5) AS BIGINT) AS total_hours,
                count(*) FILTER (WHERE hours <= 0) AS unplayed_games, CAST(coalesce(sum(price_cents) FILTER (WHERE hours <= 0), 0) AS BIGINT) AS unplayed_cents,
                count(*) FILTER (WHERE price_cents > 0) AS priced_games,
                arg_min(appid, (round(price_cents / hours, 6), appid)) FILTER (WHERE price_cents > 0 AND hours >= 1) AS best_value_appid,
                arg_max(appid, (completed_at, -appid)) FILTER (WHERE completed_at IS NOT NULL) AS latest_completed_appid FROM lib GROUP BY 1)
            SELECT *, CAST(least(100, floor(100.0::DOUBLE * completed_cents / library_cents + 0.5)) AS BIGINT) AS value_percent,
              CAST(least(100, floor(100.0::DOUBLE * completed_games / total_games + 0.5)) AS BIGINT) AS completed_percent FROM s"""),
        "best_value_topk": w(LIB, """SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY round(price_cents / hours, 4), appid) AS rank, appid,
            round(price_cents / hours, 4) AS cents_per_hour FROM lib WHERE price_cents > 0 AND hours >= 1) WHERE rank <= 5"""),
        "enrichment_progress": w(LIB, """, s AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE coalesce(duration_status IN ('pending', 'processing'), false)
              OR coalesce(tags_status IN ('pending', 'processing'), false)) AS processing FROM lib GROUP BY 1)
            SELECT *, total - processing AS ready, CAST(floor(100.0::DOUBLE * (total - processing) / total + 0.5) AS BIGINT) AS percent_ready FROM s"""),
        "tab_counts": w(LIB, f"""SELECT user_id, count(*) FILTER (WHERE {ACTIVE}) AS active, count(*) FILTER (WHERE status = 'Completed') AS completed,
            count(*) FILTER (WHERE status = 'Slept') AS slept FROM lib GROUP BY 1"""),
        "playtime_gains": w(SNAP, "SELECT * FROM gains"),
        "playtime_streaks": w(
            f"""{SNAP}, played AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS run FROM gains WHERE minutes > 0 AND day <= DATE '2024-01-30'),
            ends AS (SELECT user_id, run, count(*) AS n, max(day) AS last FROM played GROUP BY ALL),
            live AS (SELECT user_id, arg_max(n, last) AS streak FROM ends WHERE last >= DATE '2024-01-29' GROUP BY 1)""",
            "SELECT user_id, coalesce(streak, 0) AS streak FROM (SELECT DISTINCT user_id FROM gains) LEFT JOIN live USING (user_id)"),
        "playtime_rollup": w(SNAP, "SELECT user_id, " + ", ".join(
            f"CAST(coalesce(sum(minutes) FILTER (WHERE day > DATE '2024-01-30' - {d} AND day <= DATE '2024-01-30'), 0) AS BIGINT) AS minutes_{d}d" for d in (7, 30)) + " FROM gains GROUP BY 1"),
        "visit_recap": w(
            f"""{SNAP}, {OWN}, visits AS (SELECT user_id, min(CAST(ts AS DATE)) AS visited FROM events WHERE event_type = 'view' GROUP BY 1),
            done AS (SELECT user_id, DATE '2024-01-30' - CAST(appid % 400 AS INT) AS day FROM own WHERE status = 'Completed'),
            spans AS (SELECT u.user_id, visited IS NULL OR DATE '2024-01-30' - visited > 30 AS windowed, CASE WHEN visited IS NULL OR DATE '2024-01-30' - visited > 30 THEN DATE '2024-01-23' ELSE visited END AS since
              FROM (SELECT user_id FROM events UNION SELECT user_id FROM own) u LEFT JOIN visits USING (user_id)),
            t AS (SELECT user_id, since, windowed, CAST((SELECT coalesce(sum(minutes), 0) FROM gains g WHERE g.user_id = s.user_id AND day > since AND day <= DATE '2024-01-30') AS BIGINT) AS minutes,
              (SELECT count(*) FROM done d WHERE d.user_id = s.user_id AND day > since AND day <= DATE '2024-01-30') AS games_finished FROM spans s WHERE windowed OR since < DATE '2024-01-30')""",
            "SELECT *, floor(minutes / 60 * 10 + 0.5) / 10 AS hours FROM t WHERE minutes >= 20 OR games_finished > 0"),
        "smart_collections": w(MEMBERS, "SELECT * FROM members"),
        "collection_counts": w(MEMBERS, "SELECT user_id, preset, count(*) AS n FROM members GROUP BY ALL"),
        "completion_queue": w(
            f"{LIB}, q AS (SELECT *, hours * 60 / estimate AS over FROM lib WHERE {ACTIVE} AND NOT endless AND estimate >= 120), r AS (SELECT *, CASE WHEN over <= 1.5 THEN 1.0 WHEN over <= 2.5 THEN 0.8 WHEN over <= 4 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM q WHERE over >= 0.9)",
            "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, price_cents DESC, appid) AS rank, appid, confidence FROM r"),
        "purge_queue": w(
            f"""{LIB}, {APPEAL}, {VERDICTS}, rested AS (SELECT DISTINCT user_id, appid FROM verdicts WHERE epoch_us({NOW}) - epoch_us(reviewed_at) < CASE WHEN action = 'keep' THEN 180 * 86400000000 ELSE 300000000 END),
            base AS (SELECT lib.*, kind, CASE WHEN last_played_at IS NULL THEN 'infinity'::DOUBLE ELSE greatest(0, (epoch_us({NOW}) - epoch_us(last_played_at)) / 86400000000) END AS idle
              FROM lib JOIN appeals USING (appid) ANTI JOIN rested USING (user_id, appid) WHERE {ACTIVE} AND appid % 13 <> 0),
            q AS (SELECT *, CASE WHEN hours = 0 THEN 'untouched' WHEN percent <= 50 THEN 'stalled' ELSE 'dormant' END AS category,
              CASE kind WHEN 'divisive' THEN 'cut' WHEN 'none' THEN NULL ELSE 'keep' END AS signal,
              CASE WHEN hours = 0 THEN 2.0 ELSE 0.0 END::DOUBLE + CASE WHEN idle >= 730 THEN 1.5 WHEN idle >= 365 THEN 1.0 ELSE 0.0 END::DOUBLE
                + CASE kind WHEN 'divisive' THEN 2.0 WHEN 'none' THEN 0.0 ELSE -2.5 END::DOUBLE AS confidence FROM base
              WHERE (hours = 0 OR idle >= 180) AND NOT coalesce(NOT endless AND hours * 60 / estimate >= 0.9 AND estimate >= 120, false))""",
            "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, price_cents, title, appid) AS rank, appid, category, signal, confidence FROM q"),
        "purge_standing": w(f"{LIB}, {VERDICTS}", """SELECT user_id, appid, action, status, CASE action WHEN 'sleep' THEN status <> 'Slept' WHEN 'complete' THEN status <> 'Completed'
            ELSE status IN ('Slept', 'Completed') END AS superseded FROM latest JOIN lib USING (user_id, appid)"""),
        "rrf_cohort": w(RRF, "SELECT * FROM rrf"),
        "cohort_full_outer_merge": w(COHORTS, "SELECT appid, coalesce(a.name, b.name) AS name, a.rank AS rank_a, b.rank AS rank_b, coalesce(a.name <> b.name, false) AS conflict FROM a FULL JOIN b USING (appid)"),
        "dedupe_first_wins": w(RANKS, "SELECT appid, metric, rank FROM (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY rank, metric) AS k FROM ranks) WHERE k = 1"),
        "dedupe_last_wins": """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
            ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END DESC, o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""",
        "coverage_anti": w(COHORTS, "SELECT appid, rank FROM b WHERE appid NOT IN (SELECT appid FROM a)"),
        "eligible_semi": w(COHORTS, "SELECT appid, rank FROM b WHERE appid IN (SELECT appid FROM a)"),
        "duration_cascade": """WITH m AS (SELECT p_partkey + 1 AS appid, unnest(CASE WHEN p_partkey % 10 = 4 THEN [p_partkey, p_partkey + 100000] ELSE [p_partkey] END) AS g FROM part WHERE p_partkey % 10 <> 3),
            ids AS (SELECT appid, count(DISTINCT g) AS n, min(g) AS g FROM m GROUP BY 1), dir AS (SELECT p_partkey AS g, p_size * 60 AS minutes FROM part WHERE p_size % 3 <> 0),
            j AS (SELECT p.p_partkey + 1 AS appid, n, o.minutes AS own, q.minutes AS par FROM part p LEFT JOIN ids ON ids.appid = p.p_partkey + 1 LEFT JOIN dir o ON o.g = ids.g
              LEFT JOIN dir q ON ids.g % 2 = 0 AND ids.g IN (SELECT p_partkey FROM part) AND q.g = ids.g + 1),
            s AS (SELECT *, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN own IS NOT NULL THEN 'direct' WHEN par IS NOT NULL THEN 'parent' ELSE 'no_duration' END AS status FROM j)
            SELECT appid, status, CASE status WHEN 'direct' THEN own WHEN 'parent' THEN par END AS minutes FROM s""",
        "tag_rank": """WITH p AS (SELECT l_partkey + 1 AS appid, l_returnflag AS tag, sum(l_quantity) - 50 AS w FROM lineitem GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY w DESC, tag) AS k FROM p WHERE w > 0)
            SELECT a.appid, coalesce(string_agg(tag, ',' ORDER BY k), '') AS labels FROM (SELECT DISTINCT appid FROM p) a LEFT JOIN r ON r.appid = a.appid AND k <= 2 GROUP BY 1""",
        "exclusion_rules": w(CAT, """SELECT appid, CASE WHEN appid % 17 = 0 THEN 'steam_type:dlc' WHEN appid % 11 = 0 THEN 'steam_label:utilities' WHEN appid % 8 < 6
            THEN 'release_channel:' || ['beta', 'playtest', 'public_test', 'test_environment', 'ptr', 'staging'][CAST(appid % 8 AS INT) + 1] END AS matched_rule FROM cat"""),
        "status_histogram": w(LIB, "SELECT status, count(*) AS n, round(sum(hours), 2) AS hours FROM lib GROUP BY 1"),
        "quality_gate": w(RANKS, "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated, 0::BIGINT AS blank_names FROM (SELECT appid, count(*) AS n FROM ranks GROUP BY 1)"),
        "pin_state": """WITH RECURSIVE e AS (SELECT user_id, event_id % 50 AS appid, event_type = 'signup' AS pin, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
              FROM events WHERE event_type IN ('signup', 'error')),
            f(user_id, k, pins) AS (SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[] FROM e
              UNION ALL SELECT f.user_id, e.k, CASE WHEN pin AND NOT list_contains(pins, appid) AND len(pins) < 3 THEN list_append(pins, appid) WHEN NOT pin THEN list_filter(pins, lambda x: x <> appid) ELSE pins END
              FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
            SELECT user_id, array_to_string(arg_max(pins, k), ',') AS pins FROM f GROUP BY 1""",
        "page_link_scan": """SELECT DISTINCT unnest(regexp_extract_all(html, '<html lang="([a-z]+)"', 1)) AS id FROM pages""",
        "rate_window": """SELECT user_id, window_start, n, n > 1 AS over FROM (SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)""",
        "dedupe_window": "SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('error', 'signup')",
        "whole_rrf_cohort": w(WHOLE["rrf"], "SELECT * FROM rrf"),
        "whole_cohort_merge": w(WHOLE["cohorts"], "SELECT appid, coalesce(a.name, b.name) AS name, a.rank AS rank_a, b.rank AS rank_b, coalesce(a.name <> b.name, false) AS conflict FROM a FULL JOIN b USING (appid)"),
        "whole_coverage_anti": w(WHOLE["cohorts"], "SELECT appid, rank FROM b WHERE appid NOT IN (SELECT appid FROM a)"),
        "whole_eligible_semi": w(WHOLE["cohorts"], "SELECT appid, rank FROM b WHERE appid IN (SELECT appid FROM a)"),
        "whole_dedupe_first_wins": w(WHOLE["ranks"], "SELECT appid, metric, rank FROM (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY rank, metric) AS k FROM ranks) WHERE k = 1"),
        "whole_quality_gate": w(WHOLE["ranks"], "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated, 0::BIGINT AS blank_names FROM (SELECT appid, count(*) AS n FROM ranks GROUP BY 1)"),
        "page_hrefs": r"""SELECT DISTINCT page_id, q[2:-2] AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*'')', 1)) AS q FROM pages)""",
        "dedupe_events": """WITH RECURSIVE e AS (SELECT event_id, ts, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
            r AS (SELECT *, ts AS last, true AS ok FROM e WHERE k = 1 UNION ALL
              SELECT e.*, CASE WHEN e.ts > r.last + INTERVAL 10 MINUTE THEN e.ts ELSE r.last END, e.ts > r.last + INTERVAL 10 MINUTE
              FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.k = r.k + 1)
            SELECT event_id, ts, user_id, event_type FROM r WHERE ok""",
        "title_normalise": """WITH t AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS n FROM part)
            SELECT p_partkey, k AS words, k AS ascii, k AS folded, k AS title, n || ' (2019) - Deluxe Edition|' || n || ' (2019)' AS variants
            FROM (SELECT *, trim(regexp_replace(lower(n || ' (2019) - Deluxe Edition'), '[^a-z0-9]+', ' ', 'g')) AS k FROM t)""",
        "genre_labels": """SELECT p_partkey, p_type || '|' || p_brand AS genres, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g')) AS key FROM part""",
        "library_orders": w(LIB, """SELECT user_id, appid, row_number() OVER (PARTITION BY user_id ORDER BY last_played_at DESC NULLS LAST, title, appid) AS by_recent,
            row_number() OVER (PARTITION BY user_id ORDER BY title, appid) AS by_title, row_number() OVER (PARTITION BY user_id ORDER BY hours DESC, title, appid) AS by_hours,
            row_number() OVER (PARTITION BY user_id ORDER BY percent DESC, title, appid) AS by_progress,
            row_number() OVER (PARTITION BY user_id ORDER BY added_at DESC, title, appid) AS by_added,
            row_number() OVER (PARTITION BY user_id ORDER BY estimate ASC NULLS LAST, title, appid) AS by_duration,
            row_number() OVER (PARTITION BY user_id ORDER BY list_position(['Completed', 'In Progress', 'Not Started', 'Slept'], status), title, appid) AS by_status FROM lib"""),
        "recent_activity": w(LIB, """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY last_played_at DESC, title, appid) AS rank, appid, title
            FROM lib WHERE hours > 0 AND last_played_at IS NOT NULL QUALIFY rank <= 4"""),
        "showcase": w(f"{OWN}, f AS (SELECT *, status = 'Completed' AND last_played_at IS NOT NULL AS finished FROM own), g AS (SELECT *, bool_or(finished) OVER (PARTITION BY user_id) AS has_done FROM f)",
            """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN finished THEN last_played_at END DESC NULLS LAST, hours DESC, appid) AS rank, appid, finished
            FROM g WHERE finished OR (NOT has_done AND hours >= 1) QUALIFY rank <= 4"""),
        "playtime_totals": w(OWN, """SELECT user_id, CAST(sum(floor(hours * 60 + 0.5::DOUBLE)) AS BIGINT) AS total_minutes, count(*) FILTER (WHERE floor(hours * 60 + 0.5::DOUBLE) > 0) AS played_games FROM own GROUP BY 1"""),
        "pin_progress": w(f"{OWN}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY added_at, appid) AS slot FROM own)",
            """SELECT user_id, slot, appid, gained, gained > 0.1 AS started FROM (SELECT *, CASE WHEN appid % 4 <> 0 THEN round(greatest(0, hours - floor(hours / 2)), 6) END AS gained
            FROM p WHERE slot <= 5 AND status NOT IN ('Completed', 'Slept'))"""),
        "draw_history": w(f"{CAT}, {DRAWS}, g AS (SELECT user_id, k, min(appid) AS appid, min(drawn_at) AS drawn_at, count(event) AS n_events, arg_max(event, (created_at, event_id)) AS last_event FROM draws GROUP BY 1, 2)",
            """SELECT user_id, rank, appid, title, CASE WHEN CAST(drawn_at AS DATE) = DATE '2024-01-31' THEN 'Today' ELSE strftime(drawn_at, '%A %-d %b') END AS label, n_events, last_event
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY drawn_at DESC, k DESC) AS rank FROM g) LEFT JOIN cat USING (appid) WHERE rank <= 50"""),
        "ownership_reconcile": w(OWN, "SELECT user_id, appid, CASE WHEN (user_id + appid) % 9 <> 0 THEN 'Owned' ELSE 'Wishlist' END AS ownership FROM own"),
        "device_facts": """SELECT p_partkey + 1 AS appid, CASE WHEN p_size % 5 = 0 THEN 3 WHEN p_size % 3 = 0 THEN 2 END AS deck_compatibility, CASE WHEN p_size % 4 = 0 THEN true END AS platform_mac
            FROM part WHERE p_size % 5 = 0 OR p_size % 3 = 0 OR p_size % 4 = 0""",
    }
