"""DuckDB SQL that gives the rows of the queries of stored tables."""

from __future__ import annotations

from . import oracles as base
from .rule_oracles import TAGS, spot, tops, unique
from .rule_queries import TAG_SETS

NOW, CAT, OWN, LIB = base.NOW, base.CAT, base.OWN, base.LIB
BOTH = f"{CAT}, {OWN}"
TITLED = f"{BOTH}, titled AS (SELECT o.*, title FROM own o JOIN cat USING (appid))"
SHELVES = f"""shelves AS (SELECT user_id, user_id * 10 + k AS collection_id, CASE WHEN k = 0 THEN 'system' WHEN k < 5 THEN 'custom' ELSE 'smart' END AS kind,
    ['Entire Vault', 'Best of', 'Two Player', 'Late nights', '', 'Unplayed', 'Two hours'][k + 1] || ' ' || user_id AS name, CASE k WHEN 5 THEN 'untouched' WHEN 6 THEN 'quick-wins' END AS preset,
    DATE '2001-01-01' + CAST((user_id * 10 + k) * 37 % 100 AS INT) AS updated_at FROM (SELECT DISTINCT user_id FROM own), (SELECT unnest([0, 1, 2, 3, 5, 6]) AS k))"""
LINKS = """links AS (SELECT user_id * 10 + appid % 7 AS collection_id, user_id, CASE WHEN appid % 5 = 0 THEN appid + 100000 ELSE appid END AS appid, appid % 4 AS position, added_at AS created_at
    FROM own WHERE appid % 7 IN (1, 2, 3))"""
SMART = f"""smart AS (SELECT s.collection_id, m.user_id, m.appid, row_number() OVER (PARTITION BY s.collection_id ORDER BY title, m.appid) - 1 AS position
    FROM members m JOIN shelves s ON m.user_id = s.user_id AND m.preset = s.preset JOIN lib l ON l.user_id = m.user_id AND l.appid = m.appid)"""
COLLECTIONS = f"{base.MEMBERS}, {SHELVES}, {LINKS}, {SMART}"
IMPORTED = """imported AS (SELECT CASE WHEN l_linenumber <> 7 THEN l_partkey + 1 END AS appid, l_orderkey * 10 + l_linenumber AS seen,
    CASE WHEN l_linenumber = 6 THEN '' ELSE 'Game ' || l_orderkey % 5 END AS title, ['Unknown', 'Indie', 'Utilities / Action', ''][CAST(l_orderkey % 4 AS INT) + 1] AS genre FROM lineitem),
latest_import AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY seen DESC) AS k FROM imported WHERE appid > 0 AND title <> '') WHERE k = 1)"""
MANUAL = "manual AS (SELECT doc_id + 1 AS appid, CASE WHEN toxic = 1 THEN 'excluded' ELSE 'allowed' END AS review_status FROM labels)"
WHOLE_RANKS = base.RANKS


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, select: f"WITH {ctes} {select}"
    core = base.oracle_sql()
    day = lambda c: f"strftime({c}, '%Y-%m-%d %H')"
    guest = "popularity NULLS LAST, review_total DESC NULLS LAST, appid"
    return {
        "games_listing": w(TITLED, "SELECT user_id, appid, row_number() OVER (PARTITION BY user_id ORDER BY title, appid) AS place FROM titled WHERE appid % 13 <> 0"),
        "find_game": w(TITLED, "SELECT user_id, appid, title, status FROM titled WHERE user_id = 7 AND appid % 13 <> 0 ORDER BY appid LIMIT 1"),
        "library_search": w(LIB, f"SELECT user_id, appid FROM lib WHERE (contains(lower(title), 'wid') OR contains(lower(genre || ' ' || tag), 'horror')) AND {base.ACTIVE}"),
        "device_filter": f"""WITH f AS ({core['device_facts']}) SELECT appid, 'deck' AS mode FROM f WHERE deck_compatibility >= 2 UNION ALL SELECT appid, 'mac' FROM f WHERE platform_mac""",
        "catalogue_in_list": w(f"{CAT}, {base.DRAWS}, {base.VERDICTS}", "SELECT appid, genre, price_cents FROM cat WHERE appid IN (SELECT appid FROM draws UNION SELECT appid FROM verdicts)"),
        "reviews_newest": w(base.VERDICTS, "SELECT user_id, appid, action, review_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reviewed_at DESC, review_id DESC, appid) AS k FROM verdicts) WHERE k <= 10"),
        "review_counts": f"SELECT user_id, status, count(*) AS n, count(*) FILTER (WHERE superseded) AS superseded FROM ({core['purge_standing']}) GROUP BY ALL",
        "snapshots_newest": w(base.SNAP, """SELECT user_id, count(*) AS days, min(total) AS low, max(total) AS high FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM totals)
            WHERE k <= 60 GROUP BY 1"""),
        "nested_history": w(f"{base.DRAWS}, per AS (SELECT user_id, k, any_value(appid) AS appid, any_value(drawn_at) AS drawn_at, string_agg(event, '>' ORDER BY created_at DESC, event_id DESC) AS events FROM draws GROUP BY 1, 2)",
            "SELECT user_id, k AS draw_no, appid, events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY drawn_at DESC, k DESC) AS r FROM per) WHERE r <= 50"),
        "vault_state": w(
            f"""{OWN}, {base.DRAWS}, slots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY added_at, appid) AS slot FROM own) WHERE slot <= 5),
            pins AS (SELECT user_id, string_agg(CAST(appid AS VARCHAR), ',' ORDER BY slot) AS pins FROM slots GROUP BY 1),
            asleep AS (SELECT user_id, count(*) AS snoozed, min(appid) AS first_snoozed FROM own WHERE appid % 6 = 0 AND (appid % 9 = 0 OR CAST(added_at AS DATE) + CAST(appid % 2500 AS INT) > DATE '2001-12-01') GROUP BY 1),
            chosen AS (SELECT user_id, arg_max(appid, (drawn_at, k)) AS pick FROM draws GROUP BY 1)""",
            "SELECT user_id, pins, coalesce(snoozed, 0) AS snoozed, first_snoozed, pick FROM (SELECT DISTINCT user_id FROM own) LEFT JOIN pins USING (user_id) LEFT JOIN asleep USING (user_id) LEFT JOIN chosen USING (user_id)"),
        "guest_pool": w(f"{CAT}, pop AS (SELECT *, CASE WHEN appid % 3 = 0 THEN appid % 50 END AS popularity FROM cat), top AS (SELECT * FROM pop ORDER BY {guest} LIMIT 300)",
            f"""SELECT 'guest-' || appid AS id, 'Not Started' AS status, CAST(CASE WHEN review_total > 0 THEN least(10, floor(review_positive * 10 / review_total + 0.5)) ELSE 0 END AS BIGINT) AS rating, genre || ' / ' || tag AS genre
            FROM top WHERE appid % 13 <> 0 ORDER BY {guest} LIMIT 250"""),
        "play_history": w(OWN, """SELECT user_id, count(*) AS games, bool_or(h > 0) AS playtime, bool_or(p IS NOT NULL) AS last_played, count(*) >= 25 AND NOT bool_or(h > 0 OR p IS NOT NULL) AS missing
            FROM (SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN hours ELSE 0 END AS h, CASE WHEN user_id % 6 <> 0 THEN last_played_at END AS p FROM own) GROUP BY 1"""),
        "completion_values": f"SELECT user_id, count(*) AS n, CAST(sum(price_cents) AS BIGINT) AS cents FROM ({core['completion_queue']}) JOIN (WITH {CAT} SELECT appid, price_cents FROM cat) USING (appid) GROUP BY 1",
        "completion_asked_again": f"""WITH q AS ({core['completion_queue']}), l AS (WITH {LIB} SELECT user_id, appid, hours, CASE WHEN appid % 2 = 0 THEN round(hours * CASE WHEN appid % 4 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE, 2) END AS seen FROM lib)
            SELECT user_id, appid, confidence FROM q JOIN l USING (user_id, appid) WHERE NOT coalesce(hours < seen + greatest(3.0::DOUBLE, 0.25::DOUBLE * seen), false)""",
        "milestones": w(
            f"""{OWN}, slots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY added_at, appid) AS slot FROM own) WHERE slot <= 5),
            pins AS (SELECT user_id, appid, CASE WHEN appid % 4 <> 0 THEN floor(hours / 2) END AS at_pin FROM slots),
            done AS (SELECT user_id, count(*) AS n, arg_max(appid, (completed_at, appid)) FILTER (WHERE completed_at IS NOT NULL) AS appid FROM own WHERE status = 'Completed' GROUP BY 1),
            m AS (SELECT d.user_id, d.appid, n, coalesce(o.hours - at_pin > 0.1, false) AS gained FROM done d JOIN own o ON o.user_id = d.user_id AND o.appid = d.appid LEFT JOIN pins p ON p.user_id = d.user_id AND p.appid = d.appid)""",
            """SELECT user_id, appid, CASE WHEN gained THEN 'You called it, and you finished it' WHEN n = 1 THEN 'First one down' WHEN n % 10 = 0 THEN n || ' games finished' WHEN n % 5 = 0 THEN n || ' down' ELSE 'Another one finished' END AS headline,
            CASE WHEN gained OR n = 1 OR n % 10 = 0 THEN 'big' ELSE 'standard' END AS spectacle FROM m"""),
        "collection_details": w(COLLECTIONS, """SELECT collection_id, appid, row_number() OVER (PARTITION BY collection_id ORDER BY position, created_at, appid) - 1 AS place FROM links JOIN lib USING (user_id, appid)
            UNION ALL SELECT collection_id, appid, position FROM smart"""),
        "collection_list": w(f"{COLLECTIONS}, n AS (SELECT collection_id, count(*) AS n FROM (SELECT collection_id FROM links UNION ALL SELECT collection_id FROM smart) GROUP BY 1)",
            "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, collection_id) AS rank, collection_id, coalesce(n, 0) AS game_count FROM shelves LEFT JOIN n USING (collection_id)"),
        "collection_index": w(COLLECTIONS, """SELECT user_id, appid, string_agg(CAST(collection_id AS VARCHAR), ',' ORDER BY collection_id) AS ids
            FROM (SELECT user_id, appid, collection_id FROM links UNION SELECT user_id, appid, collection_id FROM smart) GROUP BY 1, 2"""),
        "collection_page": w(f"{BOTH}, {LINKS}", "SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY position, created_at, appid) AS place, appid FROM links JOIN own USING (user_id, appid) WHERE appid % 13 <> 0"),
        "collection_search": w(f"{OWN}, {SHELVES}", " UNION ALL ".join(
            f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY kind <> 'system', name, collection_id) AS rank, collection_id FROM shelves WHERE contains(lower(name), '{t}')" for t in ("two", "vault"))),
        "collection_positions": w(f"{OWN}, {SHELVES}, {LINKS}", "SELECT collection_id, coalesce(max(position), -1) + 1 AS position FROM shelves LEFT JOIN links USING (collection_id) WHERE kind = 'custom' GROUP BY 1"),
        "collection_edits": w(f"{OWN}, {LINKS}", """SELECT collection_id, appid, CASE WHEN appid % 6 = 0 THEN 99 WHEN appid % 3 = 0 THEN position + 10 ELSE position END AS position FROM links
            WHERE (appid % 3 <> 0 OR appid % 6 = 0 OR appid % 2 <> 0) AND NOT (collection_id % 10 = 3 AND user_id % 5 = 0)"""),
        "stub_rows": w(f"{CAT}, {IMPORTED}, known AS (SELECT appid, title AS name, lower(title) AS normalized_name FROM cat WHERE appid % 2 = 0)",
            "SELECT * FROM known UNION ALL SELECT appid, title, lower(title) FROM latest_import WHERE appid NOT IN (SELECT appid FROM known)"),
        "quarantine": w(
            f"""{CAT}, {IMPORTED}, {MANUAL}, found AS (SELECT appid, 'steam_label:utilities' AS matched_rule FROM latest_import WHERE genre = 'Utilities / Action' AND appid NOT IN (SELECT appid FROM manual WHERE appid % 4 <> 0))""",
            "SELECT * FROM found UNION ALL SELECT appid, 'old' FROM cat WHERE appid % 10 = 0 AND appid NOT IN (SELECT appid FROM found)"),
        "decisions": w(f"{CAT}, {MANUAL}", "SELECT appid, CASE review_status WHEN 'allowed' THEN false WHEN 'excluded' THEN true ELSE appid % 3 = 0 END AS out FROM cat LEFT JOIN manual USING (appid)"),
        "status_changes": w(
            f"""{LIB}, c AS (SELECT *, CASE WHEN appid % 4 = 0 THEN ['Completed', 'Slept', 'In Progress'][CAST((appid + user_id) % 3 AS INT) + 1] ELSE status END AS now_status, CASE WHEN status = 'Slept' THEN added_at END AS slept_at FROM lib)""",
            f"""SELECT user_id, appid, now_status AS status, least(percent, CASE WHEN now_status = 'Completed' THEN 100 ELSE 99 END) AS percent,
            CASE WHEN now_status = 'Completed' THEN {day("coalesce(CAST(completed_at AS TIMESTAMP), TIMESTAMP '2001-11-30 12:00:00')")} END AS completed,
            CASE WHEN now_status = 'Slept' THEN {day("coalesce(CAST(slept_at AS TIMESTAMP), TIMESTAMP '2001-11-30 12:00:00')")} END AS slept FROM c"""),
        "shelf_restored": w(LIB, """SELECT user_id, appid, CASE WHEN status IN ('Completed', 'Slept') THEN CASE WHEN hours > 0 THEN 'In Progress' ELSE 'Not Started' END ELSE status END AS status, true AS cleared
            FROM lib WHERE appid % 3 = 0"""),
        "deleted_games": w(f"{OWN}, {LINKS}", """SELECT collection_id, count(*) AS n FROM links WHERE (user_id, appid) NOT IN (SELECT (user_id, appid) FROM own WHERE (user_id + appid) % 9 = 0) GROUP BY 1"""),
        "preferences_rebuilt": f"SELECT 2 AS stamp, count(*) AS n, round(sum(positive), 3) AS positive FROM ({core['preference_tally']})",
        "daily_snapshots": w(
            f"""{base.SNAP}, {OWN}, captured AS (SELECT user_id, DATE '2024-01-30' AS day, CAST(sum(greatest(0, floor(hours * 60 + 0.5))) AS BIGINT) AS total_minutes FROM own GROUP BY 1)""",
            """SELECT * FROM captured UNION ALL SELECT user_id, day, CAST(total AS BIGINT) FROM totals WHERE (user_id, day) NOT IN (SELECT (user_id, day) FROM captured)"""),
        "completion_claims": w(
            """steps AS (SELECT user_id, event_id % 3 AS appid, ts, event_id, CASE event_type WHEN 'error' THEN -1 ELSE 1 END AS step FROM events),
            sums AS (SELECT *, sum(step) OVER (PARTITION BY user_id, appid ORDER BY ts, event_id) AS s FROM steps),
            lows AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id, appid ORDER BY ts, event_id)) AS level FROM sums),
            keyed AS (SELECT *, CASE WHEN step = 1 THEN level ELSE level + 1 END AS open_level FROM lows),
            nexts AS (SELECT *, lead(step) OVER (PARTITION BY user_id, appid, open_level ORDER BY ts, event_id) AS following FROM keyed)""",
            "SELECT user_id, appid, event_id, coalesce(following = -1, false) AS undone FROM nexts WHERE step = 1"),
        "draw_log": w(
            f"""{base.DRAWS}, kept AS (SELECT user_id, k FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY drawn_at DESC, k DESC) AS r FROM (SELECT DISTINCT user_id, k, drawn_at FROM draws)) WHERE r <= 50)""",
            "SELECT user_id || '-' || k AS draw_id, event_id FROM draws d WHERE event_id % 2 = 0 OR EXISTS (SELECT 1 FROM kept WHERE kept.user_id = d.user_id AND kept.k = d.k)"),
        "estimates_due": """SELECT appid, provider, status, DATE '2001-12-01' + CASE WHEN status = 'matched' THEN 365 ELSE 150 END AS refresh_on
            FROM (SELECT l_partkey + 1 AS appid, l_returnflag AS provider, CASE WHEN l_quantity > 25 THEN 'matched' ELSE 'no_duration' END AS status,
            row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber DESC) AS k FROM lineitem) WHERE k = 1""",
        "duration_import": """SELECT CASE WHEN k % 11 = 0 THEN -k ELSE k + 1 END AS appid, CASE WHEN k % 11 = 0 THEN 'invalid id' WHEN k % 5 <> 0 AND k % 17 = 0 THEN 'negative minutes' WHEN k % 5 = 0 THEN 'no minutes'
            WHEN k % 4 = 3 THEN 'invalid confidence' WHEN k % 3 <> 0 THEN 'unknown game' ELSE 'updated' END AS outcome FROM (SELECT p_partkey AS k FROM part)""",
        "mapping_cohort": w(
            f"""{WHOLE_RANKS}, best AS (SELECT appid // 2 AS game_id, metric, min(rank) AS rank FROM ranks GROUP BY 1, 2), ids AS (SELECT DISTINCT p_partkey // 2 AS game_id, p_partkey // 3 + 1 AS appid FROM part),
            per_app AS (SELECT appid, metric, min(rank) AS rank FROM best JOIN ids USING (game_id) GROUP BY 1, 2),
            fused AS (SELECT appid, round(sum(CASE metric WHEN 'count' THEN 0.5 WHEN 'revenue' THEN 0.3 ELSE 0.2 END::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM per_app GROUP BY 1)""",
            "SELECT *, row_number() OVER (ORDER BY score DESC, best_rank, appid) AS rank FROM fused ORDER BY score DESC, best_rank, appid LIMIT 200"),
        "title_fallback": """WITH wanted AS (SELECT p_partkey + 1 AS appid, lower(p_name) || ' ' || p_partkey % 60 AS name, 2000 + p_partkey % 9 AS year FROM part WHERE p_partkey % 4 = 0),
            found AS (SELECT p_partkey AS game_id, lower(p_name) || 'tm ' || p_partkey % 60 AS name, CASE WHEN p_partkey % 5 <> 0 THEN 2000 + p_partkey % 10 END AS there FROM part WHERE p_partkey % 3 <> 0),
            hits AS (SELECT appid, count(DISTINCT game_id) AS n, min(game_id) AS game_id FROM wanted JOIN found USING (name) WHERE there IS NULL OR abs(there - year) <= 1 GROUP BY 1)
            SELECT appid, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN game_id END AS game_id FROM wanted LEFT JOIN hits USING (appid)""",
        "detail_payloads": """SELECT k, CASE WHEN k % 8 = 0 THEN 'unavailable' WHEN k % 9 = 0 THEN 'incomplete' END AS problem, 'game' AS type, CASE WHEN k % 9 <> 0 THEN p_name ELSE '' END AS title,
            CASE WHEN k % 4 = 0 THEN k * 10 END AS price_initial, CASE WHEN k % 4 = 0 AND k * 7 - 50 >= 0 THEN k * 7 - 50 END AS price_final, least(100, k % 140 + 1) AS discount, k % 6 = 0 AS is_free, k % 4 = 0 AS mac,
            'A, ' || p_brand AS developer, 'Action|' || p_type AS genres, '' AS categories, [DATE '2020-12-09', DATE '2021-12-19', DATE '2022-01-03', NULL][CAST(k % 4 AS INT) + 1] AS released
            FROM (SELECT p_partkey AS k, * FROM part)""",
        "small_payloads": """SELECT k, k % 50 AS total, k * 3 % 50 AS positive, greatest(0, k % 50 - k * 3 % 50) AS negative, CASE WHEN k % 50 > 0 THEN CAST(greatest(1, least(10, floor((k * 3 % 50) * 10 / (k % 50) + 0.5))) AS BIGINT) END AS rating,
            CASE WHEN k % 2 = 1 THEN k % 4 END AS grade, CASE WHEN k % 3 <> 0 THEN CAST(k AS VARCHAR) END AS steamid, CASE WHEN k % 4 <> 0 OR k = 0 THEN k % 7 END AS indie FROM (SELECT p_partkey AS k FROM part)""",
        "page_payloads": """WITH k AS (SELECT p_partkey AS k FROM part),
            owners AS (SELECT CASE WHEN k % 11 = 5 AND k >= 17 THEN k - 16 ELSE k + 1 END AS appid, (k // 10) * 10 + (9 - k % 10) + 1 AS rank FROM k WHERE k % 7 <> 3),
            once AS (SELECT appid, min(rank) AS rank FROM owners GROUP BY 1 ORDER BY 2 LIMIT 10000),
            games AS (SELECT k // 2 * 3 AS game_id, min(k) AS seen FROM k WHERE k > 1 GROUP BY 1)
            SELECT 'owners' AS metric, appid, rank FROM once UNION ALL SELECT 'peak', game_id, row_number() OVER (ORDER BY seen) FROM games""",
        "import_enriched": w(
            f"""{CAT}, {IMPORTED}, facts AS (SELECT appid, title AS name, genre AS cgenre, tag AS ctag, {spot(TAGS, len(TAG_SETS), 'appid')} AS tags, review_positive, review_total, price_cents FROM cat WHERE appid % 3 <> 0),
            e0 AS (SELECT i.appid, coalesce(f.name, i.title) AS title, i.genre, f.appid IS NOT NULL AS known, cgenre, ctag, tags, review_positive, review_total, price_cents FROM latest_import i LEFT JOIN facts f USING (appid)),
            votes AS (SELECT appid, unnest(map_entries(tags)) AS e FROM e0 WHERE known),
            voted AS (SELECT appid, list(trim(e.key) ORDER BY e.value DESC, e.key) AS every FROM votes WHERE e.value > 0 AND lower(trim(e.key)) <> 'co-op' GROUP BY 1),
            e1 AS (SELECT e0.*, CASE WHEN appid % 4 <> 0 THEN [cgenre, ctag] ELSE list_transform(({unique('every')})[1:6], lambda x: CASE WHEN lower(x) = 'rpg' THEN 'RPG' WHEN lower(x) = 'casual' THEN 'Casual' ELSE x END) END AS labels
              FROM e0 LEFT JOIN voted USING (appid)),
            e2 AS (SELECT * FROM e1 WHERE known), {tops('e2', 'et')}""",
            f"""SELECT appid, title, CASE WHEN genre NOT IN ('', 'Unknown') THEN genre ELSE array_to_string({unique("list_concat(tops, list_filter(labels, lambda x: NOT list_contains(['Casual', 'Action', 'Adventure', 'Strategy', 'RPG', 'Simulation', 'Sports', 'Racing', 'Software'], x)))")}, ' / ') END AS genre,
            CAST(CASE WHEN review_total > 0 THEN floor(review_positive * 10 / review_total + 0.5) ELSE 0 END AS BIGINT) AS rating, price_cents FROM et
            UNION ALL SELECT appid, title, genre, 0, NULL FROM e1 WHERE NOT known"""),
    }
