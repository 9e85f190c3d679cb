"""DuckDB SQL that gives the rows of the queries of genres, classification, decks, labels and learned taste."""

from __future__ import annotations

from ..functions.rules import (
    ENDLESS_GENRES, ENDLESS_SIGNALS, ENDLESS_TITLES, GENERIC_TAGS, HOURS_OF, LENGTHS, MOOD_RULES, MOODS, ONLINE_SERVICES, PERSISTENT_WORLDS, REPLAY_LOOPS,
    STORE_FEATURES, TAGS_OF, TOP_LEVELS, WORDS_OF,
)
from . import oracles as base
from .rule_queries import RAW_GENRES, TAG_SETS


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def texts(xs) -> str:
    return "[" + ", ".join(map(text, xs)) + "]"


def spot(values: str, n: int, k: str = "p_partkey") -> str:
    return f"({values})[CAST({k} % {n} AS INT) + 1]"


def key(x: str) -> str:
    return f"lower(regexp_replace(trim({x}), '\\s+', ' ', 'g'))"


def unique(xs: str) -> str:
    """First elements of a list by lower case, in order."""
    return f"list_filter({xs}, lambda x, i: list_position(list_transform({xs}, lambda y: lower(y)), lower(x)) = i)"


def has_any(xs: str, names) -> str:
    return f"list_has_any({xs}, {texts(names)})"


KNOWN = "MAP {" + ", ".join(f"{text(tag)}: {text(top)}" for top, tags in TAGS_OF.items() for tag in tags) + "}"
CASING = "MAP {" + ", ".join(f"{text(top.lower())}: {text(top)}" for top in TOP_LEVELS) + "}"
GUESS = "CASE " + " ".join(f"WHEN regexp_matches(words, {text(words)}) THEN {text(top)}" for top, words in WORDS_OF.items()) + " END"
SPLIT = "list_filter(list_transform(string_split_regex(raw, '[/,;|]'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'unknown')"
CLEAN = f"list_transform(labels, lambda x: coalesce(({CASING})[{key('x')}], regexp_replace(trim(x), '\\s+', ' ', 'g')))"


def tops(rows: str, name: str = "tops") -> str:
    """CTEs that add ``tops`` to rows with ``labels`` and ``title``."""
    return f"""{name}_0 AS (SELECT *, list_filter(labels, lambda x: list_contains({texts(TOP_LEVELS)}, x)) AS exact,
    list_filter(list_transform(labels, lambda x: ({KNOWN})[{key('x')}]), lambda x: x IS NOT NULL) AS mapped,
    lower(concat_ws(' ', title, array_to_string(labels, ' '))) AS words FROM {rows}),
{name}_1 AS (SELECT *, {unique('list_concat(exact, mapped)')} AS joined_tops, {GUESS} AS guess_top FROM {name}_0),
{name} AS (SELECT * EXCLUDE (exact, mapped, words, joined_tops, guess_top), CASE WHEN len(joined_tops) > 0 THEN joined_tops WHEN guess_top IS NOT NULL THEN [guess_top] ELSE []::VARCHAR[] END AS tops FROM {name}_1)"""


TAGS = "[" + ", ".join("MAP {" + ", ".join(f"{text(t)}: {w}::DOUBLE" for t, w in tags.items()) + "}" for tags in TAG_SETS) + "]"
MAPS = f"maps AS (SELECT p_partkey, {spot(TAGS, len(TAG_SETS))} AS tags FROM part)"
RANKED = f"""entries AS (SELECT p_partkey, unnest(map_entries(tags)) AS e FROM maps),
named AS (SELECT p_partkey, list(coalesce(({CASING})[{key('e.key')}], regexp_replace(trim(e.key), '\\s+', ' ', 'g')) ORDER BY e.value DESC, e.key) AS every FROM entries WHERE e.value > 0 GROUP BY 1),
names AS (SELECT p_partkey, {unique('every')} AS names FROM named)"""
SIGNALS = f"""sig0 AS (SELECT *, list_transform(map_keys(tags), lambda x: lower(trim(x))) AS tagged, list_max(list_filter(map_values(tags), lambda v: v > 0)) AS best,
    list_filter(list_transform(string_split_regex(genre, '[/,|]'), lambda x: lower(trim(x))), lambda x: x <> '') AS parts FROM classified),
sig1 AS (SELECT *, list_transform(list_filter(map_entries(tags), lambda e: e.value >= 0.65 * best), lambda e: lower(trim(e.key))) AS dominant,
    list_concat(list_concat(tagged, parts), list_transform(categories, lambda x: lower(x))) AS signs, list_contains(tagged, 'story rich') AND NOT {has_any('tagged', PERSISTENT_WORLDS)} AS story_driven FROM sig0),
sig AS (SELECT *, NOT story_driven AND ({has_any('dominant', ENDLESS_SIGNALS)} OR ({has_any('signs', ONLINE_SERVICES)} AND {has_any('signs', REPLAY_LOOPS)})) AS replay FROM sig1)"""
CLASSIFIED = f"""c0 AS (SELECT p_partkey + 1 AS appid, concat_ws(' ', p_name, CASE WHEN p_partkey % 37 = 0 THEN 'Factorio' END) AS title, {spot(texts(RAW_GENRES), len(RAW_GENRES))} AS genre,
    {spot("[NULL, 'unknown', 'finite', 'endless', NULL]", 5)} AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_size * 10 END AS story,
    CASE WHEN p_partkey % 2 = 0 THEN p_size * CASE WHEN p_partkey % 4 = 0 THEN 300 ELSE 30 END END AS completion, {spot(TAGS, len(TAG_SETS))} AS tags,
    [{spot("['Survival', 'Puzzle', 'MMO']", 3)}] AS categories, p_size / 3 AS hours, {spot("['Completed', 'Slept', 'In Progress', 'Not Started']", 4)} AS status,
    CASE WHEN p_partkey % 7 = 1 THEN (p_partkey % 130)::DOUBLE END AS stored FROM part),
c1 AS (SELECT *, list_filter([story, completion], lambda x: x > 0) AS known FROM c0),
c2 AS (SELECT * EXCLUDE (known), CASE WHEN len(known) > 0 THEN greatest(60, floor(list_avg(known) / 60 + 0.5) * 60) END AS estimate,
    CASE WHEN coalesce(completion, 0) = 0 THEN false WHEN coalesce(story, 0) > 0 THEN completion >= 12 * story ELSE completion > 12000 END AS shape FROM c1),
classified AS (SELECT *, CASE WHEN kind = 'endless' THEN true WHEN kind IN ('finite', 'not-applicable') THEN false WHEN shape THEN true WHEN estimate IS NOT NULL THEN false
    ELSE regexp_matches(lower(title || ' ' || genre), {text(ENDLESS_TITLES)}) OR regexp_matches(lower(title || ' ' || genre), {text(ENDLESS_GENRES)}) END AS endless FROM c2)"""
HOURS = "CASE WHEN estimate IS NOT NULL THEN estimate / 60 WHEN endless THEN 0.0 " + " ".join(f"WHEN regexp_matches(lower(title || ' ' || genre), {text(w)}) THEN {h}.0" for w, h in HOURS_OF.items()) + " ELSE 20.0 END"
LENGTH = "CASE WHEN endless THEN 'Endless' WHEN guess < 5 THEN 'Bitesize' " + " ".join(f"WHEN guess <= {h} THEN '{n}'" for h, n in LENGTHS) + " ELSE 'Odyssey' END"


def fit(ratio: str, *names: str) -> str:
    return f"CASE WHEN {ratio} >= 0.93 THEN {text(names[0])} WHEN {ratio} >= 0.8 THEN {text(names[1])} ELSE {text(names[2])} END"


PAUSE_DAYS = f"floor((epoch_us({base.NOW}) - epoch_us(last_played_at)) / 86400000000)"
PAUSED = f"""CASE WHEN {PAUSE_DAYS} IS NULL OR {PAUSE_DAYS} < 21 THEN NULL WHEN {PAUSE_DAYS} >= 365 THEN 'Untouched for over a year'
    WHEN {PAUSE_DAYS} >= 60 THEN 'Not played in ' || CAST(floor({PAUSE_DAYS} / 30 + 0.5) AS BIGINT) || ' months' ELSE 'Not played in ' || CAST({PAUSE_DAYS} AS BIGINT) || ' days' END"""
PAUSED_LONG = f"CASE WHEN {PAUSE_DAYS} >= 730 THEN 'Untouched for ' || CAST(floor({PAUSE_DAYS} / 365) AS BIGINT) || ' years' ELSE {PAUSED} END"
LIKED = "CASE kind WHEN 'phenomenon' THEN 'Everyone has played this' WHEN 'acclaimed' THEN 'Widely loved' WHEN 'hidden-gem' THEN 'Hidden gem' WHEN 'divisive' THEN 'Divisive' END"
EVENING = f"({base.EVENING}) / 30.0::DOUBLE"
SHARED = "list_filter(['Action', 'RPG', 'Strategy'], lambda g: genre = g)"
ORDINAL = lambda n: f"{n} || CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END"
MONEY = lambda c: f"CASE WHEN {c} >= 10000 THEN format('${{:,}}', CAST(floor({c} / 100 + 0.5) AS BIGINT)) ELSE format('${{:.2f}}', {c} / 100) END"
COUNT = lambda n: f"""CASE WHEN {n} >= 1000000 THEN format('{{:.1f}}M', {n} / 1000000) WHEN {n} >= 10000 THEN CAST(floor({n} / 1000 + 0.5) AS BIGINT) || 'k'
    WHEN {n} >= 1000 THEN format('{{:.1f}}k', {n} / 1000) ELSE CAST({n} AS VARCHAR) END"""  # noqa: E731
HOUR_LABEL = lambda h: f"CASE WHEN {h} >= 1000 THEN format('{{:.1f}}k', {h} / 1000) ELSE CAST(CAST(floor({h} + 0.5) AS BIGINT) AS VARCHAR) END"


def taste() -> str:
    """CTEs ``taste``: points and reason per user and game."""
    sums = lambda c, a: ", ".join(f"sum({v}) FILTER (WHERE context = '{c}' AND total > 0) AS {a}_{v[0]}" for v in ("positive", "total"))
    z, logit = (lambda c: f"coalesce({c}, 0)"), base._logit
    return f"""pop AS (SELECT context, genre, round(sum(positive), 4) AS positive, round(sum(total), 4) AS total FROM tally GROUP BY ALL),
tg AS (SELECT user_id, genre, {sums("any", "ga")}, {sums("intense", "gm")} FROM tally WHERE genre <> '__baseline__' GROUP BY ALL),
tb AS (SELECT user_id, {sums("any", "ba")}, {sums("intense", "bm")} FROM tally WHERE genre = '__baseline__' GROUP BY ALL),
tp AS (SELECT genre, {sums("any", "pa")} FROM pop WHERE genre <> '__baseline__' GROUP BY ALL),
tq AS (SELECT sum(positive) AS qp, sum(total) AS qt FROM pop WHERE genre = '__baseline__' AND context = 'any'),
owned_labels AS (SELECT user_id, appid, title, [genre, tag] AS labels FROM lib),
{tops("owned_labels", "owned_tops")},
game_genres AS (SELECT user_id, appid, unnest(tops) AS top, generate_subscripts(tops, 1) AS pos FROM owned_tops),
keyed AS (SELECT user_id, appid, pos, replace(lower(top), ' ', '-') AS genre FROM game_genres),
spread AS (SELECT user_id, genre, ln(1 + n / count(*)) AS x FROM keyed JOIN (SELECT user_id, count(*) AS n FROM lib GROUP BY 1) USING (user_id) GROUP BY user_id, genre, n),
rarity AS (SELECT user_id, genre, x / avg(x) OVER (PARTITION BY user_id) AS weight FROM spread),
t1 AS (SELECT *, ({z("qp")} + 4) / ({z("qt")} + 8) AS lvl FROM rarity LEFT JOIN tg USING (user_id, genre) LEFT JOIN tb USING (user_id) LEFT JOIN tp USING (genre), tq),
t2 AS (SELECT *, ({z("ba_p")} + 8 * lvl) / ({z("ba_t")} + 8) AS oa, ({z("pa_p")} + 4 * lvl) / ({z("pa_t")} + 4) AS pg FROM t1),
t3 AS (SELECT *, ({z("bm_p")} + 8 * oa) / ({z("bm_t")} + 8) AS o FROM t2),
t4 AS (SELECT *, 1 / (1 + exp(-({logit("o")} + {logit("pg")} - {logit("lvl")}))) AS prior FROM t3),
t5 AS (SELECT *, ({z("gm_p")} + 8 * (({z("ga_p")} + 8 * prior) / ({z("ga_t")} + 8))) / ({z("gm_t")} + 8) AS rate FROM t4 WHERE ga_t IS NOT NULL OR gm_t IS NOT NULL OR pa_t IS NOT NULL),
t6 AS (SELECT user_id, genre, weight, gm_t IS NOT NULL AS moody, 8 * tanh(({logit("rate")} - {logit("o")}) / 3) AS p FROM t5),
t7 AS (SELECT k.user_id, k.appid, sum(p * weight) / sum(weight) AS points, arg_max(genre, (round(abs(p), 9), -pos)) AS top, arg_max(moody, (round(abs(p), 9), -pos)) AS moody
  FROM keyed k JOIN t6 USING (user_id, genre) GROUP BY ALL),
taste AS (SELECT l.user_id, l.appid, coalesce(points, 0) AS points, CASE WHEN points >= 2.5 THEN CASE WHEN top = 'rpg' THEN 'RPG' ELSE upper(top[1]) || top[2:] END || ' lands well for you'
  || CASE WHEN moody THEN ' when Intense' ELSE '' END END AS reason FROM lib l LEFT JOIN t7 USING (user_id, appid))"""


def contributors(mood: str) -> str:
    k = MOODS.index(mood)
    rules = "MAP {" + ", ".join(f"{text(t)}: {r[k]}" for t, r in MOOD_RULES.items() if r[k] > 0) + "}"
    pairs = f"list_filter([{{'w': coalesce(({rules})[lower(genre)], 0), 'i': 0, 'l': genre}}, {{'w': coalesce(({rules})[lower(replace(tag, '_', ' '))], 0), 'i': -1, 'l': tag}}], lambda e: e.w > 0)"
    return f"array_to_string(list_transform(list_reverse_sort({pairs}), lambda e: e.l), '|') AS {mood.replace('-', '_')}"


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, select: f"WITH {ctes} {select}"
    deck, lib, soft = base.pool("new"), base.LIB, base.SOFT
    raw = f"raws AS (SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_partkey % 5 = 0 THEN 'Rally' END) AS title, {spot(texts(RAW_GENRES), len(RAW_GENRES))} AS raw FROM part)"
    other = "list_filter(labels, lambda x: x <> tops[1])"
    telling = f"list_filter(labels, lambda x: x <> tops[1] AND NOT list_contains({texts(GENERIC_TAGS)}, {key('x')}))"
    mood_score = "CASE WHEN intense >= 7 THEN 'Perfect' WHEN intense >= 5 THEN 'Strong' ELSE '{}' END"
    return {
        "top_level_genres": w(
            f"""{raw}, split AS (SELECT *, {SPLIT} AS every FROM raws), labelled AS (SELECT p_partkey, title, raw, {unique('every')} AS labels FROM split), {tops('labelled')},
            cleaned AS (SELECT *, {unique(f"list_filter({CLEAN}, lambda x: x <> '')")} AS cleaned FROM tops)""",
            f"""SELECT p_partkey, array_to_string(tops, '|') AS tops,
              CASE WHEN len(cleaned) = 0 THEN 'Unknown' ELSE array_to_string({unique(f"list_concat(tops, list_filter(cleaned, lambda x: NOT list_contains({texts(TOP_LEVELS)}, x)))")}, ' / ') END AS stored,
              CASE WHEN len(tops) = 0 THEN coalesce(labels[1], 'Unknown') ELSE concat_ws(' / ', tops[1], coalesce(({telling})[1], ({other})[1], tops[2])) END AS shown,
              coalesce(tops[1], labels[1], 'Unknown') AS first, array_to_string(list_transform(tops, lambda x: lower(x)), '|') AS keys, list_contains(tops, 'Casual') AS casual,
              array_to_string(list_filter(list_transform(string_split_regex(raw, '[/,|]'), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS parts FROM cleaned"""),
        "tag_maps": w(
            f"{MAPS}, {RANKED}",
            f"""SELECT p_partkey, array_to_string(names, '|') AS names, array_to_string((list_filter(names, lambda x: NOT list_contains({texts(STORE_FEATURES)}, {key('x')})))[1:2], '|') AS genres,
              array_to_string(list_sort(list_transform(map_entries(tags), lambda e: trim(e.key) || ':' || CAST(greatest(0, floor(e.value + 0.5)) AS BIGINT))), '|') AS sane,
              len(list_filter(map_values(tags), lambda v: v > 0)) AS positive, list_max(map_values(tags)) AS top_vote,
              array_to_string(list_sort(list_transform(list_filter(map_entries(tags), lambda e: e.value >= 0.65 * list_max(map_values(tags))), lambda e: lower(trim(e.key)))), '|') AS dominant
            FROM maps JOIN names USING (p_partkey)"""),
        "endless_rule": w(f"{CLASSIFIED}, {SIGNALS}", """SELECT appid, endless, shape, story_driven, replay,
            coalesce(kind, 'unknown') = 'unknown' AND coalesce(story, 0) <= 0 AND coalesce(completion, 0) <= 0 AND replay AS mark FROM sig"""),
        "progress_guess": w(
            f"""{CLASSIFIED}, g AS (SELECT *, {HOURS} AS guess FROM classified),
            p AS (SELECT *, CAST(CASE WHEN status = 'Completed' THEN 100 WHEN endless THEN 99 WHEN estimate IS NOT NULL THEN CASE WHEN hours <= 0 THEN 0 ELSE least(99, floor(hours * 100 / (estimate / 60) + 0.5)) END
              WHEN coalesce(stored, 0) > 0 THEN least(99, floor(stored + 0.5)) WHEN hours = 0 OR guess = 0 THEN 0 WHEN hours >= guess THEN 99 ELSE least(99, floor(hours * 100 / guess + 0.5)) END AS BIGINT) AS percent FROM g)""",
            f"""SELECT appid, guess, percent, CASE WHEN percent > 10 THEN 'In Progress' WHEN percent > 0 THEN 'Sampled' WHEN endless AND hours > 0 THEN 'In Progress' ELSE 'Not Started' END AS status,
            {LENGTH} AS length FROM p"""),
        "preference_adjustment": w(f"{base.TALLY}, {lib.removeprefix(base.CAT + ', ')}, {taste()}", "SELECT user_id, appid, round(points, 5) AS points, reason FROM taste"),
        "taste_pick": w(
            f"""{base.TALLY}, {soft.removeprefix(base.CAT + ', ')}, {taste()},
            valued AS (SELECT f.user_id, f.rank, f.appid, f.score + a.points + t.points AS v FROM finalists f JOIN appeals a USING (appid) JOIN taste t ON t.user_id = f.user_id AND t.appid = f.appid),
            tw AS (SELECT *, exp((v - max(v) OVER (PARTITION BY user_id)) / 15.0) AS tw FROM valued), tprob AS (SELECT *, tw / sum(tw) OVER (PARTITION BY user_id) AS pr FROM tw),
            tc AS (SELECT *, round(sum(pr) OVER (PARTITION BY user_id ORDER BY rank), 9) AS c FROM tprob)""",
            "SELECT user_id, rank, appid FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS k FROM tc WHERE c >= (user_id % 1000 + 0.5) / 1000) WHERE k = 1"),
        "deferred_deck": w(deck, """SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY appid % 4 = 0, CASE WHEN appid % 4 = 0 THEN -appid END, score DESC, title, appid) AS place, appid
            FROM scored) WHERE place <= 64"""),
        "deck_without_winner": w(
            f"""{deck}, sized AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS m FROM deck), lost AS (SELECT user_id, appid, rank FROM sized WHERE m = 1 OR rank <> CASE WHEN user_id % 2 = 0 THEN 3 ELSE 1 END),
            again AS (SELECT user_id, appid, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM lost)""",
            "SELECT user_id, rank, appid FROM again WHERE rank <= CASE WHEN n <= 5 THEN n ELSE least(20, greatest(3, ceil(0.4 * n))) END"),
        "match_reasons": w(f"{deck}, {base.APPEAL}", f"""SELECT user_id, rank, d.appid, CASE WHEN score >= 92 THEN 'Perfect match' WHEN score >= 82 THEN 'Excellent match' WHEN score >= 68 THEN 'Strong match'
              WHEN score >= 50 THEN 'Good match' ELSE 'Eligible pick' END AS label,
              array_to_string(list_filter([CASE WHEN endless THEN 'Endless · play any length' ELSE {fit(EVENING, 'Ideal evening session length', 'Good evening session length', 'Evening Session fit')} END,
                CASE WHEN intense >= 7 THEN 'Perfect Intense match' WHEN intense >= 5 THEN 'Strong Intense match' WHEN intense >= 3 THEN 'Solid Intense match' END,
                CASE WHEN hours = 0 THEN 'Unplayed' ELSE 'Barely sampled' END, {PAUSED}, CASE WHEN len({SHARED}) > 0 THEN array_to_string({SHARED}, ' · ') END, {LIKED}], lambda x: x IS NOT NULL)[1:4], '; ') AS why
            FROM deck d JOIN appeals USING (appid)"""),
        "match_insights": w(
            f"""{deck}, {base.APPEAL}, m AS (SELECT d.* EXCLUDE (fits), fits, kind, points, (SELECT count(*) FROM scored s WHERE s.user_id = d.user_id) AS n, {contributors('intense').replace(' AS intense', ' AS drivers')} FROM deck d JOIN appeals USING (appid)),
            i AS (SELECT user_id, appid, unnest(list_filter([
              CASE WHEN n > 1 THEN {{'kind': 'selection', 'strength': CASE WHEN rank <= 3 THEN 'perfect' WHEN rank <= 10 THEN 'strong' ELSE 'good' END,
                'headline': CASE WHEN rank = 1 THEN 'Best fit' ELSE 'Ranked ' || {ORDINAL('rank')} END || ' of ' || n || ' games'}} END,
              {{'kind': 'session', 'strength': {fit(EVENING, 'perfect', 'strong', 'good')}, 'headline': CASE WHEN endless THEN 'Plays to any length' ELSE {fit(EVENING, 'Ideal evening session length', 'Good evening session length', 'Workable evening session length')} END}},
              CASE WHEN intense >= 1 OR drivers <> '' THEN {{'kind': 'mood', 'strength': CASE WHEN intense >= 7 THEN 'perfect' WHEN intense >= 5 THEN 'strong' ELSE 'good' END, 'headline': {mood_score.format('Fair')} || ' Intense match'}} END,
              {{'kind': 'goal', 'strength': CASE WHEN hours = 0 THEN 'perfect' ELSE 'strong' END, 'headline': CASE WHEN hours = 0 THEN 'Never played' ELSE 'Barely sampled' END}},
              CASE WHEN {PAUSED_LONG} IS NOT NULL THEN {{'kind': 'dormancy', 'strength': 'strong', 'headline': {PAUSED_LONG}}} END,
              CASE WHEN len({SHARED}) > 0 THEN {{'kind': 'genre', 'strength': CASE WHEN len({SHARED}) = 3 THEN 'perfect' ELSE 'strong' END, 'headline': array_to_string({SHARED}, ' and ') || ', as asked'}} END,
              CASE WHEN kind <> 'none' THEN {{'kind': 'appeal', 'strength': CASE WHEN points >= 3 THEN 'perfect' WHEN points > 0 THEN 'strong' ELSE 'good' END, 'headline': {LIKED}}} END], lambda x: x IS NOT NULL)) AS i FROM m)""",
            "SELECT user_id, appid, i.kind, i.strength, i.headline FROM i"),
        "mood_labels": w(lib, "SELECT appid, array_to_string(list_filter([" + ", ".join(f"CASE WHEN m.{m.replace('-', '_')} >= 3 THEN '{m}' END" for m in MOODS)
            + "], lambda x: x IS NOT NULL), '|') AS moods, " + ", ".join(map(contributors, MOODS)) + " FROM cat JOIN moods m USING (genre, tag)"),
        "display_labels": w(lib, f"""SELECT user_id, appid, {PAUSED_LONG} AS paused,
              CASE WHEN {PAUSE_DAYS} >= 365 THEN CAST(floor({PAUSE_DAYS} / 365) AS BIGINT) || CASE WHEN floor({PAUSE_DAYS} / 365) = 1 THEN ' year' ELSE ' years' END
                WHEN {PAUSE_DAYS} >= 30 THEN CAST(floor({PAUSE_DAYS} / 30) AS BIGINT) || 'mo' ELSE CAST({PAUSE_DAYS} AS BIGINT) || 'd' END AS age,
              {COUNT('review_total')} AS reviews, {MONEY('price_cents')} AS price,
              CASE WHEN estimate IS NULL THEN 'Not available' WHEN estimate / 60 < 10 THEN regexp_replace(format('{{:.1f}}', estimate / 60), '\\.0$', '') || 'h' ELSE CAST(floor(estimate / 60 + 0.5) AS BIGINT) || 'h' END AS length,
              {HOUR_LABEL('(hours * 37)')} AS hours, {ORDINAL('appid')} AS nth, CASE WHEN review_total % 40 >= 25 THEN 'high' WHEN review_total % 40 >= 5 THEN 'medium' ELSE 'low' END AS trust,
              CASE WHEN review_total > 100 THEN CAST(floor((review_total - 100) / 60 + 0.5) AS BIGINT) END AS minutes, strftime(added_at, '%Y-%m-%d') AS day,
              CAST(floor((epoch_us({base.NOW}) - epoch_us(added_at)) / 86400000000) AS BIGINT) AS days FROM lib"""),
        "relative_ages": f"""SELECT p_partkey, round(CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN (p_partkey % 50)::DOUBLE WHEN 1 THEN (p_partkey % 9) * 7.0 WHEN 2 THEN (epoch_us({base.NOW}) - epoch_us(TIMESTAMP '1999-01-05')) / 86400000000
            WHEN 4 THEN 730.0 WHEN 5 THEN 0.25 WHEN 6 THEN 30.0 END, 6) AS days FROM part""",
        "clean_values": r"""SELECT p_partkey, (SELECT string_agg(upper(x[1]) || lower(x[2:]), ' ' ORDER BY i) FROM (SELECT unnest(string_split(p_name, ' ')) AS x, generate_subscripts(string_split(p_name, ' '), 1) AS i)) || ' é ' || p_type AS name,
            p_partkey * 1000 AS low, p_partkey * 2000 AS high, CASE WHEN p_partkey % 5 < 2 AND p_partkey > 0 THEN p_partkey END AS id, sha256(p_name || chr(31) || p_type) AS hash,
            'call Bearer [redacted] client_secret=[redacted]&n=1' AS hidden, least(360.0::DOUBLE, pow(2.0, p_partkey % 12)) AS backoff FROM part""",
    } | _derived()


def _derived() -> dict[str, str]:
    stats, recap = (base.oracle_sql()[q] for q in ("backlog_stats", "visit_recap"))
    minutes = "CASE WHEN minutes >= 60 THEN CASE WHEN minutes / 60 < 10 THEN regexp_replace(format('{:.1f}', minutes / 60), '\\.0$', '') ELSE CAST(CAST(floor(minutes / 60 + 0.5) AS BIGINT) AS VARCHAR) END || 'h played' ELSE minutes || ' minutes played' END"
    return {
        "share_cards": f"""SELECT user_id, {MONEY('completed_cents')} || ' of ' || {MONEY('library_cents')} || ' finished' AS headline, value_percent, completed_games || ' of ' || total_games AS games,
            {HOUR_LABEL('total_hours')} AS hours, unplayed_games FROM ({stats})""",
        "recap_lines": f"""SELECT user_id, concat_ws(' · ', CASE WHEN minutes >= 20 THEN {minutes} END, CASE WHEN games_finished > 0 THEN games_finished || CASE WHEN games_finished = 1 THEN ' game' ELSE ' games' END || ' finished' END) AS line
            FROM ({recap})""",
    }
