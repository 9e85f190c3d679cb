"""Changes of stored tables as DataFrame merges: the result is the table after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genres import normalised_labels, split_labels, tag_genres
from ..functions.numeric import half_up
from ..functions.text import split_genres, words_key
from .catalogue import exclusion


def last_of(df: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """The last row of each key."""
    own = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("_k", F.row_number().over(own)).filter("_k = 1").drop("_k")


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet are added, the others are left as they are."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of their key or are added."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def rebuild(table: DataFrame, rows: DataFrame, signals: DataFrame | None = None, sweep: bool = False) -> DataFrame:
    """A full rebuild: all of ``rows``, and nothing older stays.

    Without any ``signals`` (by default: ``rows``) the table is left alone, unless it is to be swept anyway.
    """
    if sweep:
        return rows.select(*table.columns)
    found = (rows if signals is None else signals).limit(1).select(F.lit(True).alias("_any"))
    kept = table.join(found, F.lit(True), "left_anti")
    return rows.select(*table.columns).unionByName(kept)


def merged_details(catalog: DataFrame, details: DataFrame, now: Column) -> DataFrame:
    """The catalogue after fetched details (at most one per ``appid``), in one full outer join.

    Fetched values replace stored ones column by column, but a known device grade stays; prices count in dollars only and are emptied else; negative
    reviews are what is left of the total; rows without details stay as they are.  A detail without a title fails the job.
    """
    title = F.trim(F.coalesce("title", F.lit("")))
    dollars = F.coalesce(F.col("price_currency") == "USD", F.lit(False))
    total, positive = (F.greatest(F.lit(0).cast("long"), F.coalesce(c, F.lit(0).cast("long"))) for c in ("review_total", "review_positive"))
    fresh = details.select(
        "appid", F.when(title != "", title).otherwise(F.raise_error(F.concat(F.lit("metadata without a title: "), F.col("appid").cast("string")))).alias("name"), words_key(title).alias("normalized_name"),
        F.coalesce("steam_type", F.lit("unknown")).alias("steam_type"), F.col("deck_compatibility").alias("deck_compatibility"), positive.alias("review_positive"),
        F.greatest(F.lit(0).cast("long"), total - positive).alias("review_negative"), F.when(dollars, "USD").alias("price_currency"), F.when(dollars, F.col("price_initial")).alias("price_initial"),
        F.when(dollars, F.col("price_final")).alias("price_final"), F.when(dollars, F.coalesce("discount_percent", F.lit(0).cast("long"))).otherwise(0).cast("long").alias("discount_percent"), now.alias("fetched_at"),
    )
    rest = [c for c in fresh.columns if c != "appid"]
    joined = catalog.select("appid", F.struct(*rest).alias("_old")).join(fresh.select("appid", F.struct(*rest).alias("_new")), "appid", "full_outer")
    of = lambda c: F.when(F.col("_new").isNull(), F.col("_old")[c]).otherwise(F.col("_new")[c])
    grade = F.coalesce(F.col("_old.deck_compatibility"), F.col("_new.deck_compatibility"))
    return joined.select("appid", *[(grade if c == "deck_compatibility" else of(c)).alias(c) for c in rest])


def import_games(imported: DataFrame, catalog: DataFrame, decisions: DataFrame, held: DataFrame, library: DataFrame) -> dict[str, DataFrame]:
    """The tables after users' imports (``user_id``, ``appid``, ``at``, ``title``, ``genre``, ``rating``, ``hours``).

    ``last``: the last row of each user and game, from one shuffle of the import; ``catalog``: with stubs for unknown games; ``games``: what the
    catalogue knows better; ``quarantine``: ``held`` with what a rule excludes and nobody has decided on; ``library``: upserted by user and
    game, owned, with the hours of the import and the stored status (new games are in progress if played).  Excluded games stay in the library, as
    their owners have them.  ``last`` is read several times: write it first where that matters.
    """
    valid = imported.filter((F.col("appid") > 0) & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    last = last_of(valid, ["user_id", "appid"], F.desc("at"))
    fresh = stubs(last.select("appid", "title", "at")).select("appid", "name", "normalized_name")
    known = insert_absent(catalog.select("appid", "name", "normalized_name"), fresh, ["appid"])
    facts = catalog.select("appid", "name", "genres", "tags", "review_positive", "review_total", "price_cents")
    games = enriched(last.withColumn("price_cents", F.lit(None).cast("long")), facts)
    excluded = detected(games.select("appid", "title", "genre"), decisions).groupBy("appid").agg(F.min("matched_rule").alias("matched_rule"))
    quarantine = upsert(held, excluded, ["appid"])
    played = F.when(F.col("hours") > 0, "In Progress").otherwise("Not Started")
    stored = library.select("user_id", "appid", F.col("status").alias("_status"), F.col("hours").alias("_hours"), F.lit(True).alias("_held"))
    rows = games.join(stored, ["user_id", "appid"], "full_outer")
    merged = rows.select("user_id", "appid", "title", "genre", "rating", "price_cents", F.coalesce("hours", "_hours").alias("hours"), F.coalesce("_status", played).alias("status"), F.coalesce("_held", F.lit(False)).alias("known_before"))
    return {"last": last, "catalog": known, "games": games, "quarantine": quarantine, "library": merged}


def stubs(games: DataFrame) -> DataFrame:
    """Catalogue rows that hold just an id and a name until they are fetched: valid ids and names, the last row of an id (by ``at``)."""
    name = F.trim(F.coalesce("title", F.lit("")))
    valid = games.filter((F.col("appid") > 0) & (name != "")).withColumn("title", name)
    last = last_of(valid, ["appid"], F.desc("at"))
    never = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return last.select("appid", F.col("title").alias("name"), words_key(F.col("title")).alias("normalized_name"), never.alias("fetched_at"))


def enriched(games: DataFrame, catalog: DataFrame) -> DataFrame:
    """Games (title, genre, rating) with what the catalogue (name, genres, tags, review_positive, review_total, price_cents) knows better.

    The name wins; the genre only where it is unknown; the rating only above 0; the price always.
    """
    facts = catalog.select("appid", "name", "genres", "tags", "review_positive", "review_total", F.col("price_cents").alias("_price"), F.lit(True).alias("_known"))
    joined = games.drop("price_cents").join(facts, "appid", "left")
    title = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("title"))
    own = split_genres(F.array_join("genres", ", "))
    tagged = tag_genres(F.col("tags"))
    genre = F.when(F.size(own) > 0, normalised_labels(own, title)).when(F.size(tagged) > 0, normalised_labels(tagged, title))
    unknown = F.coalesce("genre", F.lit("")).isin("", "Unknown")
    rating = F.when(F.col("review_total") > 0, half_up(F.col("review_positive") * 10 / F.col("review_total")))
    return joined.select(
        *[c for c in games.columns if c not in ("title", "genre", "rating", "price_cents")], title.alias("title"),
        F.when(unknown, F.coalesce(genre, F.col("genre"))).otherwise(F.col("genre")).alias("genre"),
        F.when(rating > 0, rating).otherwise(F.col("rating")).cast("long").alias("rating"), F.col("_price").alias("price_cents"),
    )


def detected(games: DataFrame, decisions: DataFrame) -> DataFrame:
    """Games that a rule excludes and that nobody has decided on: (appid, name, matched_rule)."""
    rule = exclusion(split_labels(F.col("genre")), F.col("title"))
    found = games.filter(F.col("appid") > 0).select("appid", F.col("title").alias("name"), rule.alias("matched_rule")).filter("matched_rule is not null")
    return found.join(decisions.select("appid"), "appid", "left_anti")


def decided(rule: Column, review_status: Column) -> Column:
    """Whether an entry stays out: a manual decision before the rule."""
    return F.when(review_status == "allowed", False).when(review_status == "excluded", True).otherwise(rule.isNotNull())


def classified(rule: Column, review_status: Column, note: Column, noted_rule: Column) -> Column:
    """As a struct whether an entry stays ``out``, the ``reason`` and the ``matched_rule``: a manual decision (its note and rule, where it has them) before the rule."""
    by_rule = (
        F.when(rule.startswith("steam_type:"), F.concat(F.lit("Steam classifies this AppID as "), F.substring_index(rule, ":", -1), F.lit(", not a game.")))
        .when(rule.startswith("steam_label:"), F.concat(F.lit("Steam classified this AppID as "), F.substring_index(rule, ":", -1), F.lit(", not a game.")))
        .when(rule.isNotNull(), "The Steam title identifies this AppID as a beta, PTR, playtest, or other test environment.")
    )
    given = lambda x, other: F.coalesce(F.when(x != "", x), F.lit(other))
    reason = F.when(review_status == "allowed", F.lit(None)).when(review_status == "excluded", given(note, "This AppID was manually excluded from the game catalogue.")).otherwise(by_rule)
    matched = F.when(review_status == "allowed", "manual:allowed").when(review_status == "excluded", given(noted_rule, "manual:excluded")).otherwise(rule)
    return F.struct(decided(rule, review_status).alias("out"), reason.alias("reason"), matched.alias("matched_rule"))


def with_status(df: DataFrame, status: Column, now: Column) -> DataFrame:
    """Games with a new status: completion and sleep keep or get their time, any other status clears both; progress is bounded."""
    done, slept = status == "Completed", status == "Slept"
    top = F.when(done, 100).otherwise(99)
    return df.withColumns(
        {
            "completed_at": F.when(done, F.coalesce("completed_at", now)), "slept_at": F.when(slept, F.coalesce("slept_at", now)),
            "percent": F.least(F.greatest(F.lit(0), half_up(F.col("percent")).cast("long")), top), "status": status,
        }
    )


def restored(df: DataFrame) -> DataFrame:
    """Completed and sleeping games back on the shelf: in progress if they were played."""
    away = F.col("status").isin("Completed", "Slept")
    status = F.when(away, F.when(F.col("hours") > 0, "In Progress").otherwise("Not Started")).otherwise(F.col("status"))
    clear = lambda c: F.when(~away, F.col(c))
    return df.withColumns({"completed_at": clear("completed_at"), "slept_at": clear("slept_at"), "status": status})


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """A table without the keys of ``gone``; links to a deleted row go the same way."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def undone(claims: DataFrame, undos: DataFrame) -> DataFrame:
    """Claims (user_id, appid, at, event_id) with ``undone``: each undo (user_id, appid, at) marks the latest claim before it not yet undone.

    Claims and undos of a game form a bracket sequence: a claim is undone when the number of open claims falls back to what it was before it.
    """
    own = Window.partitionBy("user_id", "appid").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = claims.select("user_id", "appid", "at", "event_id", F.lit(1).alias("step")).unionByName(undos.select("user_id", "appid", "at", "event_id", F.lit(-1).alias("step")))
    # an undo without an open claim marks nothing: levels count from the lowest one so far
    leveled = rows.withColumn("_sum", F.sum("step").over(own))
    leveled = leveled.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(own))).withColumn("level", F.col("_sum") - F.col("_low"))
    # a claim opens level L; the next undo that leaves level L - 1 closes it, if no claim of this level comes first
    key = F.when(F.col("step") == 1, F.col("level")).otherwise(F.col("level") + 1)
    after = Window.partitionBy("user_id", "appid", "_key").orderBy("at", "event_id")
    marked = leveled.withColumn("_key", key).withColumn("_next", F.lead("step").over(after))
    return marked.filter("step = 1").select("user_id", "appid", "at", "event_id", F.coalesce(F.col("_next") == -1, F.lit(False)).alias("undone"))


def append_known(log: DataFrame, rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """A log with the rows whose parent exists."""
    return log.unionByName(rows.join(parents.select(key).distinct(), key, "left_semi").select(*log.columns))


def newest_per(df: DataFrame, key: str, k: int, *newest: Column) -> DataFrame:
    """The newest k rows of each key."""
    own = Window.partitionBy(key).orderBy(*newest)
    return df.withColumn("_k", F.row_number().over(own)).filter(F.col("_k") <= k).drop("_k")


def duration_rows(found: DataFrame, now: Column) -> DataFrame:
    """Estimates per game and provider with the day of the next look: a year on if matched, else 150 days."""
    wait = F.when(F.col("status") == "matched", 365).otherwise(150)
    return last_of(found, ["appid", "provider"], F.desc("at")).withColumn("refresh_on", F.date_add(F.to_date(now), wait))


def import_problem(df_appid: Column, minutes: list[Column], confidence: Column) -> Column:
    """Why a row of a duration file is refused, else null."""
    amounts = F.filter(F.array(*minutes), lambda m: m.isNotNull())
    return (
        F.when(df_appid.isNull() | (df_appid <= 0), "invalid id").when(F.exists(amounts, lambda m: m < 0), "negative minutes")
        .when(F.size(amounts) == 0, "no minutes").when(~confidence.isin("high", "medium", "low"), "invalid confidence")
    )
