"""Collections of games: custom ones by membership, smart ones by rule, and edits of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import EDITED_AS
from .stats import smart_members


def smart_links(collections: DataFrame, library: DataFrame, presets: tuple[str, ...], now: Column) -> DataFrame:
    """Members of smart collections with their 0-based ``position`` in title order."""
    rules = collections.filter("kind = 'smart'").select("user_id", "collection_id", "preset")
    members = smart_members(library, presets, now).join(rules, ["user_id", "preset"])
    titled = members.join(library.select("user_id", "appid", "title"), ["user_id", "appid"])
    order = Window.partitionBy("collection_id").orderBy("title", "appid")
    return titled.select("collection_id", "user_id", "appid", (F.row_number().over(order) - 1).alias("position"))


def custom_links(links: DataFrame, library: DataFrame) -> DataFrame:
    """Members of custom collections that are in the library, in the order of position and time of joining; adds ``place``."""
    order = Window.partitionBy("collection_id").orderBy("position", "created_at", "appid")
    kept = links.join(library.select("user_id", "appid", "title"), ["user_id", "appid"])
    return kept.withColumn("place", F.row_number().over(order))


def counted(collections: DataFrame, links: DataFrame, smart: DataFrame) -> DataFrame:
    """Collections of each user, the latest change first, with their number of games; ``rank`` is the place in this list."""
    per = links.groupBy("collection_id").count().unionByName(smart.groupBy("collection_id").count())
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "collection_id")
    joined = collections.join(per, "collection_id", "left").withColumn("game_count", F.coalesce("count", F.lit(0)))
    return joined.withColumn("rank", F.row_number().over(order)).drop("count")


def collections_of_games(links: DataFrame, smart: DataFrame) -> DataFrame:
    """Ids of the collections of each game, custom or smart, each once."""
    both = links.select("user_id", "appid", "collection_id").unionByName(smart.select("user_id", "appid", "collection_id"))
    return both.groupBy("user_id", "appid").agg(F.array_sort(F.collect_set("collection_id")).alias("collection_ids"))


def search(collections: DataFrame, text: str) -> DataFrame:
    """Collections whose name holds a text in any casing; the system's own row comes first."""
    found = collections.filter(F.contains(F.lower("name"), F.lit(text.strip().lower())))
    order = Window.partitionBy("user_id").orderBy(F.col("kind") != "system", "name", "collection_id")
    return found.withColumn("rank", F.row_number().over(order))


def next_positions(collections: DataFrame, links: DataFrame) -> DataFrame:
    """Where the next game of each collection goes: one after the last, 0 in an empty one."""
    last = links.groupBy("collection_id").agg(F.max("position").alias("last"))
    return collections.select("collection_id").join(last, "collection_id", "left").select("collection_id", (F.coalesce("last", F.lit(-1)) + 1).alias("position"))


def edited_links(links: DataFrame, edits: DataFrame, turned_smart: DataFrame) -> DataFrame:
    """Memberships after edits (collection_id, appid, user_id, action, position, created_at, at): the last edit of a pair counts.

    Adding a member again moves it; a collection that becomes smart loses its memberships.
    """
    newest = Window.partitionBy("collection_id", "appid").orderBy(F.desc("at"))
    final = edits.withColumn("_k", F.row_number().over(newest)).filter("_k = 1").drop("_k")
    untouched = links.join(final, ["collection_id", "appid"], "left_anti")
    added = final.filter("action = 'add'").select(*links.columns)
    return untouched.unionByName(added).join(turned_smart, "collection_id", "left_anti")


def editable_preset(preset: Column) -> Column:
    """The preset that a smart collection is edited as: older ones have successors, none is nearly finished."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in EDITED_AS.items() for x in pair])[preset], preset, F.lit("nearly-finished"))
