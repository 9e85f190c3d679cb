"""Genre canon: top-level genres, cleaned and displayed labels, tag maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import GENERIC_TAGS, STORE_FEATURES, TAGS_OF, TOP_LEVELS, WORDS_OF
from .text import unique_ignoring_case

STRINGS = "array<string>"


def label_key(x: Column) -> Column:
    """Lower case, trimmed, one blank between words."""
    return F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))


def known_tags() -> Column:
    return F.create_map(*[F.lit(x) for top, tags in TAGS_OF.items() for tag in tags for x in (tag, top)])


def inferred(text: Column) -> Column:
    """The first top level whose words occur, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for top, words in WORDS_OF.items():
        out = out.when(F.lower(text).rlike(words), top)
    return out


def top_levels(labels: Column, title: Column) -> Column:
    """Top-level genres of labels: exact ones (case counts), then mapped tags; else one guessed from title and labels."""
    known = known_tags()
    exact = F.filter(labels, lambda x: x.isin(*TOP_LEVELS))
    mapped = F.filter(F.transform(labels, lambda x: known[label_key(x)]), lambda x: x.isNotNull())
    both = F.array_distinct(F.concat(exact, mapped))
    guess = inferred(F.concat_ws(" ", title, F.array_join(labels, " ")))
    return F.when(F.size(both) > 0, both).when(guess.isNotNull(), F.array(guess)).otherwise(F.array().cast(STRINGS))


def clean_label(x: Column) -> Column:
    """One blank between words; top-level genres in their own casing."""
    plain = F.regexp_replace(F.trim(x), r"\s+", " ")
    casing = F.create_map(*[F.lit(v) for top in TOP_LEVELS for v in (top.lower(), top)])
    return F.coalesce(casing[F.lower(plain)], plain)


def normalised_labels(labels: Column, title: Column) -> Column:
    """Labels with the top levels first, parted by " / "; Unknown without any."""
    cleaned = unique_ignoring_case(F.filter(F.transform(labels, clean_label), lambda x: x != ""))
    rest = F.filter(cleaned, lambda x: ~x.isin(*TOP_LEVELS))
    ordered = unique_ignoring_case(F.concat(top_levels(cleaned, title), rest))
    return F.when(F.size(cleaned) == 0, "Unknown").otherwise(F.array_join(ordered, " / "))


def primary_genre(labels: Column, title: Column) -> Column:
    """The first top level, else the first label, else Unknown."""
    return F.coalesce(F.try_element_at(top_levels(labels, title), F.lit(1)), F.try_element_at(labels, F.lit(1)), F.lit("Unknown"))


def display_label(labels: Column, title: Column) -> Column:
    """The primary genre and a second label: one that is not too general, else any, else another top level."""
    tops = top_levels(labels, title)
    first = F.try_element_at(tops, F.lit(1))
    others = F.filter(labels, lambda x: x != first)
    telling = F.filter(others, lambda x: ~label_key(x).isin(*GENERIC_TAGS))
    second = F.coalesce(*[F.try_element_at(a, F.lit(1)) for a in (telling, others, F.filter(tops, lambda x: x != first))])
    alone = F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit("Unknown"))
    return F.when(first.isNull(), alone).when(second.isNull(), first).otherwise(F.concat_ws(" / ", first, second))


def matches_top_level(labels: Column, title: Column, genre: str) -> Column:
    return F.lit(True) if genre in ("Any genre", "All genres") else F.array_contains(top_levels(labels, title), genre)


def preference_genres(labels: Column, title: Column) -> Column:
    """Keys of the top levels, in which preferences are counted."""
    return F.transform(top_levels(labels, title), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"[_\s]+", "-"))


def display_key(x: Column, *upper: str) -> Column:
    """A hyphenated key as a title: each word capitalised; the keys of ``upper`` wholly."""
    shown = F.array_join(F.transform(F.split(x, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")
    out = F.when(x == "sci-fi", "Sci-Fi")
    for key in upper or ("rpg",):
        out = out.when(x == key, key.upper())
    return out.otherwise(shown)


def split_labels(x: Column) -> Column:
    """Lower-case labels of a text parted by / , or |."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "[/,|]"), lambda p: F.lower(F.trim(p))), lambda p: p != "")


def sane_tags(tags: Column, longest: int = 100) -> Column:
    """A tag map with clean keys of up to ``longest`` characters and whole weights of 0 or more."""
    entries = F.transform(F.map_entries(tags), lambda e: F.struct(F.regexp_replace(F.trim(e["key"]), r"\s+", " ").alias("key"), F.greatest(F.lit(0.0), F.floor(e["value"] + 0.5)).alias("value")))
    kept = F.filter(entries, lambda e: (e["key"] != "") & (F.length(e["key"]) <= longest) & e["value"].isNotNull() & ~F.isnan(e["value"]))
    # of keys that clean to the same one the last counts
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def positive_tags(tags: Column) -> Column:
    """A tag map with trimmed keys and weights above 0."""
    entries = F.transform(F.map_entries(tags), lambda e: F.struct(F.trim(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: (e["key"] != "") & (e["value"] > 0)))


def tag_names(tags: Column) -> Column:
    """Labels of a tag map by weight, then label; cleaned, each once whatever its casing; weights of 0 or less are out."""
    order = lambda x, y: (
        F.when(x["value"] > y["value"], -1).when(x["value"] < y["value"], 1).when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
    )
    entries = F.array_sort(F.filter(F.map_entries(tags), lambda e: (e["value"] > 0) & (F.trim(e["key"]) != "")), order)
    return unique_ignoring_case(F.transform(entries, lambda e: clean_label(e["key"])))


def tag_genres(tags: Column, limit: int = 6) -> Column:
    """The first ``limit`` labels of a tag map that are not features of the store."""
    return F.slice(F.filter(tag_names(tags), lambda x: ~label_key(x).isin(*STORE_FEATURES)), 1, limit)
