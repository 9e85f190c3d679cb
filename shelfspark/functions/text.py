"""Text column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkd(x: pd.Series) -> pd.Series:
    """Unicode NFKD, which Spark has no function for."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def clean_name(x: Column) -> Column:
    """NFC, trimmed, white-space runs as one blank."""
    return F.trim(F.regexp_replace(nfc(x), r"\s+", " "))


def words_key(x: Column) -> Column:
    """NFKD, lower case, runs of other than letters and digits as one blank (accents become blanks)."""
    return F.trim(F.regexp_replace(F.lower(nfkd(x)), r"[^a-z0-9]+", " "))


def ascii_words_key(x: Column) -> Column:
    """Lower case, runs of other than ASCII letters and digits as one blank; no decomposition."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "))


def folded_key(x: Column) -> Column:
    """NFKD, non-ASCII dropped (accents vanish), then as :func:`ascii_words_key`."""
    return ascii_words_key(F.regexp_replace(nfkd(x), r"[^\x00-\x7F]", ""))


def title_key(x: Column) -> Column:
    """As :func:`words_key` with trade marks removed first."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkd(x)), "[™®©]", ""), r"[^a-z0-9]+", " "))


def title_variants(x: Column) -> Column:
    """Distinct spellings: as given, without marks, without a year, without an edition suffix."""
    plain = F.trim(F.regexp_replace(x, "[™®©]", ""))
    no_year = F.trim(F.regexp_replace(plain, r"\s*\((?:19|20)[0-9]{2}\)\s*$", ""))
    edition = r"(?i)\s*[-:–]?\s*(?:game of the year|goty|definitive|deluxe|complete|enhanced|remastered|ultimate) edition\s*$"
    return F.filter(F.array_distinct(F.array(F.trim(x), plain, no_year, F.trim(F.regexp_replace(no_year, edition, "")))), lambda v: v != "")


def unique_ignoring_case(labels: Column) -> Column:
    """Distinct array elements by lower case, first casing and order kept."""
    return F.aggregate(
        labels,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def split_genres(x: Column) -> Column:
    """Genre labels of a text parted by / , ; or |, without blanks, unknowns and repeats."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), r"[/,;|]"), lambda p: F.trim(p))
    return unique_ignoring_case(F.filter(parts, lambda p: (p != "") & (F.lower(p) != "unknown")))


def genre_key(x: Column) -> Column:
    """Lower case with hyphens for blanks and underscores; the usual aliases."""
    key = F.regexp_replace(F.lower(F.trim(x)), r"[_\s]+", "-")
    return F.when(key.isin("sci-fi", "sci--fi", "science-fiction"), "sci-fi").when(key.isin("role-playing", "role-playing-game", "rpg"), "rpg").otherwise(key)


def mood_tag(x: Column) -> Column:
    """Lower case, underscores and hyphens as blanks, one blank between words."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[_-]+", " "), r"\s+", " ")


def owner_bounds(x: Column) -> Column:
    """Both numbers of "low .. high"."""
    found = F.transform(F.regexp_extract_all(F.regexp_replace(x, ",", ""), F.lit(r"([0-9]+)"), F.lit(1)), lambda v: v.try_cast("long"))
    return F.struct(F.try_element_at(found, F.lit(1)).alias("low"), F.try_element_at(found, F.lit(2)).alias("high"))


def redact(x: Column) -> Column:
    """Hide bearer tokens and client secrets; 500 characters at most."""
    hidden = F.regexp_replace(x, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
    return F.substring(F.regexp_replace(hidden, r"(?i)(client_secret=)[^&\s]+", "$1[redacted]"), 1, 500)


def content_hash(*parts: Column) -> Column:
    """SHA-256 of unit-separated parts."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def user_notes(x: Column) -> Column:
    """Trimmed notes; those that an import has written become empty."""
    notes = F.trim(F.coalesce(x, F.lit("")))
    return F.when(notes.rlike(r"(?i)^(Imported from Steam account|Added from Steam search)\. AppID: \d+$"), "").otherwise(notes)
