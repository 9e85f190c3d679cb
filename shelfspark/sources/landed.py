"""Landed files: line-delimited and whole JSON with their shape checked, consolidation of attempts, what is covered and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words_key

#: Results that no further attempt changes.
TERMINAL = ("ready", "non_game")


def read_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Line-delimited JSON of all files below ``folder`` with ``_file`` and ``_broken``, the line where it does not parse (its fields are null then).

    Blank lines are no rows.  Lines parse one by one, so files split over tasks.
    """
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("_file")).filter(F.trim("value") != "")
    fields = T.StructType.fromDDL(schema).add("_broken", "string")
    parsed = F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return lines.select(parsed.alias("r"), "_file").select("r.*", "_file")


def read_manifests(spark: SparkSession, pattern: str, array_field: str, item: str) -> DataFrame:
    """The items of ``array_field`` of whole-file JSON documents, with ``_file``; fails where a document has no such array.

    ``pattern`` may be a glob; the check is part of the plan, so a wrong file fails the job that reads it and no second pass is made.
    """
    whole = spark.read.text(pattern, wholetext=True).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_name").alias("_file"))
    listed = F.try_variant_get("v", f"$.{array_field}", "array<variant>")
    is_array = F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{array_field}", "variant")).startswith("ARRAY"), F.lit(False))
    sure = F.when(is_array, listed).otherwise(F.raise_error(F.concat("_file", F.lit(f" must contain a {array_field} array"))))
    rows = whole.select("_file", F.explode(sure).alias("x"))
    typed = F.from_json(F.to_json("x"), item)
    return rows.select("_file", typed.alias("r")).select("r.*", "_file")


def consolidated(attempts: DataFrame, *order: str) -> DataFrame:
    """One row per ``appid`` of attempts in ``order``: the last terminal one, else the last; with ``unavailable_attempts``.

    Rows without a positive id are left out.  One aggregation, combined before the shuffle.
    """
    rest = [c for c in attempts.columns if c != "appid"]
    rank = F.struct(F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)).alias("_terminal"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(order)])
    per = attempts.filter("appid > 0").groupBy("appid").agg(F.max_by(F.struct(*rest), rank).alias("last"), F.count_if(F.col("status") == "unavailable").alias("unavailable_attempts"))
    return per.select("appid", "last.*", "unavailable_attempts")


def covered(*results: DataFrame) -> DataFrame:
    """The ids (``appid``) that any of several results has ready."""
    ready = [r.filter("status = 'ready'").select("appid") for r in results]
    every = ready[0]
    for other in ready[1:]:
        every = every.unionByName(other)
    return every.distinct()


def misses(manifest: DataFrame, *results: DataFrame) -> DataFrame:
    """Rows of a manifest that no result covers."""
    return manifest.join(covered(*results), "appid", "left_anti")


def to_fetch(wanted: DataFrame, attempts: DataFrame) -> DataFrame:
    """What a run that starts again has still to do: all but the ids that earlier attempts ended with; failures are tried anew."""
    done = attempts.filter(F.col("status").isin(*TERMINAL) & (F.col("appid") > 0)).select("appid").distinct()
    return wanted.join(done, "appid", "left_anti")


def newest_source_date(df: DataFrame, column: str = "source_updated_at") -> DataFrame:
    """The newest date of a source; null for an empty table."""
    return df.agg(F.max(column).alias("newest"))


def search_titles(jobs: DataFrame, catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """What to search for each job (``appid``): an approved alias's title and year, else the catalogue's name and year of release."""
    names = catalog.select("appid", "name", F.year("release_date").alias("_year"))
    other = aliases.filter("review_status = 'approved'").select("appid", "search_title", "release_year", F.lit(True).alias("_alias"))
    joined = jobs.select("appid").join(names, "appid", "left").join(other, "appid", "left")
    pick = lambda a, b: F.when(F.col("_alias"), F.col(a)).otherwise(F.col(b))
    return joined.select("appid", pick("search_title", "name").alias("title"), pick("release_year", "_year").alias("release_year"))


def duration_report(rows: DataFrame, provider: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """Reports of a duration provider consolidated: the last matched row of each id in ``order``, and how many rows had which status.

    Minutes and ids that are no positive whole numbers are emptied; rows of other providers and without an id only count.
    """
    whole = lambda c: F.when((F.col(c) > 0) & (F.col(c) % 1 == 0), F.col(c).cast("long")).alias(c)
    status = F.when(F.col("match_status") == "matched", "matched").otherwise(F.coalesce("status", F.lit("unknown")))
    numbers = ["provider_game_id", "main_story_minutes", "main_extra_minutes", "completionist_minutes"]
    matched = rows.filter((F.col("match_status") == "matched") & (F.col("provider") == provider) & (F.col("appid") > 0))
    last = matched.groupBy("appid").agg(F.max_by(F.struct(*[whole(c) for c in numbers], "checked_at"), F.struct(*order)).alias("last"))
    return last.select("appid", "last.*"), rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def catalogue_rows(metadata: DataFrame, now) -> DataFrame:
    """Typed catalogue rows of ready metadata (texts as they came); a row without a positive id or a name fails the job.

    Blank texts become null, numbers that are no whole numbers of 0 or more too (reviews 0), discounts stay within 0 and 100, only dollars are kept as currency.
    """
    text = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    number = lambda c: F.when(F.trim(c).rlike(r"^\+?[0-9]{1,15}(\.0*)?$"), F.trim(c).try_cast("double").cast("long"))
    name, key = F.trim(F.coalesce("name", F.lit(""))), number("steam_appid")
    sure = F.when((key > 0) & (name != ""), key).otherwise(F.raise_error(F.lit("A ready metadata row has an invalid id or name.")))
    known = F.nullif(F.trim("normalized_name"), F.lit(""))
    return metadata.select(
        sure.alias("appid"), name.alias("name"), F.coalesce(known, F.nullif(words_key(name), F.lit("")), F.lower(name)).alias("normalized_name"), text("developer"), text("publisher"),
        number("deck_compatibility").alias("deck_compatibility"), F.coalesce(number("review_positive"), F.lit(0).cast("long")).alias("review_positive"), F.coalesce(number("review_negative"), F.lit(0).cast("long")).alias("review_negative"),
        F.when(F.upper(F.trim("price_currency")) == "USD", "USD").alias("price_currency"), number("price_initial").alias("price_initial"), number("price_final").alias("price_final"),
        F.least(F.coalesce(number("discount_percent"), F.lit(0).cast("long")), F.lit(100).cast("long")).alias("discount_percent"), F.coalesce(F.nullif(F.trim("metadata_fetched_at"), F.lit("")).try_cast("timestamp"), now).alias("fetched_at"),
    )
