"""Catalogue fusion: rank fusion, cohort merge, deduplication, overlays, cascades, exclusions, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.rules import RANK_OFFSET, RANK_WEIGHTS, SOFTWARE_LABELS, TEST_CHANNELS

def fuse_ranks(ranking: DataFrame, limit: int) -> DataFrame:
    """Weighted reciprocal-rank fusion: best rank per game and metric, then sum of weight / (60 + rank)."""
    best = ranking.groupBy("appid", "metric").agg(F.min("rank").alias("rank"))
    weight = F.create_map(*[F.lit(x) for pair in RANK_WEIGHTS.items() for x in pair])[F.col("metric")]
    fused = best.groupBy("appid").agg(F.round(F.sum(weight / (RANK_OFFSET + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"))
    order = [F.col("score").desc(), F.col("best_rank"), F.col("appid")]
    top = fused.orderBy(*order).limit(limit)
    # the window sorts at most ``limit`` rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def merge_cohorts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of two cohorts (appid, name, rank); names of ``a`` win, conflicts are marked."""
    left, right = a.select("appid", F.col("name").alias("_n"), F.col("rank").alias("rank_a")), b.select("appid", F.col("name").alias("_m"), F.col("rank").alias("rank_b"))
    both = left.join(right, "appid", "full_outer")
    return both.select("appid", F.coalesce("_n", "_m").alias("name"), "rank_a", "rank_b", F.coalesce(F.col("_n") != F.col("_m"), F.lit(False)).alias("conflict"))


def unique_rows(df: DataFrame, key: str, name: str, label: str) -> DataFrame:
    """The rows of a cohort; fails the job where a key is not positive, a name is empty or a key is repeated.

    The checks are part of one aggregation by key, so they need no pass of their own.
    """
    rest = [c for c in df.columns if c != key]
    per = df.groupBy(key).agg(F.first(F.struct(*rest)).alias("r"), F.count("*").alias("n"))
    empty = F.trim(F.coalesce(F.col("r")[name], F.lit(""))) == ""
    fault = F.when(~F.coalesce(F.col(key) > 0, F.lit(False)) | empty, "contains an invalid id or an empty name").when(F.col("n") > 1, "repeats id")
    sure = F.when(fault.isNull(), F.col(key)).otherwise(F.raise_error(F.concat_ws(" ", F.lit(f"{label} cohort"), fault, F.col(key).cast("string"))))
    return per.select(sure.alias(key), "r.*")


def counted(df: DataFrame, key: str) -> tuple[DataFrame, Observation]:
    """``df``, and its number of rows and smallest key as an observation, which the action that reads ``df`` fills."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("rows"), F.min(key).alias("low")), seen


def expect_rows(seen: Observation, expected: int, label: str) -> None:
    """Fails if the action has seen another number of rows."""
    if seen.get["rows"] != expected:
        raise ValueError(f"{label} cohort has {seen.get['rows']} rows; expected {expected}")


def merge_sources(a: DataFrame, b: DataFrame, label_a: str = "first", label_b: str = "second") -> DataFrame:
    """:func:`merge_cohorts` with the checks of :func:`unique_rows` on ``a`` and, but for repeats, on ``b``, and with diagnostics.

    Of a repeated id in ``b`` the row of the best rank counts.  ``sources`` names what holds an id, ``alternate`` is the name that gave way.
    """
    empty = (F.trim(F.coalesce("name", F.lit(""))) == "") | ~F.coalesce(F.col("appid") > 0, F.lit(False))
    sure = F.when(~empty, F.col("appid")).otherwise(F.raise_error(F.lit(f"{label_b} cohort contains an invalid id or an empty name")))
    best = b.withColumn("appid", sure).groupBy("appid").agg(F.min_by("name", "rank").alias("_m"), F.min("rank").alias("rank_b"))
    left = unique_rows(a, "appid", "name", label_a).select("appid", F.col("name").alias("_n"), F.col("rank").alias("rank_a"))
    both = left.join(best, "appid", "full_outer")
    conflict = F.coalesce(F.col("_n") != F.col("_m"), F.lit(False))
    names = F.array_compact(F.array(F.when(F.col("_n").isNotNull(), label_a), F.when(F.col("_m").isNotNull(), label_b)))
    return both.select("appid", F.coalesce("_n", "_m").alias("name"), "rank_a", "rank_b", F.array_join(names, "+").alias("sources"), F.when(conflict, F.col("_m")).alias("alternate"))


def nested_sources(keys: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per ``key`` with each source's rows as an array of structs, empty where it has none.

    Every source is gathered by the key once, and the joins keep that partitioning, so the plan has one exchange for each.  What one key
    holds must fit in a row, as whoever reads the result takes it whole.
    """
    out = keys.select(key).distinct()
    for name, df in sources.items():
        own = df.groupBy(key).agg(F.collect_list(F.struct(*[c for c in df.columns if c != key])).alias(name))
        out = out.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return out


def first_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_k = 1").drop("_k")


def overlay(df: DataFrame, key: str, terminal: Column, *newest: Column) -> DataFrame:
    """The last row of each key, but a terminal row is never replaced by an open one."""
    order = [F.when(terminal, 1).otherwise(0).desc(), *newest]
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_k = 1").drop("_k")


def exclusion(labels: Column, title: Column, kind: Column | None = None) -> Column:
    """Name of the first rule that excludes a catalogue entry, else null: not a game, a software label, a test channel."""
    lower = F.transform(labels, lambda x: F.lower(F.trim(x)))
    other = F.lower(F.trim(kind)) if kind is not None else F.lit("game")
    software = F.try_element_at(F.filter(lower, lambda x: x.isin(*SOFTWARE_LABELS)), F.lit(1))
    out = F.when((other != "") & (other != "game"), F.concat(F.lit("steam_type:"), other))
    out = out.when(software.isNotNull(), F.concat(F.lit("steam_label:"), software))
    for name, pattern in TEST_CHANNELS.items():
        out = out.when(title.rlike(pattern), f"release_channel:{name}")
    return out


def duration_cascade(wanted: DataFrame, mapping: DataFrame, direct: DataFrame, parents: DataFrame) -> DataFrame:
    """How a duration is found: mapped ids (none, several), direct rows, rows of the parent version."""
    ids = mapping.groupBy("appid").agg(F.count_distinct("game_id").alias("n_ids"), F.min("game_id").alias("game_id"))
    joined = wanted.join(ids, "appid", "left").join(direct.select("game_id", F.col("minutes").alias("_own")), "game_id", "left")
    joined = joined.join(parents, "game_id", "left").join(direct.select(F.col("game_id").alias("parent_id"), F.col("minutes").alias("_parent")), "parent_id", "left")
    status = (
        F.when(F.col("n_ids").isNull(), "not_found").when(F.col("n_ids") > 1, "ambiguous").when(F.col("_own").isNotNull(), "direct")
        .when(F.col("_parent").isNotNull(), "parent").otherwise("no_duration")
    )
    minutes = F.when(status == "direct", F.col("_own")).when(status == "parent", F.col("_parent"))
    return joined.select("appid", status.alias("status"), minutes.alias("minutes"))


def tag_labels(weights: Column, limit: int) -> Column:
    """Labels of a tag map by weight, then label; weights of 0 or less are out."""
    entries = F.filter(F.map_entries(weights), lambda e: e["value"] > 0)
    order = lambda x, y: (
        F.when(x["value"] > y["value"], -1).when(x["value"] < y["value"], 1).when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
    )
    return F.slice(F.transform(F.array_sort(entries, order), lambda e: e["key"]), 1, limit)


def quality(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row: rows, distinct keys, repeated keys, blank names."""
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce(F.col(name), F.lit(""))) == "").alias("blank"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_names"),
    )
