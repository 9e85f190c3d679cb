"""JSON of any shape as VARIANT: containment of a pattern, walks over all nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)$"


def kind_of(value: Column) -> Column:
    """The type of a variant, arrays and objects without what they hold: ``STRING``, ``BOOLEAN``, ``VOID``, ``ARRAY``, ``OBJECT``, ``NUMBER``; null where there is none."""
    kind = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    return F.when(value.isNotNull(), F.regexp_replace(kind, NUMBERS, "NUMBER"))


def member(value: Column, key: str) -> Column:
    """The value of a key of an object, null where there is none."""
    if "'" in key or "\\" in key:
        raise ValueError(f"key {key!r} cannot be addressed")
    return F.try_variant_get(value, f"$['{key}']", "variant")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def items(value: Column) -> Column:
    """The items of an array; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def contains(value: Column, pattern) -> Column:
    """Whether a variant holds ``pattern``, made of dicts, lists and scalars; false for a null value.

    Objects hold a pattern's keys with values that hold the pattern's; arrays hold each of a pattern's items in some item, in any order and as often as one
    likes; an array also holds a scalar that is one of its items at the top.  Numbers compare by value, null only equals null.
    """
    return F.coalesce(_holds(value, pattern, True), F.lit(False))


def _holds(value: Column, pattern, top: bool = False) -> Column:
    if isinstance(pattern, dict):
        out = kind_of(value) == "OBJECT"
        for key, inner in pattern.items():
            out = out & F.coalesce(_holds(member(value, key), inner), F.lit(False))
        return out
    if isinstance(pattern, list):
        out = kind_of(value) == "ARRAY"
        for inner in pattern:
            out = out & F.coalesce(F.exists(items(value), _holder(inner)), F.lit(False))
        return out
    same = _equals(value, pattern)
    return same | F.coalesce(F.exists(items(value), lambda x: F.coalesce(_equals(x, pattern), F.lit(False))), F.lit(False)) if top else same


def _holder(pattern):
    return lambda x: F.coalesce(_holds(x, pattern), F.lit(False))


def _equals(value: Column, scalar) -> Column:
    if scalar is None:
        return kind_of(value) == "VOID"
    if isinstance(scalar, bool):
        return (kind_of(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == scalar)
    if isinstance(scalar, str):
        return (kind_of(value) == "STRING") & (F.try_variant_get(value, "$", "string") == scalar)
    return (kind_of(value) == "NUMBER") & (F.try_variant_get(value, "$", "double") == float(scalar))


def children(value: Column) -> Column:
    """What an object or array holds, as (``key``, ``value``); items of arrays have no key."""
    fields = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    nothing = F.lit(None).cast("string")
    listed = F.transform(items(value), lambda x: F.struct(nothing.alias("key"), x.alias("value")))
    return F.coalesce(fields, listed)


def walk(df: DataFrame, id_cols: list[str], value_col: str, keep) -> DataFrame:
    """(ids, ``depth``, ``key``, ``value``) of nested values that ``keep(key, value)`` accepts, whatever the depth.

    Level by level: each is exploded from the one before and written with what was found in it, so no level is computed twice and no row is
    ever walked in Python.  The number of levels is that of the deepest row.
    """
    level = df.select(*id_cols, F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"), F.col(value_col).alias("value"))
    found = level.filter(F.lit(False))
    while True:
        inside = level.select(*id_cols, (F.col("depth") + 1).alias("depth"), F.explode(children(F.col("value"))).alias("c")).select(*id_cols, "depth", "c.key", "c.value")
        marked = inside.withColumn("_found", F.coalesce(keep(F.col("key"), F.col("value")), F.lit(False)))
        rows = written(marked.filter(F.col("_found") | children(F.col("value")).isNotNull()), "walk")
        if rows.isEmpty():
            return found
        level = rows.drop("_found")
        found = found.unionByName(rows.filter("_found").drop("_found"))


PARTIAL_KEYS = ("failed", "failures", "retried", "deferred")


def is_partial(key: Column, value: Column) -> Column:
    """Whether an entry of a run's summary tells that work was left: a positive count of such a key, or any failures listed."""
    counted = key.isin(*PARTIAL_KEYS) | F.lower(key).endswith("deferred")
    positive = counted & (kind_of(value) == "NUMBER") & (F.try_variant_get(value, "$", "double") > 0)
    return positive | ((key == "failures") & (F.size(items(value)) > 0))


def run_status(runs: DataFrame, id_col: str, summary_col: str) -> DataFrame:
    """``partial`` or ``succeeded`` for each run, by all of its summary (a variant); a summary that is no object has succeeded."""
    objects = runs.filter(is_object(F.col(summary_col)))
    left = walk(objects, [id_col], summary_col, is_partial).select(id_col).distinct().withColumn("_left", F.lit(True))
    return runs.join(left, id_col, "left").select(*runs.columns, F.when(F.col("_left"), "partial").otherwise("succeeded").alias("status"))


def numeric_counts(runs: DataFrame, id_cols: list[str], summary_col: str) -> DataFrame:
    """(ids, ``key``, ``count``): the numbers at the top of each summary."""
    rows = runs.filter(is_object(F.col(summary_col))).select(*id_cols, F.explode(children(F.col(summary_col))).alias("c"))
    return rows.filter(kind_of(F.col("c.value")) == "NUMBER").select(*id_cols, "c.key", F.try_variant_get(F.col("c.value"), "$", "double").alias("count"))
