"""Parsers of vendor payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genres import sane_tags

OWNED = "response struct<game_count:int, games:array<struct<appid:bigint,name:string,playtime_forever:bigint,rtime_last_played:bigint>>>"


def owned_games(df: DataFrame, json_col: str) -> DataFrame:
    """Rows of an owned-games payload; entries without id or title are dropped."""
    games = df.select(*[c for c in df.columns if c != json_col], F.inline(F.from_json(json_col, OWNED)["response"]["games"]))
    hours = F.floor(F.coalesce("playtime_forever", F.lit(0)) / 6 + 0.5) / 10
    return games.filter(F.col("appid").isNotNull() & (F.trim(F.coalesce("name", F.lit(""))) != "")).select(
        *[c for c in df.columns if c != json_col], "appid", F.trim("name").alias("title"), hours.alias("hours"),
        F.when(hours > 0, "In Progress").otherwise("Not Started").alias("status"),
        F.when(F.col("rtime_last_played") > 0, F.timestamp_seconds("rtime_last_played")).alias("last_played_at"),
    )


def owner_page(df: DataFrame, raw_col: str, page_col: str, size: int, strict: bool = False) -> DataFrame:
    """Entries of an object page in source order; an empty name keeps its rank slot but is dropped.

    A parsed map would lose the order, so keys come from the raw text.  ``strict`` fails the job where a page has not ``size``
    entries, repeats an id or has an entry of another id than its key.
    """
    keys = F.regexp_extract_all(raw_col, F.lit(r'"([0-9]+)"\s*:\s*\{'), F.lit(1))
    if strict:
        found, page = F.size(keys).cast("string"), F.col(page_col).cast("string")
        wrong = F.when(F.size(keys) != size, F.concat_ws(" ", F.lit("page"), page, F.lit("has"), found, F.lit(f"entries; expected {size}")))
        wrong = wrong.when(F.size(F.array_distinct(keys)) != F.size(keys), F.concat(F.lit("page "), page, F.lit(" contains duplicate ids")))
        keys = F.when(wrong.isNull(), keys).otherwise(F.raise_error(wrong))
    entries = F.from_json(raw_col, "map<string,struct<appid:bigint,name:string,owners:string>>")
    rows = df.select(page_col, F.posexplode(keys).alias("pos", "key"), entries.alias("_m"))
    named = rows.select((F.col(page_col) * size + F.col("pos") + 1).alias("rank"), F.col("_m")[F.col("key")].alias("e"), "key")
    if strict:
        same = F.coalesce(F.col("e.appid") == F.col("key").cast("long"), F.lit(False))
        named = named.withColumn("rank", F.when(same, F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("malformed row of id "), "key"))))
    return named.select("rank", "e.*").filter(F.trim(F.coalesce("name", F.lit(""))) != "")


def page_links(df: DataFrame, html_col: str, pattern: str) -> DataFrame:
    """Distinct first groups of a pattern in HTML."""
    return df.select(F.explode(F.regexp_extract_all(html_col, F.lit(pattern), F.lit(1))).alias("id")).distinct()


def page_hrefs(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Distinct (page, href) of all anchors with a quoted address."""
    found = F.regexp_extract_all(html_col, F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
    return df.select(id_col, F.explode(found).alias("_q")).select(id_col, F.expr("substring(_q, 2, length(_q) - 2)").alias("href")).distinct()


def paths(spark, folder: str, schema: str, multiline: bool = False) -> DataFrame:
    """JSON files of a folder with an explicit schema and their names."""
    reader = spark.read.schema(schema).option("multiLine", multiline)
    return reader.json(folder).withColumn("file", F.input_file_name())


DETAIL = (
    "type string, name string, is_free boolean, short_description string, developers array<string>, publishers array<string>, "
    "genres array<struct<id:string,description:string>>, categories array<struct<id:int,description:string>>, platforms struct<windows:boolean,mac:boolean,linux:boolean>, "
    "price_overview struct<currency:string,initial:double,final:double,discount_percent:double>, release_date struct<coming_soon:boolean,date:string>"
)


def clean_list(values):
    """Trimmed texts of an array without empty ones."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def descriptions(values):
    """The descriptions of an array of structs."""
    return clean_list(F.transform(values, lambda x: x["description"]))


def minor_units(x):
    """A whole number of cents of 0 or more, else null."""
    return F.when((x >= 0) & (x == F.floor(x)), x.cast("long"))


def currency(x):
    """Three capital letters, else null."""
    code = F.upper(F.trim(x))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def release_day(x):
    """The day of texts such as "9 Dec, 2020", "Dec 9, 2020" or "2020-12-09", else null."""
    plain = F.trim(x)
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)).cast("date") for p in ("d MMM, yyyy", "MMM d, yyyy", "yyyy-MM-dd")])


def store_details(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Store payloads ``{id: {success, data}}`` as rows; ``problem`` tells unavailable and incomplete ones."""
    entry = F.from_json(json_col, f"map<string,struct<success:boolean,data:struct<{', '.join(_colons(DETAIL))}>>>")[F.col(id_col).cast("string")]
    rows = df.select(id_col, entry.alias("e")).select(id_col, F.col("e.success").alias("ok"), "e.data.*")
    price, title = F.col("price_overview"), F.trim(F.coalesce("name", F.lit("")))
    usd = currency(price["currency"]) == "USD"
    return rows.select(
        id_col, F.when(~F.coalesce("ok", F.lit(False)), "unavailable").when(title == "", "incomplete").alias("problem"), F.lower(F.trim("type")).alias("type"), title.alias("title"),
        F.when(usd, minor_units(price["initial"])).alias("price_initial"), F.when(usd, minor_units(price["final"])).alias("price_final"),
        F.least(F.greatest(F.floor(F.coalesce(price["discount_percent"], F.lit(0.0)) + 0.5), F.lit(0)), F.lit(100)).cast("long").alias("discount"),
        F.coalesce("is_free", F.lit(False)).alias("is_free"), F.coalesce(F.col("platforms")["mac"], F.lit(False)).alias("mac"),
        F.array_join(clean_list(F.col("developers")), ", ").alias("developer"), F.array_join(descriptions(F.col("genres")), "|").alias("genres"),
        F.array_join(descriptions(F.col("categories")), "|").alias("categories"), release_day(F.col("release_date")["date"]).alias("released"),
    )


def _colons(schema: str) -> list[str]:
    """Fields of a schema in the notation of a struct type."""
    fields, depth, start = [], 0, 0
    for k, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = schema[start:k].strip().split(" ", 1)
            fields.append(f"{name}:{kind}")
            start = k + 1
    return fields


def review_summary(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Review totals and a rating from 1 to 10, null without reviews."""
    sums = F.from_json(json_col, "success int, query_summary struct<total_positive:bigint,total_reviews:bigint>")["query_summary"]
    total, good = F.coalesce(sums["total_reviews"], F.lit(0)), F.coalesce(sums["total_positive"], F.lit(0))
    rating = F.when(total > 0, F.greatest(F.lit(1), F.least(F.lit(10), F.floor(good * 10 / total + 0.5))))
    return df.select(id_col, total.alias("total"), good.alias("positive"), F.greatest(F.lit(0), total - good).alias("negative"), rating.cast("long").alias("rating"))


def deck_grade(json_col):
    """The grade of a compatibility report, null if it failed."""
    report = F.from_json(json_col, "success int, results struct<resolved_category:int>")
    return F.when(report["success"] > 0, report["results"]["resolved_category"])


def first_player(df: DataFrame, json_col: str) -> DataFrame:
    """The first player of each payload."""
    players = F.from_json(json_col, "response struct<players:array<struct<steamid:string,personaname:string,communityvisibilitystate:int>>>")["response"]["players"]
    return df.select(*[c for c in df.columns if c != json_col], F.try_element_at(players, F.lit(1)).alias("p")).filter("p is not null").select(*[c for c in df.columns if c != json_col], "p.*")


def community_tags(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Tag maps of payloads that answer for the id that was asked."""
    payload = F.from_json(json_col, "appid bigint, tags map<string,double>")
    rows = df.select(id_col, payload.alias("p")).filter(F.col("p.appid") == F.col(id_col))
    return rows.select(id_col, sane_tags(F.coalesce(F.col("p.tags"), F.create_map().cast("map<string,double>"))).alias("tags"))


def owner_pages(df: DataFrame, raw_col: str, page_col: str, size: int, limit: int) -> DataFrame:
    """Entries of several owner pages up to ``limit``: of an id on two pages the first occurrence counts."""
    rows = owner_page(df, raw_col, page_col, size)
    once = rows.withColumn("_k", F.row_number().over(Window.partitionBy("appid").orderBy("rank"))).filter("_k = 1").drop("_k")
    return once.orderBy("rank").limit(limit)


def ranked_pages(df: DataFrame, page_col: str, json_col: str, size: int) -> DataFrame:
    """Rows of sorted pages ``[{game_id, value}]``: of a repeated game the first counts, ranks are dense positions per metric."""
    items = F.from_json(json_col, "array<struct<game_id:bigint,value:double>>")
    rows = df.select("metric", page_col, F.posexplode(items).alias("pos", "e")).select("metric", (F.col(page_col) * size + F.col("pos")).alias("at"), "e.*")
    once = rows.filter("game_id > 0").groupBy("metric", "game_id").agg(F.min_by("value", "at").alias("value"), F.min("at").alias("at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy("at"))).drop("at")
