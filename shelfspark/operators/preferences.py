"""Learned genre preferences: decayed tallies, population rates, rarity weights, points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import logit, recency_weight, shrunk_rate, sigmoid
from ..functions.rules import EVENT_SIGNALS, REVIEW_SIGNALS
from ..functions.genres import display_key
from ..functions.text import genre_key
from ..session import written

BASELINE = "__baseline__"
LOOKBACK_DAYS = 180


def signal_table(spark: SparkSession) -> DataFrame:
    """The event signals, a fixed table of a few rows."""
    rows = [(e, float(p), float(t), m) for e, (p, t, m) in EVENT_SIGNALS.items()]
    return spark.createDataFrame(rows, "event string, positive double, total double, mood_only boolean")


def event_signals(draws: DataFrame, catalog: DataFrame, now: Column) -> DataFrame:
    """Signals of draw events: user, genres, mood, decayed positive and total.

    A draw with any reroll reason ignores bare rerolls; draws older than the look-back are out.
    """
    own = Window.partitionBy("user_id", "draw_no")
    recent = draws.filter(F.col("drawn_at") >= now - F.expr(f"INTERVAL {LOOKBACK_DAYS} DAYS"))
    flagged = recent.withColumn("_reason", F.max(F.col("event").startswith("reroll_")).over(own))
    useful = flagged.filter(~((F.col("event") == "drew_again") & F.col("_reason")))
    joined = useful.join(F.broadcast(signal_table(draws.sparkSession)), "event").join(catalog.select("appid", F.array("genre").alias("genres")), "appid")
    weight = recency_weight(F.col("created_at"), now)
    return joined.select("user_id", "genres", "mood", "mood_only", (F.col("positive") * weight).alias("positive"), (F.col("total") * weight).alias("total"))


def review_signals(reviews: DataFrame, catalog: DataFrame, now: Column) -> DataFrame:
    """Signals of the latest clean-up verdict per user and game, without a mood."""
    newest = Window.partitionBy("user_id", "appid").orderBy(F.col("reviewed_at").desc(), F.col("review_id").desc())
    latest = reviews.withColumn("_k", F.row_number().over(newest)).filter("_k = 1")
    latest = latest.filter(F.col("reviewed_at") >= now - F.expr(f"INTERVAL {LOOKBACK_DAYS} DAYS"))
    table = F.create_map(*[x for a, (p, t) in REVIEW_SIGNALS.items() for x in (F.lit(a), F.array(F.lit(float(p)), F.lit(float(t))))])
    weight = recency_weight(F.col("reviewed_at"), now)
    joined = latest.join(catalog.select("appid", F.array("genre").alias("genres")), "appid").withColumn("_s", table[F.col("action")])
    return joined.filter("_s is not null").select(
        "user_id", "genres", F.lit(None).cast("string").alias("mood"), F.lit(False).alias("mood_only"),
        (F.col("_s")[0] * weight).alias("positive"), (F.col("_s")[1] * weight).alias("total"),
    )


def tally(signals: DataFrame) -> DataFrame:
    """Decayed tallies by user, context and genre, rounded to 4 digits.

    Each signal counts once for every distinct genre and once for the baseline, in the context ``any`` unless it
    concerns the mood only, and in its mood's context if it has one.
    """
    genres = F.concat(F.array_distinct(F.transform("genres", genre_key)), F.array(F.lit(BASELINE)))
    contexts = F.filter(F.array(F.when(~F.col("mood_only"), "any"), F.col("mood")), lambda x: x.isNotNull())
    rows = signals.withColumn("genre", F.explode(genres)).withColumn("context", F.explode(contexts))
    return rows.groupBy("user_id", "context", "genre").agg(F.round(F.sum("positive"), 4).alias("positive"), F.round(F.sum("total"), 4).alias("total"))


def globals_of(rows: DataFrame) -> DataFrame:
    """Population sums of the rounded user rows."""
    return rows.groupBy("context", "genre").agg(F.round(F.sum("positive"), 4).alias("positive"), F.round(F.sum("total"), 4).alias("total"))


def rarity_weights(catalog: DataFrame) -> DataFrame:
    """ln(1 + games / games of the genre), divided by its mean over genres."""
    n = catalog.agg(F.count("*").alias("games"))
    per = catalog.groupBy(genre_key(F.col("genre")).alias("genre")).agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    weight = F.log(1 + F.col("games") / F.col("df"))
    return per.select("genre", "df", (weight / F.avg(weight).over(Window.partitionBy(F.lit(1)))).alias("weight"))


def points(rows: DataFrame, population: DataFrame, mood: str) -> DataFrame:
    """Points of the genres that a user has own tallies of, in [-8, 8]."""
    pairs = rows.filter(F.col("genre") != BASELINE).select("user_id", "genre").distinct()
    return points_of(pairs, rows, population, mood).select("user_id", "genre", F.round("points", 6).alias("points"))


def points_of(pairs: DataFrame, rows: DataFrame, population: DataFrame, mood: str) -> DataFrame:
    """Points of given users and genres in [-8, 8], by shrinkage from population to user to mood; ``moody``: the mood had a say.

    A user without tallies is served the population's view; genres without any evidence are left out.
    """

    def wide(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        out = [F.sum(F.when((F.col("context") == c) & (F.col("total") > 0), F.col(v))).alias(f"{prefix}_{n}_{v[0]}") for c, n in (("any", "any"), (mood, "mood")) for v in ("positive", "total")]
        return df.groupBy(*keys).agg(*out)

    user = wide(rows.filter(F.col("genre") != BASELINE), ["user_id", "genre"], "g")
    base = wide(rows.filter(F.col("genre") == BASELINE), ["user_id"], "b")
    pop = wide(population.filter(F.col("genre") != BASELINE), ["genre"], "p")
    overall = population.filter((F.col("genre") == BASELINE) & (F.col("context") == "any"))
    pop_base = overall.agg(F.sum("positive").alias("q_any_p"), F.sum("total").alias("q_any_t"))
    df = pairs.join(user, ["user_id", "genre"], "left").join(base, "user_id", "left").join(pop, "genre", "left").crossJoin(F.broadcast(pop_base))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    level = shrunk_rate(zero("q_any_p"), zero("q_any_t"), F.lit(0.5), 8.0)
    own_any = shrunk_rate(zero("b_any_p"), zero("b_any_t"), level, 8.0)
    own = shrunk_rate(zero("b_mood_p"), zero("b_mood_t"), own_any, 8.0)
    pop_genre = shrunk_rate(zero("p_any_p"), zero("p_any_t"), level, 4.0)
    prior = sigmoid(logit(own) + logit(pop_genre) - logit(level))
    rate = shrunk_rate(zero("g_mood_p"), zero("g_mood_t"), shrunk_rate(zero("g_any_p"), zero("g_any_t"), prior, 8.0), 8.0)
    known = F.col("g_any_t").isNotNull() | F.col("g_mood_t").isNotNull() | F.col("p_any_t").isNotNull()
    return df.filter(known).select("user_id", "genre", (8 * F.tanh((logit(rate) - logit(own)) / 3)).alias("points"), F.col("g_mood_t").isNotNull().alias("moody"))


def library_weights(games: DataFrame) -> DataFrame:
    """Rarity of genres within each user's own library: ln(1 + games / games of the genre) over its mean; ``games`` has ``genres``."""
    sets = games.groupBy("user_id", F.array_distinct("genres").alias("genres")).agg(F.count("*").alias("games"))
    n = sets.groupBy("user_id").agg(F.sum("games").alias("n"))
    per = sets.select("user_id", F.explode("genres").alias("genre"), "games").groupBy("user_id", "genre").agg(F.sum("games").alias("count")).join(n, "user_id")
    weight = F.log(1 + F.col("n") / F.col("count"))
    return per.select("user_id", "genre", (weight / F.avg(weight).over(Window.partitionBy("user_id"))).alias("weight"))


def adjustment(games: DataFrame, rows: DataFrame, population: DataFrame, mood: str, least: float = 2.5, library: DataFrame | None = None) -> DataFrame:
    """Weighted mean of the points of a game's genres and the reason, per ``user_id`` and ``appid`` of ``games`` (``genres``: keys in order).

    The reason names the genre with the greatest points by absolute value, the first of equals; games without evidence get 0.
    Genres are weighed by the user's ``library``, which is ``games`` unless given.  What is known of a user's genres is one row per user, so games are neither
    exploded nor shuffled by their id.
    """
    weights = library_weights(games if library is None else library)
    found = points_of(weights.select("user_id", "genre"), rows, population, mood).join(weights, ["user_id", "genre"])
    known = F.map_from_entries(F.collect_list(F.struct("genre", F.struct("points", "weight", "moody"))))
    per = written(found.groupBy("user_id").agg(known.alias("_known")), "known")
    each = F.transform("genres", lambda g, i: F.struct(F.try_element_at("_known", g).alias("of"), (-i).alias("first"), g.alias("genre")))
    joined = games.select("user_id", "appid", "genres").join(per, "user_id", "left").withColumn("_of", F.filter(each, lambda e: e["of"].isNotNull()))
    total = lambda value: F.aggregate("_of", F.lit(0.0), lambda acc, e: acc + value(e["of"]))
    mean = F.when(F.size("_of") > 0, total(lambda k: k["points"] * k["weight"]) / total(lambda k: k["weight"]))
    sizes = F.transform("_of", lambda e: F.struct(F.round(F.abs(e["of"]["points"]), 9).alias("size"), e["first"], e["genre"], e["of"]["moody"].alias("moody")))
    told = joined.select("user_id", "appid", mean.alias("points"), F.array_max(sizes).alias("_top"))
    context = F.when(F.col("_top.moody"), f" when {mood.title()}").otherwise("")
    reason = F.when(F.col("points") >= least, F.concat(display_key(F.col("_top.genre"), "rpg"), F.lit(" lands well for you"), context))
    return told.select("user_id", "appid", F.coalesce("points", F.lit(0.0)).alias("points"), reason.alias("reason"))
