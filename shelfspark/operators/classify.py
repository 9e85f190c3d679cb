"""Games without an end, guessed lengths, progress and length labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import clamp, half_up
from ..functions.rules import ENDLESS_GENRES, ENDLESS_SIGNALS, ENDLESS_TITLES, HOURS_OF, LENGTHS, ONLINE_SERVICES, PERSISTENT_WORLDS, REPLAY_LOOPS

#: Share of the top vote from which a tag describes a game; completion to story from which a length is no completion.
DOMINANT, RATIO, LONG_MINUTES = 0.65, 12, 12_000


def _any(names: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, wanted)))


def signals(*labels: Column) -> Column:
    """Lower-case names of several label arrays."""
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in labels])
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def top_vote(tags: Column) -> Column:
    """The greatest weight of a tag map above 0."""
    return F.array_max(F.filter(F.map_values(tags), lambda v: v > 0))


def dominant(tags: Column) -> Column:
    """Tags with at least DOMINANT of the top vote."""
    best = top_vote(tags)
    kept = F.filter(F.map_entries(tags), lambda e: e["value"] >= DOMINANT * best)
    return F.coalesce(F.transform(kept, lambda e: F.lower(F.trim(e["key"]))), F.array().cast("array<string>"))


def story_driven(tags: Column) -> Column:
    names = signals(F.map_keys(tags))
    return F.array_contains(names, "story rich") & ~_any(names, PERSISTENT_WORLDS)


def strong_replay(tags: Column, genres: Column, categories: Column) -> Column:
    """Decisive signs of a game without an end; a story rules them out."""
    names = signals(F.map_keys(tags), genres, categories)
    return ~F.coalesce(story_driven(tags), F.lit(False)) & (_any(dominant(tags), ENDLESS_SIGNALS) | (_any(names, ONLINE_SERVICES) & _any(names, REPLAY_LOOPS)))


def endless_shape(story: Column, completion: Column) -> Column:
    """A completion time far beyond the story's."""
    story, completion = (F.coalesce(x.cast("double"), F.lit(0.0)) for x in (story, completion))
    return F.when(completion == 0, False).when(story > 0, completion >= RATIO * story).otherwise(completion > LONG_MINUTES)


def is_endless(kind: Column, story: Column, completion: Column, estimate: Column, title: Column, genre: Column) -> Column:
    """By the kind where it is decided, then the shape of the lengths, then none if there is an estimate, then title and genre."""
    text = F.lower(F.concat_ws(" ", title, genre))
    named = text.rlike(ENDLESS_TITLES) | text.rlike(ENDLESS_GENRES)
    return (
        F.when(kind == "endless", True).when(kind.isin("finite", "not-applicable"), False).when(endless_shape(story, completion), True)
        .when(estimate.isNotNull(), False).otherwise(F.coalesce(named, F.lit(False)))
    )


def should_mark_endless(kind: Column, minutes: list[Column], tags: Column, genres: Column, categories: Column) -> Column:
    """Whether tags may decide: no kind, no minutes, strong signs."""
    undecided = F.coalesce(kind, F.lit("unknown")).isin("unknown", "")
    return undecided & (F.greatest(F.lit(0), *[F.coalesce(m, F.lit(0)) for m in minutes]) <= 0) & strong_replay(tags, genres, categories)


def guessed_hours(estimate: Column, endless: Column, title: Column, genre: Column) -> Column:
    """Hours of a game: its estimate, 0 without an end, else by words of title and genre."""
    text = F.lower(F.concat_ws(" ", title, genre))
    out = F.when(estimate.isNotNull(), estimate / 60).when(endless, 0.0)
    for words, hours in HOURS_OF.items():
        out = out.when(text.rlike(words), float(hours))
    return out.otherwise(20.0)


def progress_of(status: Column, endless: Column, hours: Column, estimate: Column, stored: Column, guess: Column) -> Column:
    """Percent done: 100 completed, 99 without an end, by the estimate, as stored, else by the guessed hours."""
    by = lambda whole: clamp(half_up(hours * 100 / whole), 0, 99)
    played = F.coalesce(hours, F.lit(0.0))
    kept = clamp(half_up(F.coalesce(stored, F.lit(0.0))), 0, 99)
    return (
        F.when(status == "Completed", 100).when(endless, 99).when(estimate.isNotNull(), F.when(played <= 0, 0).otherwise(by(estimate / 60)))
        .when(F.coalesce(stored, F.lit(0.0)) > 0, kept).when((played == 0) | (guess == 0), 0).when(played >= guess, 99).otherwise(by(guess)).cast("long")
    )


def status_from_progress(done: Column, endless: Column, hours: Column) -> Column:
    return F.when(done > 10, "In Progress").when(done > 0, "Sampled").when(endless & (hours > 0), "In Progress").otherwise("Not Started")


def length_label(endless: Column, hours: Column) -> Column:
    out = F.when(endless, "Endless").when(hours < 5, "Bitesize")
    for most, name in LENGTHS:
        out = out.when(hours <= most, name)
    return out.otherwise("Odyssey")


def confidence(count: Column) -> Column:
    """How far a duration is to be trusted, by its submissions."""
    return F.when(count >= 25, "high").when(count >= 5, "medium").otherwise("low")


def minutes_of(seconds: Column) -> Column:
    """Whole minutes of positive seconds, else null."""
    return F.when(seconds > 0, half_up(seconds / 60).cast("long"))
