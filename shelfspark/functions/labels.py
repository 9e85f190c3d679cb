"""Labels that a reader sees: ages, counts, money, hours, ranks, reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_up

DAY = 86_400_000_000


def whole(x: Column) -> Column:
    """A rounded number as text."""
    return half_up(x).cast("long").cast("string")


def fixed(x: Column, digits: int) -> Column:
    """So many digits of the nearer neighbour, measured on the double itself (9.45 is below the middle of 9.4 and 9.5)."""
    scale = float(10**digits)
    x = x.cast("double")
    low, high = F.floor(x * scale) / scale, (F.floor(x * scale) + 1) / scale
    return F.format_string(f"%.{digits}f", F.when(high - x <= x - low, high).otherwise(low))


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days from one moment to another."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / DAY)


def day_key(at: Column) -> Column:
    """The UTC day of a moment as text."""
    return F.date_format(at, "yyyy-MM-dd")


def dormancy_reason(last_played: Column, now: Column) -> Column:
    """Why a game was set aside: nothing below 21 days, days, months from 60 days, a year."""
    days = days_between(last_played, now)
    return (
        F.when(days.isNull() | (days < 21), None).when(days >= 365, "Untouched for over a year")
        .when(days >= 60, F.concat(F.lit("Not played in "), whole(days / 30), F.lit(" months"))).otherwise(F.concat(F.lit("Not played in "), days.cast("string"), F.lit(" days")))
    )


def dormancy_headline(last_played: Column, now: Column) -> Column:
    """As :func:`dormancy_reason`, with the years of long pauses."""
    days = days_between(last_played, now)
    years = F.floor(days / 365)
    return F.when(years >= 2, F.concat(F.lit("Untouched for "), years.cast("string"), F.lit(" years"))).otherwise(dormancy_reason(last_played, now))


def age_days(label: Column, now: Column) -> Column:
    """Days of a text such as "3d ago" or a date after an optional "Added"; infinite if it tells nothing."""
    pattern = r"(?i)(\d+)\s*([hdwmy])\s*ago"
    unit = F.lower(F.regexp_extract(label, pattern, 2))
    factor = F.when(unit == "h", 1 / 24).when(unit == "d", 1.0).when(unit == "w", 7.0).when(unit == "m", 30.0).when(unit == "y", 365.0)
    number = F.regexp_extract(label, pattern, 1).try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(label, r"(?i)^added\s+", ""))
    since = F.when(date.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(date)) / DAY))
    return F.coalesce(number * factor, since, F.lit(float("inf")))


def age_label(days: Column) -> Column:
    """Years, months of 30 days or days."""
    years = F.floor(days / 365)
    return (
        F.when(days >= 365, F.concat(years.cast("string"), F.when(years == 1, " year").otherwise(" years")))
        .when(days >= 30, F.concat(F.floor(days / 30).cast("string"), F.lit("mo"))).otherwise(F.concat(F.floor(days).cast("string"), F.lit("d")))
    )


def review_count(n: Column) -> Column:
    """A count with M or k."""
    return (
        F.when(n >= 1_000_000, F.concat(fixed(n / 1_000_000, 1), F.lit("M"))).when(n >= 10_000, F.concat(whole(n / 1000), F.lit("k")))
        .when(n >= 1000, F.concat(fixed(n / 1000, 1), F.lit("k"))).otherwise(n.cast("string"))
    )


def money(cents: Column) -> Column:
    """US dollars; whole ones from 100 on."""
    amount = F.coalesce(cents, F.lit(0)) / 100
    return F.when(amount >= 100, F.concat(F.lit("$"), F.format_number(half_up(amount), 0))).otherwise(F.concat(F.lit("$"), fixed(amount, 2)))


def hours_label(hours: Column) -> Column:
    return F.when(hours >= 1000, F.concat(fixed(hours / 1000, 1), F.lit("k"))).otherwise(whole(hours))


def duration_label(minutes: Column) -> Column:
    """Hours of an estimate, one digit below ten."""
    hours = minutes / 60
    short = F.regexp_replace(fixed(hours, 1), r"\.0$", "")
    return F.when(minutes.isNull() | (minutes == 0), "Not available").otherwise(F.concat(F.when(hours < 10, short).otherwise(whole(hours)), F.lit("h")))


def ordinal(n: Column) -> Column:
    ending = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def match_label(score: Column) -> Column:
    return (
        F.when(score >= 92, "Perfect match").when(score >= 82, "Excellent match").when(score >= 68, "Strong match")
        .when(score >= 50, "Good match").otherwise("Eligible pick")
    )


def appeal_label(kind: Column) -> Column:
    return (
        F.when(kind == "phenomenon", "Everyone has played this").when(kind == "acclaimed", "Widely loved")
        .when(kind == "hidden-gem", "Hidden gem").when(kind == "divisive", "Divisive")
    )


def recap_line(minutes: Column, finished: Column) -> Column:
    """Play time and finished games of a visit in one line."""
    hours = minutes / 60
    short = F.regexp_replace(fixed(hours, 1), r"\.0$", "")
    played = F.when(minutes >= 60, F.concat(F.when(hours < 10, short).otherwise(whole(hours)), F.lit("h played"))).otherwise(F.concat(whole(minutes), F.lit(" minutes played")))
    done = F.when(finished > 0, F.concat(finished.cast("string"), F.when(finished == 1, " game").otherwise(" games"), F.lit(" finished")))
    return F.concat_ws(" · ", F.when(minutes >= 20, played), done)
