"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent between 0 and 100; 0 of nothing."""
    return F.when(whole > 0, clamp(half_up(100.0 * part / whole), 0, 100)).otherwise(0).cast("long")


def shrunk_rate(positive: Column, total: Column, prior: Column, strength: float) -> Column:
    """Rate pulled towards a prior that weighs like ``strength`` observations."""
    return (positive + strength * prior) / (total + strength)


def logit(p: Column) -> Column:
    eps = 1e-6
    safe = clamp(p, eps, 1 - eps)
    return F.log(safe / (1 - safe))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def recency_weight(at: Column, now: Column, half_life_days: float = 60.0) -> Column:
    """0.5 ^ (age / half life); future events weigh 1, missing times 0."""
    days = (F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / half_life_days), F.lit(0.0))


def backoff_minutes(attempt: Column, base: float = 1.0, cap: float = 360.0) -> Column:
    """min(cap, base * 2^attempt)."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt))


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds of a Retry-After header: seconds, or a date after ``now``; null for anything else."""
    seconds = F.when(F.trim(header).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.ceil(F.trim(header).try_cast("double") * 1000))
    at = F.coalesce(F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")), F.try_to_timestamp(header))
    return F.coalesce(seconds, F.when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_millis(at) - F.unix_millis(now))))


def uint32_or_null(x: Column) -> Column:
    """A positive 32-bit id from text, else null."""
    value = F.when(x.rlike("^[0-9]{1,10}$"), x.cast("long"))
    return F.when((value > 0) & (value <= 4294967295), value)
