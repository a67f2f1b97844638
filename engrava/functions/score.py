"""Scores as column expressions. `now` is always an argument; all work inside generated code."""

from __future__ import annotations

from pyspark.sql import functions as F

DAY = 86400.0


def clamp01(c: F.Column) -> F.Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def half_life(age_days: F.Column, days: float) -> F.Column:
    return F.pow(F.lit(0.5), age_days / F.lit(days))


def age_days(since: F.Column, now: float) -> F.Column:
    return F.greatest(F.lit(0.0), (F.lit(float(now)) - since) / F.lit(DAY))


def legacy(importance: F.Column, created: F.Column, now: float, days: float = 30.0) -> F.Column:
    return clamp01(F.lit(0.35) * importance + F.lit(0.65) * half_life(age_days(created, now), days))


def recency(created: F.Column, now: float, days: float = 30.0) -> F.Column:
    return half_life(age_days(created, now), days)


def usage(recalls: F.Column, last: F.Column, now: float, days: float = 30.0) -> F.Column:
    """Saturating in the number of recalls, fading with the time since the last; a missing last recall doesn't fade."""
    fresh = F.coalesce(half_life(age_days(last, now), days), F.lit(1.0))
    return F.when(recalls <= 0, F.lit(0.0)).otherwise(clamp01(F.log1p(recalls.cast("double")) / F.log1p(F.lit(100.0))) * (F.lit(0.25) + F.lit(0.75) * fresh))


def feedback(positive: F.Column, negative: F.Column) -> F.Column:
    return F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.tanh((positive - negative) / F.lit(3.0))))


def blended(importance: F.Column, created: F.Column, recalls: F.Column, last: F.Column, positive: F.Column, negative: F.Column, now: float, days: float = 30.0) -> F.Column:
    """Importance .40, recency .25, usage .25, feedback .10."""
    return clamp01(F.lit(0.40) * clamp01(importance) + F.lit(0.25) * recency(created, now, days) + F.lit(0.25) * usage(recalls, last, now, days) + F.lit(0.10) * feedback(positive, negative))


def item(importance: F.Column, created: F.Column, now: float) -> F.Column:
    """Score of an item held in memory: half-life of seven days."""
    return clamp01(importance * (F.lit(0.25) + F.lit(0.75) * half_life(age_days(created, now), 7.0)))


def adaptive(importance: F.Column, created: F.Column, recalls: F.Column, last: F.Column, degree: F.Column, now: float, weights: tuple[float, float, float, float] = (0.40, 0.20, 0.25, 0.15)) -> F.Column:
    graph = clamp01(F.log1p(degree.cast("double")) / F.log1p(F.lit(8.0)))
    a, b, c, d = map(F.lit, weights)
    return clamp01(a * clamp01(importance) + b * recency(created, now) + c * usage(recalls, last, now) + d * graph)


def signal_adjusted(importance: F.Column, recalls: F.Column, negative: F.Column) -> F.Column:
    up = F.least(F.lit(0.10), F.lit(0.10) * recalls / F.lit(5.0))
    down = F.least(F.lit(0.15), F.lit(0.15) * negative / F.lit(3.0))
    return clamp01(importance + up - down)


def temporal(intent: str, confidence: float, since: F.Column, now: float) -> F.Column:
    """Multiplier of a hit for a query about the present, past or future; since is the last update, else the creation."""
    age = age_days(since, now)
    base = {
        "current": F.lit(1.25) + F.lit(0.25) * F.exp(-age / F.lit(30.0)),
        "past": F.lit(1.25) + F.lit(0.25) * F.tanh((age - F.lit(7.0)) / F.lit(7.0)),
        "future": F.when(since > F.lit(float(now)), F.lit(1.4)).otherwise(F.lit(0.7)),
    }.get(intent, F.lit(1.0))
    return F.lit(1.0) + (base - F.lit(1.0)) * F.lit(confidence)
