"""Score arithmetic.  Scores are rounded half up to two places by round2, once, at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body reads it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def severity(raw: Column) -> Column:
    """high, medium or low; null and unknown names are low."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit("low"))))
    return F.when(s.isin("high", "critical", "severe", "error"), "high").when(s.isin("medium", "moderate", "warning", "warn"), "medium").otherwise("low")


def page_score(high: Column, medium: Column, low: Column, words: Column) -> Column:
    """100 - 15 ln(1 + damage / complexity) within 25 to 100; damage 3, 2 and 1, complexity one for 300 words."""
    damage = high * 3 + medium * 2 + low
    return clamp(100 - 15 * F.log1p(damage / F.greatest(F.lit(1.0), words / 300)), 25.0)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def legacy_page_score(high: Column, medium: Column, low: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 15 * high - 8 * medium - 3 * low)


def steps(x: Column, *levels: tuple[float, float]) -> Column:
    """Points of the first level (least, points) that x reaches; 0 below all."""
    out = F
    for least, points in levels:
        out = out.when(x >= least, F.lit(float(points)))
    return out.otherwise(0.0)


def ranges(x: Column, *spans: tuple[float, float, float]) -> Column:
    """Points of the first span (low, high, points) that holds x; 0 outside all."""
    out = F
    for low, high, points in spans:
        out = out.when(x.between(low, high), F.lit(float(points)))
    return out.otherwise(0.0)


def points(condition: Column, n: float) -> Column:
    return F.when(condition, F.lit(float(n))).otherwise(0.0)
