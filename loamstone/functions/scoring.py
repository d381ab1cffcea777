"""Scores of remembered rows: familiarity, decay, repair, and the strengths of a memory graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPOSURE_BOOST, HALF_SATURATION, MOST_REPAIR = 0.10, 10.0, 1.10
DAY = 86_400.0


def exposure_saturation(recalls: Column, half: float = HALF_SATURATION) -> Column:
    n = F.greatest(F.coalesce(recalls, F.lit(0)), F.lit(0)).cast("double")
    return n / (n + half)


def intrinsic_score(importance: Column, impact: Column | None = None) -> Column:
    base = F.greatest(F.lit(0.0), F.coalesce(importance, F.lit(0.0)))
    return base * (1 + _unit(impact)) if impact is not None else base


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def decay_score(importance: Column, recalls: Column, age: Column, e_fold: float, impact: Column | None = None) -> Column:
    """Intrinsic score after exponential ageing (``e_fold`` seconds to 1/e, longer with impact), lifted by familiarity, never above it."""
    whole = intrinsic_score(importance, impact)
    longer = 1 + _unit(impact) if impact is not None else F.lit(1.0)
    aged = whole * F.exp(-age / (e_fold * longer)) if e_fold > 0 else whole
    return F.least(whole, aged + EXPOSURE_BOOST * whole * exposure_saturation(recalls))


def age_seconds(now: float | Column, created: Column, occurred: Column | None = None) -> Column:
    anchor = F.coalesce(occurred, created) if occurred is not None else created
    return F.greatest(F.lit(0.0), (F.lit(now) if not isinstance(now, Column) else now) - anchor)


def repaired_score(whole: Column, familiar: Column, relevance: Column, most: float = MOST_REPAIR) -> Column:
    """What decay took comes back with relevance."""
    return familiar + _unit(relevance) * most * F.greatest(F.lit(0.0), whole - familiar)


def either(a: Column, b: Column, weight: float = 1.0) -> Column:
    """Two signals joined as independent evidence."""
    return 1 - (1 - a) * (1 - weight * b)


def node_strength(importance: Column, confidence: Column | None = None, impact: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    best = F.greatest(F.lit(0.4), 0.6 * importance + 0.2, 0.4 * (none if confidence is None else confidence) + 0.2)
    return F.least(F.lit(1.5), best + 0.2 * F.coalesce(none if impact is None else impact, F.lit(0.0)))


def edge_strength(kind: Column, weight: Column, *, trust=None, affection=None, importance=None, confidence=None, impact=None, magnitude=None) -> Column:
    """The clipped weight (0 and null count as 0.5), or what the edge's attributes say if that is more."""
    none = F.lit(None).cast("double")
    base = F.when(F.coalesce(weight, F.lit(0.0)) == 0, F.lit(0.5)).otherwise(_unit(weight))
    half = [0.5 + 0.5 * F.abs(x) for x in (trust, affection, importance, confidence) if x is not None]
    own = [
        F.when(kind == "relation", 0.4 + 0.6 * (none if magnitude is None else magnitude)),
        F.when(kind == "episode", 0.3 + 0.5 * (none if impact is None else impact)),
        F.when(kind == "fact", 0.3 + 0.5 * (none if confidence is None else confidence)),
    ]
    return F.least(F.lit(1.0), F.greatest(base, *half, *own))


def hebbian_weight(weight: Column, creation: Column, most_boost: float = 0.10) -> Column:
    return F.least(weight, creation + most_boost)


def base_level(now: float | Column, created: Column, recalls: Column, decay: float = 0.5, e_fold: float = 7 * DAY, floor: float = -2.0) -> Column:
    """Log-space base-level activation with a floor. The age is a thousandth of a second at least, in the future too; what was never created (null, 0) is at the floor."""
    age = F.greatest(F.lit(1e-3), (now if isinstance(now, Column) else F.lit(now)) - created)
    raw = -decay * F.log(age) - (age / (2 * e_fold) if e_fold > 0 else F.lit(0.0))
    known = F.coalesce(created, F.lit(0.0)) > 0
    return F.when(known, F.greatest(F.lit(floor), raw) + F.log1p(EXPOSURE_BOOST * exposure_saturation(recalls))).otherwise(F.lit(floor))


def edge_id(kind: Column, src: Column, dst: Column, symmetric: tuple[str, ...] = ("transition", "co_occurrence", "chat")) -> Column:
    """One id for both directions of a symmetric edge."""
    return F.when(kind.isin(*symmetric), F.concat(F.lit("e:"), kind, F.lit(":"), F.least(src, dst), F.lit("::"), F.greatest(src, dst))).otherwise(
        F.concat(F.lit("e:"), kind, F.lit(":"), src, F.lit("->"), dst)
    )
