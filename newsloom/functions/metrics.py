"""Scoring formulas as Column helpers. Null means "not measured" and is never taken for zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the score's components, the views that count as full reach, and the
# coefficients and thresholds of the formulas below.
WEIGHTS = {
    "freshness": 0.20,
    "local_relevance": 0.16,
    "event_impact": 0.16,
    "reach": 0.10,
    "engagement": 0.14,
    "discussion": 0.07,
    "reshare": 0.05,
    "velocity": 0.06,
    "cross_source_spread": 0.06,
}
FULL = 50_000.0


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Within bounds; null stays null, which greatest() and least() alone would not keep."""
    return F.when(x.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def freshness(age_minutes: Column) -> Column:
    return clamp(100.0 * (1.0 - age_minutes / 180.0))


def age_hours(newest: Column, now: Column) -> Column:
    """Hours since an epoch second, a quarter at least; a quarter if there is none."""
    return F.coalesce(F.greatest(F.lit(0.25), (now - newest) / 3600.0), F.lit(0.25))


def on_log_scale(x: Column) -> Column:
    return clamp(100.0 * F.log1p(x) / F.log1p(F.lit(FULL)))


def weighted_engagement(likes: Column, comments: Column, reposts: Column, views: Column) -> Column:
    return (likes + 2.0 * comments + 4.0 * reposts) / F.greatest(views, F.lit(1.0))


def signals(views, likes, comments, reposts, has, age_minutes) -> dict[str, Column]:
    """The components that audience counters give. ``has`` tells by name which were measured."""
    seen = has["views"] & (views > 0)
    any_response = has["likes"] | has["comments"] | has["reposts"]
    base = F.greatest(views, F.lit(1.0))
    hours = F.greatest(age_minutes / 60.0, F.lit(1.0 / 60.0))
    return {
        "reach": F.when(seen, on_log_scale(views)),
        "engagement": F.when(
            seen & any_response, clamp(weighted_engagement(likes, comments, reposts, views) * 1000.0)
        ),
        "discussion": F.when(seen & has["comments"], clamp(comments / base * 5000.0)),
        "reshare": F.when(seen & has["reposts"], clamp(reposts / base * 5000.0)),
        "velocity": F.when(seen, on_log_scale(views / hours)),
    }


def source_spread(sources: Column) -> Column:
    """From the number of distinct sources: one gives 0, which counts; none gives null."""
    return F.when(sources > 0, clamp(100.0 * (1.0 - F.exp(-(sources - 1) / 2.0))))


def total_weight(parts: dict[str, Column]) -> Column:
    """Sum of the weights of the components that are known."""
    out = F.lit(0.0)
    for name, value in parts.items():
        out = out + F.when(value.isNotNull(), WEIGHTS[name]).otherwise(0.0)
    return out


def weighted_mean(parts: dict[str, Column]) -> Column:
    """Over the known components, their weights scaled up to one; unrounded; 0 if none is."""
    out = F.lit(0.0)
    for name, value in parts.items():
        out = out + F.coalesce(value * WEIGHTS[name], F.lit(0.0))
    return F.coalesce(clamp(F.try_divide(out, total_weight(parts))), F.lit(0.0))


def effective_weights(parts: dict[str, Column]) -> Column:
    """A map of the known components' weights scaled up to one, four decimals."""
    total = total_weight(parts)
    entries = [
        F.struct(F.lit(n).alias("key"), F.when(v.isNotNull(), F.round(WEIGHTS[n] / total, 4)).alias("value"))
        for n, v in parts.items()
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def coverage(has: dict[str, Column]) -> Column:
    """Names of the measured counters in order."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in has.items()])))


def priority(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 45, "medium").otherwise("low")


def local_relevance(nonlocal_: Column, explicit: Column, mentioned: Column) -> Column:
    return F.when(nonlocal_, 0.0).when(explicit, 100.0).when(mentioned, 80.0).otherwise(30.0)


def viral_complaint(complaint, views, reposts, members, sources) -> Column:
    return complaint & ((views >= 5000) | (reposts >= 10) | (members >= 3) | (sources >= 3))


# The analyser's own formulas, whose constants differ from those above.


def rounded(x: Column, digits: int) -> Column:
    """A double to ``digits`` decimals as SQL engines round it: the scaled value to the nearest whole
    number, halves away from zero. ``F.round`` goes by the shortest decimal form instead, which says
    43.85 where the scaled value is 438.49999999999994, or the other way round."""
    return F.round(x * 10.0**digits) / 10.0**digits


def early_signal(views, likes, comments, reposts, hours) -> Column:
    base = F.greatest(views, F.lit(1.0))
    cap = lambda x: F.least(F.lit(100.0), x)
    engagement = cap(weighted_engagement(likes, comments, reposts, views) * 1000.0)
    velocity = cap(views / hours / 250.0 * 100.0)
    discussion, spread = cap(comments / base * 2500.0), cap(reposts / base * 5000.0)
    return cap(velocity * 0.45 + engagement * 0.25 + discussion * 0.15 + spread * 0.15)


def viral(early: Column, hook: Column) -> Column:
    """``hook`` is a whole number, whose share is the double next to the exact product."""
    return rounded(F.least(F.lit(100.0), early * 0.65 + hook * 35 / 100.0), 1)


def analyser_score(viral_score, locality, age_minutes) -> tuple[Column, Column, Column, Column]:
    """(editorial, base, recency, score) of the first stage."""
    editorial = locality * 0.60 + viral_score * 0.40
    base = rounded(viral_score * 0.5 + editorial * 0.5, 1)
    recency = F.coalesce(rounded(F.greatest(F.lit(0.0), 100.0 * (1.0 - age_minutes / 180.0)), 1), F.lit(0.0))
    return editorial, base, recency, rounded(base * 0.72 + recency * 0.28, 1)
