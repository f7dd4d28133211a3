"""Read-only diagnostics of scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import metrics as M
from newsloom.functions.durable import durable
from newsloom.functions.order import values_at
from newsloom.functions.packs import Pack
from newsloom.functions.text import contains_any


def distribution(df: DataFrame, score: str) -> DataFrame:
    """One row: mean, median, high percentiles (interpolated), counts near the top of the scale,
    and how saturated it is. The percentiles' values are found together, by their places."""
    rows = durable(df.select(F.col(score).cast("double").alias("s")))
    s = F.col("s")
    n = rows.agg(F.count(s)).first()[0]
    shares = {"median": 0.5, "p90": 0.90, "p95": 0.95, "p99": 0.99}
    at = {name: share * (n - 1) for name, share in shares.items()}
    places = sorted({int(f(x)) + 1 for x in at.values() for f in (math.floor, math.ceil)}) if n else []
    values = dict(zip(places, values_at(rows, "s", places), strict=True))

    def between(x: float) -> Column:
        low, high = math.floor(x), math.ceil(x)
        found = values[low + 1] if low == high else (high - x) * values[low + 1] + (x - low) * values[high + 1]
        return F.lit(found)

    share = F.try_divide(F.count_if(s >= 95), F.count(s))
    return rows.agg(
        F.count(s).alias("n"),
        F.avg(s).alias("mean"),
        *[(between(x) if n else F.lit(None).cast("double")).alias(name) for name, x in at.items()],
        F.max(s).alias("max"),
        *[F.count_if(s >= x).alias(f"n{x}") for x in (90, 95, 99)],
        F.count_if(F.abs(s - 100) < 1e-9).alias("n100"),
        F.when(share >= 0.10, "high").when(share >= 0.05, "medium").otherwise("ok").alias("saturation"),
    )


def shown_text(*parts: Column) -> Column:
    """The filled parts in lower case with single spaces; arrays (of the members' parts) in order."""
    every = F.flatten(F.array(*parts))
    plain = F.transform(every, lambda t: F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " ")))
    return F.array_join(F.filter(plain, lambda t: F.length(t) > 0), " ")


def shown(text: Column, pack: Pack) -> tuple[Column, Column]:
    """Whether the diagnostics' own, narrower lists exclude a text, and call it promotion."""
    return contains_any(text, pack.shown_excluded), contains_any(text, pack.shown_promo)


def number(record: Column, *keys: str) -> Column:
    """The first numeric value among the keys of a record (variant), as a double; text that
    looks like a number isn't one."""
    found = []
    for key in keys:
        kind = F.schema_of_variant(F.try_variant_get(record, f"$.{key}", "variant"))
        found.append(F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), F.try_variant_get(record, f"$.{key}", "double")))
    return F.coalesce(*found)


def metric(record: Column, *keys: str) -> Column:
    """The first of the keys that the record or else its prediction has as a number."""
    return number(record, *[path for key in keys for path in (key, f"prediction.{key}")])


def warnings(score, views, likes, comments, reposts, excluded=None, promo=None) -> Column:
    """Names of what makes a score doubtful."""
    some = views > 0
    rate = M.weighted_engagement(likes, comments, reposts, views) * 1000.0
    base = F.greatest(views, F.lit(1.0))
    checks = {
        "EXCLUDED_TOPIC": F.lit(False) if excluded is None else excluded,
        "PROMO": F.lit(False) if promo is None else promo,
        "LOW_VIEWS": views < 500,
        "SMALL_SAMPLE": (views < 1000) & (comments >= 5),
        "SCORE_NEAR_CAP": score >= 99,
        "ENGAGEMENT_CAP": some & (rate >= 100),
        "DISCUSSION_CAP": some & (comments / base * 2500.0 >= 100),
        "SPREAD_CAP": some & (reposts / base * 5000.0 >= 100),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def label(score: Column, unverified: Column) -> Column:
    return F.when(unverified, "needs_confirmation").when(score >= 45, "in_work").otherwise("low_priority")


def shown_stats(topic: dict[str, Column], summed: dict[str, Column], members: Column) -> dict[str, Column]:
    """A topic's own counters, or its members' sums if it has neither likes nor comments."""
    use = ((topic["likes"] != 0) | (topic["comments"] != 0)) | (members == 0)
    return {c: F.when(use, topic[c]).otherwise(summed[c]) for c in topic}


def mismatches(df: DataFrame, a: str, b: str, tie: str, limit: int = 5) -> DataFrame:
    """Rows with both scores where the first exceeds the second by most."""
    gap = (F.col(a) - F.col(b)).alias("gap")
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("*", gap).orderBy(F.desc("gap"), tie).limit(limit)


def cycle_state(df: DataFrame) -> DataFrame:
    """Successes and failures of a polling cycle (ok); incomplete if most groups failed."""
    return df.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed")).withColumn(
        "incomplete", F.col("failed") > F.col("succeeded")
    )
