"""Aggregating posts to topics, and the two stages' scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import metrics as M
from newsloom.operators.posts import COUNTERS


def stats(df: DataFrame, key: str, source: str = "source", timestamp: str = "timestamp") -> DataFrame:
    """Per topic: sums of the counters (null counts as 0), which were measured at all (``has_``),
    the newest time, the posts and the distinct sources. One aggregation, partial before the
    shuffle but for the distinct sources."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in COUNTERS]
    has = [F.bool_or(F.col(c).isNotNull()).alias(f"has_{c}") for c in COUNTERS]
    name = F.nullif(F.lower(F.trim(F.col(source).cast("string"))), F.lit(""))
    return df.groupBy(key).agg(
        *sums,
        *has,
        F.max(timestamp).alias("newest"),
        F.count("*").alias("posts"),
        F.count_distinct(name).alias("sources"),
    )


def flags(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Per topic: whether any post is official and all are of a kind, the mean confidence, and
    the first post's type overridden by what all posts are."""
    c = F.col
    every = {
        "help_only": c("help"),
        "complaint_only": c("complaint") & ~c("official"),
        "opinion_only": c("opinion"),
        "ad_only": c("ad"),
        "nonlocal_only": c("nonlocal_detected"),
        "excluded_only": c("excluded"),
    }
    out = df.groupBy(key).agg(
        F.bool_or("official").alias("official"),
        *[F.bool_and(v).alias(n) for n, v in every.items()],
        F.round(F.avg("confidence"), 1).alias("confidence"),
        F.min_by("content_type", pos).alias("first_type"),
        F.min_by("source_kind", pos).alias("source_kind"),
        F.count("*").alias("posts"),
    )
    content = (
        F.when(c("help_only"), "help_request")
        .when(c("complaint_only"), "complaint")
        .when(c("opinion_only"), "opinion")
        .when(c("ad_only"), "advertising")
        .when(c("nonlocal_only"), "nonlocal")
        .otherwise(c("first_type"))
    )
    return out.withColumn("content_type", content).drop("first_type")


def gathered(df: DataFrame, key: str, pos: str, post: Column) -> DataFrame:
    """Members of each topic in order, as an array."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), post.alias("post"))))
    return df.groupBy(key).agg(F.transform(rows, lambda r: r["post"]).alias("members"))


def unwrapped(members: Column, kind: T.ArrayType) -> Column:
    """The post of each member: its own ``post`` where it has one, else the member itself, by the
    names of the post's fields."""
    inner = kind.elementType
    if "post" not in inner.names:
        return members
    fields = inner["post"].dataType.fields

    def post(m: Column) -> Column:
        own = [(m[f.name] if f.name in inner.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        return F.coalesce(m["post"], F.struct(*own))

    return F.transform(members, post)


def listed(members: Column, field: str) -> Column:
    """A field of the members in order, where it is filled."""
    return F.filter(F.transform(members, lambda m: m[field]), lambda v: F.coalesce(v, F.lit("")) != "")


def newest_of(members: Column) -> Column:
    """The newest valid time of the members; null if there is none."""
    return F.array_max(F.filter(F.transform(members, lambda m: m["timestamp"]), lambda t: t > 0))


def summary(df: DataFrame, status: str, eligible: str, posts: str) -> DataFrame:
    """One row: posts analysed, topics in the queue, topics left out, and the queue's by status."""
    holds, s = F.col(eligible), F.col(status)
    return df.agg(
        F.sum(posts).alias("posts_analyzed"), F.count_if(holds).alias("topic_count"), F.count_if(~holds).alias("excluded_topics"),
        F.count_if(holds & (s == "take_now")).alias("take_now"), F.count_if(holds & (s == "reject")).alias("reject"),
    )


def has_columns() -> dict[str, Column]:
    return {c: F.col(f"has_{c}") for c in COUNTERS}


def components(age_minutes: Column, locality: Column, impact: Column) -> dict[str, Column]:
    """All components of the second stage's score over the columns of :func:`stats`."""
    counted = M.signals(*[F.col(c) for c in COUNTERS], has_columns(), age_minutes)
    return {
        "freshness": M.freshness(age_minutes),
        "local_relevance": locality,
        "event_impact": impact,
        **counted,
        "cross_source_spread": M.source_spread(F.col("sources")),
    }


def age_minutes(now: Column) -> Column:
    return F.greatest(F.lit(0.0), (now - F.col("newest")) / 60.0)


def action(score: Column) -> Column:
    """The second stage's decision on a rounded score."""
    take = score >= 45
    return F.struct(
        F.when(take, "take_now").otherwise("reject").alias("status"),
        F.when(take, "editorial_work").otherwise("below_priority_threshold").alias("mode"),
        F.when(~take, "below_priority_threshold").alias("exclusion"),
    )
