"""Tracking how topics fare: first sight, observations, and checkpoints after hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import metrics as M
from newsloom.operators.posts import COUNTERS

#: Hours of the checkpoints, and seconds within which a value counts.
HOURS, TOLERANCE = (1, 3), 600


def first_seen(df: DataFrame, audience: str, post: str, poll: str) -> DataFrame:
    """``audience, post, poll`` of posts first seen after the audience's first poll, which only
    marks what is there."""
    seen = df.groupBy(audience, post).agg(F.min(poll).alias("seen"))
    start = df.groupBy(audience).agg(F.min(poll).alias("start"))
    return seen.join(start, audience).where("seen > start").select(audience, post, F.col("seen").alias(poll))


def observation_id(audience: Column, ids: Column) -> Column:
    """SHA-256 of the audience and the sorted distinct ids."""
    return F.sha2(F.concat_ws("|", audience, F.to_json(F.array_sort(F.array_distinct(ids)))), 256)


def inserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new observations whose id isn't known yet, one of each id."""
    return new.dropDuplicates(["observation_id"]).join(old.select("observation_id"), "observation_id", "left_anti")


def completed(states: DataFrame) -> DataFrame:
    """``observation_id, predicted_at`` with ``completed_{h}h`` and ``score_{h}h`` of each hour,
    from the checkpoints' states: the rows that models learn from."""
    done = lambda h: (F.col("hours") == h) & (F.col("state") == "completed")
    made = [f for h in HOURS for f in (F.bool_or(done(h)).alias(f"completed_{h}h"), F.max(F.when(done(h), F.col("score"))).alias(f"score_{h}h"))]
    return states.groupBy("observation_id").agg(F.min("predicted_at").alias("predicted_at"), *made)


def stored(old: DataFrame, new: DataFrame) -> DataFrame:
    """Observations after an insert that leaves known ids alone."""
    return old.unionByName(inserted(old, new))


def checkpoints(observations: DataFrame, snapshots: DataFrame, now: Column) -> DataFrame:
    """The state of each (observation, hour): completed with the first complete snapshot in its
    window, missed if the window is over, else pending.

    ``observations`` has observation_id, audience, member_ids, predicted_at; ``snapshots`` has
    audience, post_id, snap_ts and the counters; a snapshot is complete if it has exactly the
    observation's posts. A post is one row for all hours; it meets its own snapshots within the span
    of the windows, in buckets as long as that span, of which it touches two at most, so a post with a long history stays cheap. Its posts are
    collected as a set, no longer than the observation's own array: distinct counts cost an exchange.
    """
    due = observations.select(
        "observation_id", "audience", "predicted_at", F.explode(F.array(*[F.lit(h) for h in HOURS])).alias("hours")
    ).withColumn("due", F.col("predicted_at") + F.col("hours") * 3600)
    begin, end = F.col("predicted_at") + min(HOURS) * 3600, F.col("predicted_at") + max(HOURS) * 3600 + TOLERANCE
    span = (max(HOURS) - min(HOURS)) * 3600 + TOLERANCE
    posts = observations.select(
        "observation_id", "audience", "predicted_at", F.size("member_ids").alias("expected"), F.explode("member_ids").alias("post_id")
    )
    posts = posts.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor(begin / span), F.floor(end / span)))))
    snapshots = snapshots.where(F.col("snap_ts") <= now).withColumn("bucket", F.floor(F.col("snap_ts") / span))
    hour = None
    for h in HOURS:  # windows of different hours don't overlap
        at = F.col("predicted_at") + h * 3600
        within = (F.col("snap_ts") >= at) & (F.col("snap_ts") <= at + TOLERANCE)
        hour = F.when(within, h) if hour is None else hour.when(within, h)
    seen = posts.join(snapshots, ["audience", "post_id", "bucket"]).withColumn("hours", hour).where("hours IS NOT NULL")
    whole = (
        seen.groupBy("observation_id", "hours", "snap_ts", "expected")
        .agg(F.size(F.collect_set("post_id")).alias("found"), *[F.sum(c).alias(c) for c in COUNTERS])
        .where("found = expected")
    )
    first = whole.groupBy("observation_id", "hours").agg(
        F.min("snap_ts").alias("measured_at"), *[F.min_by(c, "snap_ts").alias(c) for c in COUNTERS]
    )
    rate = M.weighted_engagement(F.col("likes"), F.col("comments"), F.col("reposts"), F.col("views").cast("double"))
    state = (
        F.when(F.col("measured_at").isNotNull(), "completed")
        .when(now > F.col("due") + TOLERANCE, "missed")
        .otherwise("pending")
    )
    return (
        due.select("observation_id", "audience", "predicted_at", "hours", "due")
        .join(first, ["observation_id", "hours"], "left")
        .select("*", rate.alias("score"), state.alias("state"))
    )
