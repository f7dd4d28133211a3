"""Queries over the events: a user is a topic, an event a post of the source named by its type.

Views, likes, comments and reposts are the views, clicks, signups and purchases; a counter that
no event of a topic carries was not measured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import metrics as M
from newsloom.functions.text import civil
from newsloom.operators import diagnostics, model, posts, rank, topics, tracker
from newsloom.operators.classify import complaint_signal, editorial_status
from newsloom.plans.registry import query, read

#: The time that scores are as of: 2024-01-30 23:59:59 UTC.
NOW = 1706659199
KINDS = {"views": ("view", 400), "likes": ("click", 2), "comments": ("signup", 1), "reposts": ("purchase", 1)}


def event_posts(spark, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    counted = [F.when(F.col("event_type") == kind, n).cast("long").alias(c) for c, (kind, n) in KINDS.items()]
    return events.select(
        F.col("user_id").alias("topic"), "event_id", F.col("event_type").alias("source"), at.alias("timestamp"), *counted
    )


POSTS = f"""posts AS (SELECT user_id AS topic, event_id, event_type AS source, floor(epoch(ts))::BIGINT AS timestamp,
  CASE WHEN event_type = 'view' THEN 400 END AS views, CASE WHEN event_type = 'click' THEN 2 END AS likes,
  CASE WHEN event_type = 'signup' THEN 1 END AS comments, CASE WHEN event_type = 'purchase' THEN 1 END AS reposts
  FROM events)"""
STATS = f"""{POSTS}, stats AS (SELECT topic, coalesce(sum(views), 0)::DOUBLE AS views, coalesce(sum(likes), 0)::DOUBLE AS likes,
  coalesce(sum(comments), 0)::DOUBLE AS comments, coalesce(sum(reposts), 0)::DOUBLE AS reposts,
  count(views) > 0 AS hv, count(likes) > 0 AS hl, count(comments) > 0 AS hc, count(reposts) > 0 AS hr,
  max(timestamp) AS newest, count(*) AS posts, count(DISTINCT source) AS sources FROM posts GROUP BY topic)"""
CLAMP = "CASE WHEN {0} IS NOT NULL THEN least(100.0, greatest(0.0, {0})) END"


def _clamp(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(100.0::DOUBLE, greatest(0.0::DOUBLE, {x})) END"


SIGNALS = f"""{STATS}, sig AS (SELECT *, greatest(0.0::DOUBLE, ({NOW} - newest) / 60.0::DOUBLE) AS age FROM stats),
parts AS (SELECT *,
  {_clamp("100.0 * (1.0 - age / 180.0)")} AS freshness,
  CASE WHEN topic % 5 = 0 THEN 0.0 WHEN topic % 5 = 1 THEN 100.0 WHEN topic % 5 = 2 THEN 80.0 ELSE 30.0 END::DOUBLE AS local_relevance,
  CASE WHEN topic % 4 = 0 THEN 85.0 ELSE 20.0 END::DOUBLE AS event_impact,
  CASE WHEN hv AND views > 0 THEN {_clamp("100.0 * ln(1 + views) / ln(50001.0::DOUBLE)")} END AS reach,
  CASE WHEN hv AND views > 0 AND (hl OR hc OR hr) THEN {_clamp("(likes + 2 * comments + 4 * reposts) / greatest(views, 1.0) * 1000")} END AS engagement,
  CASE WHEN hv AND views > 0 AND hc THEN {_clamp("comments / greatest(views, 1.0) * 5000")} END AS discussion,
  CASE WHEN hv AND views > 0 AND hr THEN {_clamp("reposts / greatest(views, 1.0) * 5000")} END AS reshare,
  CASE WHEN hv AND views > 0 THEN {_clamp("100.0 * ln(1 + views / greatest(age / 60.0, 1.0::DOUBLE / 60)) / ln(50001.0::DOUBLE)")} END AS velocity,
  CASE WHEN sources > 0 THEN {_clamp("100.0 * (1.0 - exp(-(sources - 1) / 2.0::DOUBLE))")} END AS cross_source_spread
  FROM sig)"""
TOTAL = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w} ELSE 0 END" for n, w in M.WEIGHTS.items())
MEAN = "(" + " + ".join(f"coalesce({n} * {w}::DOUBLE, 0)" for n, w in M.WEIGHTS.items()) + f") / ({TOTAL})::DOUBLE"


def scored(spark, sf_dir: str) -> tuple[DataFrame, dict]:
    stats = topics.stats(event_posts(spark, sf_dir), "topic")
    t = F.col("topic")
    locality = M.local_relevance(t % 5 == 0, t % 5 == 1, t % 5 == 2)
    impact = F.when(t % 4 == 0, 85.0).otherwise(20.0)
    aged = stats.withColumn("age", topics.age_minutes(F.lit(NOW)))
    parts = topics.components(F.col("age"), locality, impact)
    named = aged.select("*", *[v.alias(n) for n, v in parts.items()])
    return named, {n: F.col(n) for n in parts}


@query(f"WITH {STATS} SELECT topic, views, likes, comments, reposts, newest, posts, sources FROM stats")
def topic_stats(spark, sf_dir: str) -> DataFrame:
    """Sums, newest time, posts and sources of each topic."""
    return topics.stats(event_posts(spark, sf_dir), "topic").select(
        "topic", "views", "likes", "comments", "reposts", "newest", "posts", "sources"
    )


@query(f"""WITH {SIGNALS}, m AS (SELECT *, round({MEAN}, 6) AS mean,
  topic % 3 = 0 AND (views >= 5000 OR reposts >= 10 OR posts >= 3 OR sources >= 3) AS viral FROM parts),
s AS (SELECT *, round(least(100.0, round(mean, 1) + CASE WHEN viral THEN 8.0 ELSE 0.0 END), 1) AS priority_score FROM m)
SELECT topic, mean, viral, priority_score, CASE WHEN priority_score >= 70 THEN 'high' WHEN priority_score >= 45 THEN 'medium'
  ELSE 'low' END AS label, CASE WHEN priority_score >= 45 THEN 'take_now' ELSE 'reject' END AS status,
  round(reach, 6) AS reach, round(engagement, 6) AS engagement, round(discussion, 6) AS discussion,
  round(reshare, 6) AS reshare, round(velocity, 6) AS velocity, round(cross_source_spread, 6) AS spread FROM s""")
def topic_priority(spark, sf_dir: str) -> DataFrame:
    """The NULL-aware weighted score of each topic, the complaints' bonus, label and decision."""
    named, parts = scored(spark, sf_dir)
    mean = F.round(M.weighted_mean(parts), 6)
    viral = M.viral_complaint(F.col("topic") % 3 == 0, F.col("views"), F.col("reposts"), F.col("posts"), F.col("sources"))
    rows = named.withColumn("mean", mean).withColumn("viral", viral)
    bonus = F.when(F.col("viral"), 8.0).otherwise(0.0)
    rows = rows.withColumn("priority_score", F.round(F.least(F.lit(100.0), F.round("mean", 1) + bonus), 1))
    shown = {"reach": "reach", "engagement": "engagement", "discussion": "discussion", "reshare": "reshare"}
    shown |= {"velocity": "velocity", "cross_source_spread": "spread"}
    score = F.col("priority_score")
    return rows.select(
        "topic", "mean", "viral", "priority_score", M.priority(score).alias("label"),
        topics.action(score)["status"].alias("status"), *[F.round(n, 6).alias(a) for n, a in shown.items()],
    )


@query(f"""WITH {SIGNALS}, t AS (SELECT *, {TOTAL} AS total FROM parts), u AS (
{" UNION ALL ".join(f"SELECT topic, '{n}' AS component, round({w} / total::DOUBLE, 4) AS weight FROM t WHERE {n} IS NOT NULL" for n, w in M.WEIGHTS.items())})
SELECT topic, component, weight FROM u""")
def score_weights(spark, sf_dir: str) -> DataFrame:
    """The effective weight of each component that a topic has."""
    named, parts = scored(spark, sf_dir)
    return named.select("topic", F.explode(M.effective_weights(parts)).alias("component", "weight"))


@query(f"""WITH {STATS} SELECT topic, array_to_string(list_sort(list_filter([CASE WHEN hv THEN 'views' END, CASE WHEN hl THEN 'likes' END,
  CASE WHEN hc THEN 'comments' END, CASE WHEN hr THEN 'reposts' END], lambda x: x IS NOT NULL)), ',') AS measured,
  round((hv::INT + hl::INT + hc::INT + hr::INT) / 4.0::DOUBLE, 2) AS ratio FROM stats""")
def metric_coverage(spark, sf_dir: str) -> DataFrame:
    """Which counters a topic's posts carry."""
    stats = topics.stats(event_posts(spark, sf_dir), "topic")
    found = M.coverage(topics.has_columns())
    return stats.select("topic", F.array_join(found, ",").alias("measured"), F.round(F.size(found) / 4.0, 2).alias("ratio"))


@query("""SELECT (ts + INTERVAL 6 HOURS)::DATE AS day, event_type, count(*) AS posts FROM events GROUP BY ALL""")
def civil_day_counts(spark, sf_dir: str) -> DataFrame:
    """Posts by civil day at UTC+6 and type."""
    events = read(spark, sf_dir, "events")
    return events.groupBy(F.to_date(civil(F.col("ts"))).alias("day"), "event_type").agg(F.count("*").alias("posts"))


@query("""SELECT event_id, user_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-14 18:00:00' AND ts < TIMESTAMP '2024-01-15 18:00:00'""")
def day_filter(spark, sf_dir: str) -> DataFrame:
    """Posts of the civil day 2024-01-15, as a range that reaches the scan."""
    return posts.of_day(read(spark, sf_dir, "events"), "2024-01-15", timestamp="ts").select("event_id", "user_id", "event_type")


@query(f"""WITH {POSTS}, n AS (SELECT topic, max(timestamp) AS now FROM posts GROUP BY topic)
SELECT topic, count(DISTINCT CASE WHEN now - timestamp BETWEEN 0 AND 1800 THEN source END) AS recent_sources
FROM posts JOIN n USING (topic) GROUP BY topic""")
def recent_sources(spark, sf_dir: str) -> DataFrame:
    """Sources within the half hour before each topic's newest post."""
    rows = event_posts(spark, sf_dir)
    now = rows.groupBy("topic").agg(F.max("timestamp").alias("now"))
    return rank.recent_sources(rows.join(now, "topic"), "topic", F.col("now"))


@query(f"""WITH {SIGNALS}, r AS (SELECT topic, count(DISTINCT CASE WHEN {NOW} - timestamp BETWEEN 0 AND 1800 THEN source END) AS recent_sources
  FROM posts GROUP BY topic),
j AS (SELECT p.topic, recent_sources, sources, round({MEAN}, 6) AS priority_score,
  (topic % 97)::DOUBLE AS g, (topic % 89)::DOUBLE AS z, topic % 60 AS ng, topic % 45 + 20 AS nz FROM parts p JOIN r USING (topic)
  WHERE {NOW} - newest BETWEEN 0 AND 10800),
m AS (SELECT *, CASE WHEN ng >= 30 THEN g END AS ug, CASE WHEN nz >= 30 THEN z END AS uz FROM j),
b AS (SELECT *, greatest(ug, uz) AS model_score, CASE WHEN abs(ug - uz) < 0.05 THEN 'G/Z' WHEN ug = greatest(ug, uz) THEN 'G'
  ELSE 'Z' END AS audience FROM m WHERE ug IS NOT NULL OR uz IS NOT NULL)
SELECT topic, recent_sources, sources, model_score, audience, priority_score,
  row_number() OVER (ORDER BY recent_sources >= 3 DESC, recent_sources DESC, sources DESC, model_score DESC, priority_score DESC, topic)::INT AS rank
FROM b ORDER BY rank LIMIT 10""")
def ranked_candidates(spark, sf_dir: str) -> DataFrame:
    """The ten topics that rank first among the fresh ones with a usable audience model."""
    named, parts = scored(spark, sf_dir)
    fresh = named.where(rank.is_fresh(F.col("newest"), F.lit(NOW)))
    recent = rank.recent_sources(event_posts(spark, sf_dir), "topic", F.lit(NOW))
    t = F.col("topic")
    models = {"G": ((t % 97).cast("double"), t % 60), "Z": ((t % 89).cast("double"), t % 45 + 20)}
    rows = fresh.join(recent, "topic").select(
        "topic", "recent_sources", "sources", rank.strongest(models).alias("m"), F.round(M.weighted_mean(parts), 6).alias("priority_score")
    )
    rows = rows.where("m is not null").select("*", F.col("m.score").alias("model_score"), F.col("m.label").alias("audience"))
    return rank.ranked(rows.drop("m"), "topic")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def keep_last(spark, sf_dir: str) -> DataFrame:
    """The last post of each key."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return posts.latest(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH seen AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-05'),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events e
  WHERE ts >= TIMESTAMP '2024-01-05' AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = e.user_id AND s.event_type = e.event_type))
SELECT user_id, event_type, event_id FROM f WHERE n = 1""")
def unseen_posts(spark, sf_dir: str) -> DataFrame:
    """First posts of keys that the first days didn't have."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    cut = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    seen = events.where(F.col("ts") < cut)
    return posts.unseen(events.where(F.col("ts") >= cut), seen, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH d AS (SELECT event_type AS audience, user_id AS post_id, (ts + INTERVAL 6 HOURS)::DATE AS poll FROM events),
s AS (SELECT audience, post_id, min(poll) AS poll FROM d GROUP BY ALL), b AS (SELECT audience, min(poll) AS start FROM d GROUP BY ALL)
SELECT audience, post_id, poll FROM s JOIN b USING (audience) WHERE poll > start""")
def first_seen(spark, sf_dir: str) -> DataFrame:
    """Posts first seen after an audience's first poll, which only marks what is there."""
    events = read(spark, sf_dir, "events")
    polls = events.select(F.col("event_type").alias("audience"), F.col("user_id").alias("post_id"), F.to_date(civil(F.col("ts"))).alias("poll"))
    return tracker.first_seen(polls, "audience", "post_id", "poll")


GATHERED = """o AS (SELECT event_type AS audience, min(floor(epoch(ts))::BIGINT) AS predicted_at, list_sort(list_distinct(list(event_id))) AS ids
  FROM events GROUP BY event_type, user_id, ts::DATE),
o2 AS (SELECT sha256(audience || '|[' || array_to_string(ids, ',') || ']') AS observation_id, * FROM o)"""


def gathered(events: DataFrame) -> DataFrame:
    """An observation of each audience and user-day, with all its events as members."""
    rows = events.groupBy(F.col("event_type").alias("audience"), "user_id", F.to_date("ts")).agg(
        F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("predicted_at"), F.array_sort(F.collect_set("event_id")).alias("member_ids")
    )
    return rows.select("audience", "predicted_at", "member_ids", tracker.observation_id(F.col("audience"), F.col("member_ids")).alias("observation_id"))


@query(f"""WITH {GATHERED} SELECT observation_id, audience, predicted_at, len(ids)::INT AS members FROM o2""")
def observation_ids(spark, sf_dir: str) -> DataFrame:
    """Observations of all events, by the digest of audience and members."""
    rows = gathered(read(spark, sf_dir, "events"))
    return rows.select("observation_id", "audience", "predicted_at", F.size("member_ids").alias("members"))


@query(f"""WITH {GATHERED}, h AS (SELECT *, unnest([1, 3]) AS hours FROM o2),
p AS (SELECT observation_id, audience, hours, predicted_at + hours * 3600 AS due, len(ids) AS expected, unnest(ids) AS post_id FROM h),
s AS (SELECT event_type AS audience, event_id AS post_id, ((floor(epoch(ts))::BIGINT + late) // 300) * 300 AS snap_ts, count(*) * 400 AS views,
  sum(event_id % 5)::BIGINT AS likes, sum(event_id % 3)::BIGINT AS comments, sum(event_id % 2)::BIGINT AS reposts
  FROM (SELECT *, unnest([0, 3900, 11100]) AS late FROM events) GROUP BY ALL),
w AS (SELECT observation_id, hours, snap_ts, expected, count(DISTINCT post_id) AS found, sum(views) AS views, sum(likes) AS likes,
  sum(comments) AS comments, sum(reposts) AS reposts FROM p JOIN s USING (audience, post_id)
  WHERE snap_ts BETWEEN due AND due + 600 AND snap_ts <= {NOW} GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observation_id, hours ORDER BY snap_ts) AS n FROM w WHERE found = expected) WHERE n = 1)
SELECT h.observation_id, h.predicted_at, h.hours, f.snap_ts AS measured_at, f.views::BIGINT AS views,
  round((likes + 2 * comments + 4 * reposts) / greatest(views, 1)::DOUBLE, 6) AS score,
  CASE WHEN f.snap_ts IS NOT NULL THEN 'completed' WHEN {NOW} > predicted_at + h.hours * 3600 + 600 THEN 'missed' ELSE 'pending' END AS state
FROM h LEFT JOIN f ON f.observation_id = h.observation_id AND f.hours = h.hours""")
def checkpoints(spark, sf_dir: str) -> DataFrame:
    """States of the checkpoints of all observations; an event is seen at once and after each hour."""
    events = read(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id")
    late = F.explode(F.array(F.lit(0), F.lit(3900), F.lit(11100)))
    seen = events.select("*", late.alias("late")).withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("late"))
    snaps = seen.groupBy(
        F.col("event_type").alias("audience"), F.col("event_id").alias("post_id"), (F.floor(F.col("at") / 300) * 300).alias("snap_ts")
    ).agg(
        (F.count("*") * 400).alias("views"),
        *[F.sum(F.col("event_id") % n).alias(c) for c, n in (("likes", 5), ("comments", 3), ("reposts", 2))],
    )
    found = tracker.checkpoints(gathered(events), snaps, F.lit(NOW))
    return found.select("observation_id", "predicted_at", "hours", "measured_at", "views", F.round("score", 6).alias("score"), "state")


@query(f"""WITH {STATS}, a AS (SELECT *, greatest(0.25::DOUBLE, ({NOW} - newest) / 3600.0::DOUBLE) AS hours, topic % 41 AS hook,
  CASE WHEN topic % 5 = 0 THEN 0.0 WHEN topic % 5 = 1 THEN 100.0 ELSE 30.0 END::DOUBLE AS locality, ({NOW} - newest) / 60.0::DOUBLE AS age FROM stats),
e AS (SELECT *, least(100.0, least(100.0, views / hours / 250 * 100) * 0.45 + least(100.0, (likes + 2 * comments + 4 * reposts) / greatest(views, 1.0) * 1000) * 0.25
  + least(100.0, comments / greatest(views, 1.0) * 2500) * 0.15 + least(100.0, reposts / greatest(views, 1.0) * 5000) * 0.15) AS early FROM a),
v AS (SELECT *, round(least(100.0, early * 0.65 + hook * 0.35), 1) AS viral FROM e),
d AS (SELECT *, locality * 0.6 + viral * 0.4 AS editorial FROM v),
b AS (SELECT *, round(viral * 0.5 + editorial * 0.5, 1) AS base, round(greatest(0.0, 100.0 * (1 - age / 180)), 1) AS recency FROM d),
s AS (SELECT *, round(base * 0.72 + recency * 0.28, 1) AS score FROM b)
SELECT topic, viral, round(editorial, 6) AS editorial, base, recency, score, CASE WHEN topic % 3 = 0 THEN CASE WHEN viral >= 60 OR views >= 5000 OR reposts >= 10 OR posts >= 3 THEN 'take_now' ELSE 'reject' END
  WHEN topic % 11 = 0 THEN 'reject' WHEN viral >= 60 AND topic % 7 = 0 THEN 'take_now'
  WHEN score >= 45 THEN 'take_now' ELSE 'reject' END AS status, CASE WHEN topic % 3 = 0 THEN CASE WHEN viral >= 60 OR views >= 5000 OR reposts >= 10 OR posts >= 3 THEN 'viral_complaint' ELSE 'complaint' END
  WHEN topic % 11 = 0 THEN 'nonlocal' WHEN viral >= 60 AND topic % 7 = 0 THEN 'signal'
  WHEN score >= 45 THEN 'score' ELSE 'low_priority' END AS reason FROM s""")
def analyser_scores(spark, sf_dir: str) -> DataFrame:
    """The first stage's scores and decision of each topic."""
    stats = topics.stats(event_posts(spark, sf_dir), "topic")
    t = F.col("topic")
    hours = M.age_hours(F.col("newest"), F.lit(NOW))
    early = M.early_signal(*[F.col(c) for c in posts.COUNTERS], hours)
    locality = F.when(t % 5 == 0, 0.0).when(t % 5 == 1, 100.0).otherwise(30.0)
    rows = stats.withColumn("viral", M.viral(early, t % 41))
    editorial, base, recency, score = M.analyser_score(F.col("viral"), locality, topics.age_minutes(F.lit(NOW)))
    counters = ["views", "reposts", "posts"]
    rows = rows.select("topic", "viral", *counters, M.rounded(editorial, 6).alias("editorial"), base.alias("base"), recency.alias("recency"), score.alias("score"))
    confidence = F.when(t % 7 == 0, 20).otherwise(90)
    signal = complaint_signal(t % 3 == 0, F.col("viral"), F.col("views"), F.col("reposts"), F.col("posts"))
    rows = rows.withColumn("signal", signal)
    decided = editorial_status(
        viral_complaint=F.col("signal"), complaint_only=t % 3 == 0, nonlocal_only=t % 11 == 0, confidence=confidence,
        viral=F.col("viral"), score=F.col("score"),
    )
    return rows.withColumn("d", decided).select("*", "d.status", "d.reason").drop("d", "signal", *counters)


@query(f"""WITH {SIGNALS}, p AS (SELECT {MEAN} AS s FROM parts)
SELECT count(*) AS n, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.9), 6) AS p90,
  round(quantile_cont(s, 0.95), 6) AS p95, round(quantile_cont(s, 0.99), 6) AS p99, round(max(s), 6) AS max, count(*) FILTER (s >= 90) AS n90,
  count(*) FILTER (s >= 95) AS n95, count(*) FILTER (s >= 99) AS n99, count(*) FILTER (abs(s - 100) < 1e-9) AS n100,
  CASE WHEN count(*) FILTER (s >= 95) / count(*)::DOUBLE >= 0.1 THEN 'high' WHEN count(*) FILTER (s >= 95) / count(*)::DOUBLE >= 0.05 THEN 'medium'
  ELSE 'ok' END AS saturation FROM p""")
def score_distribution(spark, sf_dir: str) -> DataFrame:
    """The distribution of the topics' scores."""
    named, parts = scored(spark, sf_dir)
    found = diagnostics.distribution(named.select(M.weighted_mean(parts).alias("s")), "s")
    rounded = ("mean", "median", "p90", "p95", "p99", "max")
    return found.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in found.columns])


@query(f"""WITH {SIGNALS}, w AS (SELECT topic, list_filter([CASE WHEN views < 500 THEN 'LOW_VIEWS' END,
  CASE WHEN views < 1000 AND comments >= 5 THEN 'SMALL_SAMPLE' END, CASE WHEN {MEAN} >= 99 THEN 'SCORE_NEAR_CAP' END,
  CASE WHEN views > 0 AND (likes + 2 * comments + 4 * reposts) / greatest(views, 1.0) * 1000 >= 100 THEN 'ENGAGEMENT_CAP' END,
  CASE WHEN views > 0 AND comments / greatest(views, 1.0) * 2500 >= 100 THEN 'DISCUSSION_CAP' END,
  CASE WHEN views > 0 AND reposts / greatest(views, 1.0) * 5000 >= 100 THEN 'SPREAD_CAP' END], lambda x: x IS NOT NULL) AS w,
  CASE WHEN topic % 13 = 0 THEN 'needs_confirmation' WHEN {MEAN} >= 45 THEN 'in_work' ELSE 'low_priority' END AS label FROM parts)
SELECT topic, array_to_string(w, ',') AS warnings, label FROM w""")
def score_warnings(spark, sf_dir: str) -> DataFrame:
    """What makes each topic's score doubtful, and its label."""
    named, parts = scored(spark, sf_dir)
    score = M.weighted_mean(parts)
    found = diagnostics.warnings(score, *[F.col(c) for c in posts.COUNTERS])
    return named.select(
        "topic", F.array_join(found, ",").alias("warnings"), diagnostics.label(score, F.col("topic") % 13 == 0).alias("label")
    )


@query(f"""WITH {SIGNALS}, p AS (SELECT topic, round({MEAN}, 6) AS priority, CASE WHEN topic % 4 <> 0 THEN (topic % 100)::DOUBLE END AS score FROM parts)
SELECT topic, priority, score, round(priority - score, 6) AS gap FROM p WHERE score IS NOT NULL ORDER BY priority - score DESC, topic LIMIT 5""")
def score_mismatches(spark, sf_dir: str) -> DataFrame:
    """Topics whose second score exceeds the first by most."""
    named, parts = scored(spark, sf_dir)
    first = F.when(F.col("topic") % 4 != 0, (F.col("topic") % 100).cast("double"))
    rows = named.select("topic", F.round(M.weighted_mean(parts), 6).alias("priority"), first.alias("score"))
    return diagnostics.mismatches(rows, "priority", "score", "topic").withColumn("gap", F.round("gap", 6))


@query(f"""WITH {SIGNALS}, p AS (SELECT CASE WHEN {MEAN} >= 45 THEN 'take_now' ELSE 'reject' END AS status, posts FROM parts)
SELECT status, count(*) AS topics, sum(posts)::BIGINT AS posts FROM p GROUP BY status""")
def queue_counts(spark, sf_dir: str) -> DataFrame:
    """Topics and posts by decision."""
    named, parts = scored(spark, sf_dir)
    rows = named.select(topics.action(M.weighted_mean(parts))["status"].alias("status"), "posts")
    return rows.groupBy("status").agg(F.count("*").alias("topics"), F.sum("posts").alias("posts"))


@query("""SELECT count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
  count(*) FILTER (event_type = 'error') > count(*) FILTER (event_type <> 'error') AS incomplete FROM events""")
def cycle_state(spark, sf_dir: str) -> DataFrame:
    """Whether a polling cycle was complete."""
    return diagnostics.cycle_state(read(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok")))


@query(f"""WITH {POSTS}, s AS (SELECT topic, sum(views) AS v, sum(likes) AS l, count(*) AS n FROM posts GROUP BY topic),
x AS (SELECT topic, topic % 2 AS audience, coalesce(v, 0) + topic % 7 AS a, coalesce(l, 0) * 10 + topic % 11 AS b FROM s),
r AS (SELECT audience, row_number() OVER (PARTITION BY audience ORDER BY a, topic)::DOUBLE AS ra,
  row_number() OVER (PARTITION BY audience ORDER BY b, topic)::DOUBLE AS rb FROM x)
SELECT audience, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY audience""")
def rank_correlation(spark, sf_dir: str) -> DataFrame:
    """Spearman's correlation by ordinal ranks, by audience."""
    stats = topics.stats(event_posts(spark, sf_dir), "topic")
    t = F.col("topic")
    rows = stats.select("topic", (t % 2).alias("audience"), (F.col("views") + t % 7).alias("a"), (F.col("likes") * 10 + t % 11).alias("b"))
    return model.spearman(rows, "a", "b", "topic", ["audience"]).withColumn("spearman", F.round("spearman", 6))
