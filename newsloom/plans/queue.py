"""Queries over queues, deliveries and records: what collects, orders and hands out topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import metrics as M
from newsloom.functions import text as X
from newsloom.functions.packs import CORPUS
from newsloom.functions.text import civil
from newsloom.operators import delivery, diagnostics, lookups, model, posts, rank, registry, topics, tracker
from newsloom.operators.classify import is_excluded, is_promotional
from newsloom.plans import documents as D
from newsloom.plans import events as E
from newsloom.plans.registry import SQL, query, read
from newsloom.sources import documents, feeds

P = CORPUS
NOW = E.NOW


# Orders and display lists


@query(f"SELECT topic, score, row_number() OVER (ORDER BY score DESC, topic) AS place FROM ({SQL['analyser_scores']})")
def topics_by_score(spark, sf_dir: str) -> DataFrame:
    """The first stage's topics in the order of their score, then of their creation."""
    rows = E.analyser_scores(spark, sf_dir).select("topic", "score")
    return rank.in_order(rows, F.desc("score"), F.asc("topic"))


@query(f"SELECT topic, priority_score, row_number() OVER (ORDER BY priority_score DESC, topic) AS place FROM ({SQL['topic_priority']})")
def queue_by_priority(spark, sf_dir: str) -> DataFrame:
    """The queue in the order of the priority."""
    rows = E.topic_priority(spark, sf_dir).select("topic", "priority_score")
    return rank.in_order(rows, F.desc("priority_score"), F.asc("topic"))


@query("""WITH k AS (SELECT user_id, event_type, max((ts, event_id)) AS last FROM events GROUP BY ALL)
SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events e
WHERE EXISTS (SELECT 1 FROM k WHERE k.user_id = e.user_id AND k.event_type = e.event_type AND k.last = (e.ts, e.event_id))""")
def posts_by_time(spark, sf_dir: str) -> DataFrame:
    """The last post of each key, newest first."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    last = posts.latest(rows, ["user_id", "event_type"], ["ts", "event_id"])
    return rank.in_order(last, F.desc("ts"), F.desc("event_id")).select("event_id", "place")


@query(f"""WITH o AS (SELECT observation_id, min(predicted_at) AS predicted_at FROM ({SQL['checkpoints']}) WHERE state <> 'completed' GROUP BY ALL)
SELECT observation_id, predicted_at, row_number() OVER (ORDER BY predicted_at, observation_id) AS place FROM o""")
def due_observations(spark, sf_dir: str) -> DataFrame:
    """Observations with an hour that isn't completed, in the order of their time."""
    rows = E.checkpoints(spark, sf_dir).where("state <> 'completed'")
    rows = rows.groupBy("observation_id").agg(F.min("predicted_at").alias("predicted_at"))
    return rank.in_order(rows, F.asc("predicted_at"), F.asc("observation_id"))


@query(f"""WITH p AS (SELECT topic, priority_score FROM ({SQL['topic_priority']})), s AS (SELECT topic, score FROM ({SQL['analyser_scores']}))
SELECT 'recommended' AS list, row_number() OVER (ORDER BY priority_score DESC, topic)::INT AS place, topic FROM p QUALIFY place <= 5
UNION ALL SELECT 'breakdown', row_number() OVER (ORDER BY score DESC, topic)::INT AS place, topic FROM s QUALIFY place <= 20
UNION ALL SELECT 'excluded', row_number() OVER (ORDER BY topic)::INT AS place, topic FROM p WHERE topic % 13 = 0 QUALIFY place <= 10""")
def display_lists(spark, sf_dir: str) -> DataFrame:
    """What the tools show: five recommendations, twenty scores, ten excluded topics."""
    priority = E.topic_priority(spark, sf_dir).select("topic", "priority_score")
    score = E.analyser_scores(spark, sf_dir).select("topic", "score")
    first = rank.top(priority, [F.desc("priority_score"), F.asc("topic")], 5, "recommended")
    second = rank.top(score, [F.desc("score"), F.asc("topic")], 20, "breakdown")
    third = rank.top(priority.where("topic % 13 = 0"), [F.asc("topic")], 10, "excluded")
    every = [x.select("list", "place", "topic") for x in (first, second, third)]
    return every[0].union(every[1]).union(every[2])


@query("""WITH u AS (SELECT 0 AS g, doc_id AS id FROM documents UNION ALL SELECT 1, page_id FROM pages UNION ALL SELECT 2, item_id FROM benchmark)
SELECT CASE g WHEN 0 THEN 'documents' WHEN 1 THEN 'pages' ELSE 'benchmark' END AS source, id, row_number() OVER (ORDER BY g, id) AS place FROM u""")
def ordered_union(spark, sf_dir: str) -> DataFrame:
    """Posts of all groups in the groups' order."""
    parts = (("documents", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id"))
    made = [read(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(k).alias("id")) for t, k in parts]
    return posts.in_order(made, "id")


@query(f"""WITH {E.SIGNALS}, r AS (SELECT topic, count(DISTINCT CASE WHEN {NOW} - timestamp BETWEEN 0 AND 1800 THEN source END) AS recent_sources
  FROM posts GROUP BY topic),
j AS (SELECT p.topic, recent_sources, sources, round({E.MEAN}, 6) AS priority_score, (topic % 97)::DOUBLE AS g, topic % 60 AS ng
  FROM parts p JOIN r USING (topic) WHERE {NOW} - newest BETWEEN 0 AND 10800 AND topic % 7 <> 0 AND topic % 3 <> 0)
SELECT topic, recent_sources, sources, g AS model_score, priority_score,
  row_number() OVER (ORDER BY recent_sources >= 3 DESC, recent_sources DESC, sources DESC, g DESC, priority_score DESC, topic)::INT AS rank
FROM j WHERE ng >= 30 ORDER BY rank LIMIT 10""")
def console_candidates(spark, sf_dir: str) -> DataFrame:
    """The console's ten candidates: the newest time is of the members, no rule looks at texts."""
    t = F.col("topic")
    rows = E.event_posts(spark, sf_dir)
    members = topics.gathered(rows, "topic", "timestamp", F.struct("timestamp"))
    newest = members.select("topic", topics.newest_of(F.col("members")).alias("newest_member"))
    named, parts = E.scored(spark, sf_dir)
    chosen = rank.strongest({"G": ((t % 97).cast("double"), t % 60)})
    fresh = named.join(newest, "topic").where(rank.is_fresh(F.col("newest_member"), F.lit(NOW)) & (t % 7 != 0) & (t % 3 != 0))
    fresh = fresh.join(rank.recent_sources(rows, "topic", F.lit(NOW)), "topic").select(
        "topic", "recent_sources", "sources", chosen["score"].alias("model_score"), F.round(M.weighted_mean(parts), 6).alias("priority_score")
    )
    return rank.ranked(fresh.where("model_score is not null"), "topic")


# Topics and their members


@query(f"""WITH m AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || role || '  Turn ' || turn || CASE WHEN turn % 2 = 0 THEN ' Post ' || turn || ' ' || role || '  ' ELSE '' END AS m FROM conversations),
t AS (SELECT conv_id, lower(coalesce(arg_min(text, turn), '') || ' ' || CASE WHEN conv_id % 2 = 0 THEN 'Title ' || conv_id ELSE '' END || '  '
  || CASE WHEN conv_id % 3 = 0 THEN 'Sum ' || conv_id ELSE '' END || ' ' || CASE WHEN conv_id % 5 = 0 THEN '{P.promo[0]}' WHEN conv_id % 5 = 1 THEN '{P.excluded[0]}' ELSE '' END
  || ' ' || (SELECT string_agg(m, ' ' ORDER BY turn) FROM m WHERE m.conv_id = c.conv_id)) AS t FROM conversations c GROUP BY conv_id)
SELECT conv_id, md5(t) AS digest, {D._any(P.excluded)} AS excluded, {D._any(P.promo)} OR {D._pattern(P.promo_patterns)} AS promotional FROM t""")
def topic_texts(spark, sf_dir: str) -> DataFrame:
    """All texts of each topic, of its members and of the posts in them, and what rules say of them."""
    c, none = F.col("conv_id"), F.lit(None).cast("string")
    turn = F.col("turn").cast("string")
    post = F.when(
        F.col("turn") % 2 == 0,
        F.struct(F.concat(F.lit("Post "), turn).alias("text"), F.col("role").alias("title"), none.alias("headline"), none.alias("summary")),
    )
    member = F.struct("text", F.col("role").alias("title"), none.alias("headline"), F.concat(F.lit("Turn "), turn).alias("summary"), post.alias("post"))
    nested = topics.gathered(read(spark, sf_dir, "conversations"), "conv_id", "turn", member)
    named = lambda n, word: F.when(c % n == 0, F.concat(F.lit(word), c.cast("string")))
    rows = nested.select(
        "conv_id", "members", F.col("members")[0]["text"].alias("text"), named(2, "Title ").alias("title"), named(3, "Sum ").alias("summary"),
        F.when(c % 5 == 0, P.promo[0]).when(c % 5 == 1, P.excluded[0]).alias("description"),
    )
    rows = rows.select("conv_id", delivery.topic_text(rows.schema).alias("t"))
    t = F.col("t")
    return rows.select("conv_id", F.md5("t").alias("digest"), is_excluded(t, P).alias("excluded"), is_promotional(t, P).alias("promotional"))


@query("""SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN 'own ' || role ELSE role END, ',' ORDER BY turn) AS roles, sum(turn)::BIGINT AS turns
FROM conversations GROUP BY conv_id""")
def member_posts(spark, sf_dir: str) -> DataFrame:
    """The posts that members hold, or are."""
    post = F.when(F.col("turn") % 2 == 0, F.struct(F.concat(F.lit("own "), "role").alias("role"), F.col("turn").alias("turn")))
    nested = topics.gathered(read(spark, sf_dir, "conversations"), "conv_id", "turn", F.struct("role", "turn", post.alias("post")))
    own = topics.unwrapped(F.col("members"), nested.schema["members"].dataType)
    rows = nested.select("conv_id", own.alias("posts"))
    turns = F.aggregate("posts", F.lit(0).cast("long"), lambda total, m: total + m["turn"])
    return rows.select("conv_id", F.array_join(F.transform("posts", lambda m: m["role"]), ",").alias("roles"), turns.alias("turns"))


@query("""SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN 'http://c/' || conv_id || '/' || turn END, ' ' ORDER BY turn), '') AS urls,
count(*) FILTER (coalesce(text, '') <> '')::INT AS texts, md5(coalesce(string_agg(nullif(text, ''), chr(10) ORDER BY turn), '')) AS digest FROM conversations GROUP BY conv_id""")
def topic_lists(spark, sf_dir: str) -> DataFrame:
    """Addresses and texts of each topic's members in order."""
    rows = D.conversation_topics(spark, sf_dir)
    urls, texts = topics.listed(F.col("members"), "url"), topics.listed(F.col("members"), "text")
    return rows.select("conv_id", F.array_join(urls, " ").alias("urls"), F.size(texts).alias("texts"), F.md5(F.array_join(texts, "\n")).alias("digest"))


@query("""WITH t AS (SELECT conv_id, count(*) AS n, min(turn) AS a FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN [conv_id, conv_id + 1] ELSE [conv_id * 10, conv_id * 10 + 1] || CASE WHEN conv_id % 3 = 0 THEN [conv_id * 100] ELSE [] END END AS l FROM t)
SELECT conv_id, unnest(l)::BIGINT AS topic FROM l""")
def legacy_topics(spark, sf_dir: str) -> DataFrame:
    """Topics of queues, or of the buckets of old queues one after the other."""
    c = F.col("conv_id")
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    none = F.lit(None).cast("array<bigint>")
    document = F.struct(
        F.when(c % 2 == 0, F.array(c, c + 1)).alias("topics"), F.array(c * 10).alias("take_now"), F.array(c * 10 + 1).alias("reject"),
        none.alias("unconfirmed_signals"), F.when(c % 3 == 0, F.array(c * 100)).alias("check"), none.alias("watch"),
    )
    return ids.select("conv_id", document.alias("d")).select("conv_id", F.explode(documents.topics_of(F.col("d"))).alias("topic"))


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN nullif(source, '') END, nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'name' END, ''), 'group') AS name,
md5(coalesce(nullif(text, ''), 'no text')) AS digest FROM documents""")
def first_sources(spark, sf_dir: str) -> DataFrame:
    """The first filled of the fields that may name a post's source, and of those that may be its text."""
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", F.when(d % 3 != 0, F.col("source")).alias("source"), F.when(d % 2 == 0, "").otherwise("name").alias("source_name"),
        F.lit("group").alias("group_name"), "text", F.lit("no text").alias("message"),
    )
    return rows.select("doc_id", posts.first_of(rows, posts.SOURCE_KEYS).alias("name"), F.md5(posts.first_of(rows, posts.TEXT_KEYS)).alias("digest"))


@query(rf"""WITH {SQL['topic_messages'].split('WITH ', 1)[1].split('k AS (', 1)[0].rstrip().rstrip(',')}
SELECT conv_id, trim(regexp_replace({D.LINE.replace('text', 'topic_text')}, '\s+', ' ', 'g')) AS title,
  md5(substr(trim(regexp_replace(coalesce(nullif(mtext, ''), topic_text, ''), '\s+', ' ', 'g')), 1, 900)) AS story_md5 FROM c""")
def story_records(spark, sf_dir: str) -> DataFrame:
    """By what a topic is recognised later."""
    made = D.conversation_topics(spark, sf_dir).select("conv_id", delivery.story().alias("s"))
    return made.select("conv_id", "s.title", F.md5("s.story").alias("story_md5"))


# Counters, diagnostics and texts


@query(f"""WITH {E.STATS}, s AS (SELECT *, topic % 2 = 0 AND (likes <> 0 OR comments <> 0) OR topic % 11 = 0 AS own FROM stats)
SELECT topic, CASE WHEN own THEN views ELSE views * 2 END AS views, CASE WHEN own THEN CASE WHEN topic % 2 = 0 THEN likes ELSE 0 END ELSE likes * 2 END AS likes,
  CASE WHEN own THEN CASE WHEN topic % 2 = 0 THEN comments ELSE 0 END ELSE comments * 2 END AS comments, CASE WHEN own THEN reposts ELSE reposts * 2 END AS reposts FROM s""")
def shown_counters(spark, sf_dir: str) -> DataFrame:
    """The counters that the diagnostics show: the topic's own, or its members' sums."""
    rows = topics.stats(E.event_posts(spark, sf_dir), "topic")
    even = F.col("topic") % 2 == 0
    own = {c: F.col(c) if c in ("views", "reposts") else F.when(even, F.col(c)).otherwise(0.0) for c in posts.COUNTERS}
    members = F.when(F.col("topic") % 11 == 0, 0).otherwise(F.col("posts"))
    found = diagnostics.shown_stats(own, {c: F.col(c) * 2 for c in posts.COUNTERS}, members)
    return rows.select("topic", *[v.alias(c) for c, v in found.items()])


@query(f"""WITH n AS (SELECT doc_id, {D.NORM.format("coalesce(text, '')")} AS t, length(coalesce(text, '')) AS len FROM documents),
s AS (SELECT *, {D._any(P.shown_excluded)} AS excluded, {D._any(P.shown_promo)} AS promo,
  CASE doc_id % 4 WHEN 0 THEN len WHEN 1 THEN len + 1 WHEN 2 THEN doc_id END::DOUBLE AS score FROM n)
SELECT doc_id, score, concat_ws(',', CASE WHEN excluded THEN 'EXCLUDED_TOPIC' END, CASE WHEN promo THEN 'PROMO' END, CASE WHEN len < 500 THEN 'LOW_VIEWS' END,
  CASE WHEN len < 1000 AND doc_id % 7 >= 5 THEN 'SMALL_SAMPLE' END, CASE WHEN score >= 99 THEN 'SCORE_NEAR_CAP' END,
  CASE WHEN len > 0 AND 2 * (doc_id % 7) / greatest(len, 1)::DOUBLE * 1000 >= 100 THEN 'ENGAGEMENT_CAP' END,
  CASE WHEN len > 0 AND (doc_id % 7) / greatest(len, 1)::DOUBLE * 2500 >= 100 THEN 'DISCUSSION_CAP' END) AS warnings FROM s""")
def text_warnings(spark, sf_dir: str) -> DataFrame:
    """The diagnostics' warnings with their own lists, of records whose score is theirs, their
    prediction's, or missing."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d, size = F.col("doc_id"), F.length("text").cast("string")
    json = (
        F.when(d % 4 == 0, F.concat(F.lit('{"priority_score": '), size, F.lit(', "score": 1}')))
        .when(d % 4 == 1, F.concat(F.lit('{"priority_score": "7", "prediction": {"priority_score": '), (F.length("text") + 1).cast("string"), F.lit("}}")))
        .when(d % 4 == 2, F.concat(F.lit('{"score": '), d.cast("string"), F.lit("}")))
        .otherwise("{}")
    )
    rows = rows.withColumn("record", F.parse_json(json))
    rows = rows.withColumn("score", diagnostics.metric(F.col("record"), "priority_score", "score"))
    excluded, promo = diagnostics.shown(diagnostics.shown_text(F.array("text")), P)
    views, comments = F.length("text").cast("double"), (d % 7).cast("double")
    found = diagnostics.warnings(F.col("score"), views, F.lit(0.0), comments, F.lit(0.0), excluded, promo)
    return rows.select("doc_id", "score", F.array_join(found, ",").alias("warnings"))


@query(f"""WITH p AS (SELECT topic, status FROM ({SQL['topic_priority']})), n AS (SELECT user_id AS topic, count(*) AS posts FROM events GROUP BY ALL)
SELECT sum(posts)::BIGINT AS posts_analyzed, count(*) FILTER (topic % 9 <> 0) AS topic_count, count(*) FILTER (topic % 9 = 0) AS excluded_topics,
  count(*) FILTER (topic % 9 <> 0 AND status = 'take_now') AS take_now, count(*) FILTER (topic % 9 <> 0 AND status = 'reject') AS reject FROM p JOIN n USING (topic)""")
def queue_summary(spark, sf_dir: str) -> DataFrame:
    """Counters of a queue: posts, topics, those left out, and the rest by status."""
    named, parts = E.scored(spark, sf_dir)
    score = E.topic_priority(spark, sf_dir).select("topic", "status")
    rows = named.select("topic", "posts").join(score, "topic").withColumn("eligible", F.col("topic") % 9 != 0)
    return topics.summary(rows, "status", "eligible", "posts")


@query(rf"""WITH l AS (SELECT doc_id, {D.LINE} AS t FROM documents)
SELECT doc_id, array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN c = '' OR unicode(c) < 128 THEN c WHEN unicode(c) < 256 THEN '\x' || lpad(lower(hex(unicode(c))), 2, '0')
  WHEN unicode(c) < 65536 THEN '\u' || lpad(lower(hex(unicode(c))), 4, '0') ELSE '\U' || lpad(lower(hex(unicode(c))), 8, '0') END), '') AS line FROM l""")
def console_lines(spark, sf_dir: str) -> DataFrame:
    """First lines for a console of ASCII alone."""
    return read(spark, sf_dir, "documents").select("doc_id", X.console_safe(X.first_line(F.col("text"))).alias("line"))


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(source) || ' ТВ НОВОСТИ' WHEN 1 THEN source WHEN 2 THEN '  ' || upper(source) || '   OF ' ELSE NULL END AS s FROM documents),
f AS (SELECT doc_id, trim(regexp_replace(coalesce(s, 'Источник'), '\\s+', ' ', 'g')) AS s FROM n)
SELECT doc_id, CASE WHEN upper(s) = s AND lower(s) <> s THEN array_to_string(list_transform(string_split(s, ' '), lambda w: CASE WHEN length(w) <= 3 THEN w
  ELSE upper(w[1]) || lower(w[2:]) END), ' ') ELSE s END AS name FROM f""")
def source_names(spark, sf_dir: str) -> DataFrame:
    """Names of sources as they are shown."""
    d, s = F.col("doc_id"), F.col("source")
    raw = (
        F.when(d % 4 == 0, F.concat(F.upper(s), F.lit(" ТВ НОВОСТИ"))).when(d % 4 == 1, s)
        .when(d % 4 == 2, F.concat(F.lit("  "), F.upper(s), F.lit("   OF ")))
    )
    return read(spark, sf_dir, "documents").select("doc_id", X.shown_source(raw).alias("name"))


# Delivery and feedback


@query("""SELECT event_type, count(*) AS posts FROM events WHERE substr(strftime(ts + INTERVAL 6 HOURS, '%Y-%m-%dT%H:%M:%S+06:00'), 1, 10) = '2024-01-15' GROUP BY ALL""")
def todays_pool(spark, sf_dir: str) -> DataFrame:
    """What was generated on the day, by the time that the pool states."""
    generated = F.concat(F.date_format(civil(F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+06:00"))
    rows = read(spark, sf_dir, "events").where(delivery.of_today(generated, F.lit("2024-01-15")))
    return rows.groupBy("event_type").agg(F.count("*").alias("posts"))


KIND = {"view": "topic", "click": "member", "signup": "story", "purchase": "message", "error": "offset"}


@query(f"""WITH s AS (SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND.items())} END AS kind, user_id AS key, (ts + INTERVAL 6 HOURS)::DATE AS date FROM events)
SELECT kind, key, count(*) AS rows FROM s WHERE kind IN ('offset', 'message') OR date = DATE '2024-01-20' GROUP BY ALL""")
def delivery_state(spark, sf_dir: str) -> DataFrame:
    """What the delivery remembers on a new day."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair]), F.col("event_type"))
    state = read(spark, sf_dir, "events").select(kind.alias("kind"), F.col("user_id").alias("key"), F.to_date(civil(F.col("ts"))).alias("date"))
    kept = delivery.migrated(state, F.lit("2024-01-20").cast("date"))
    return kept.groupBy("kind", "key").agg(F.count("*").alias("rows"))


@query("""WITH t AS (SELECT DISTINCT conv_id FROM conversations), s AS (SELECT 'm' || (conv_id * 3 % 50) AS m FROM t WHERE conv_id % 9 = 0)
SELECT 'k' || conv_id AS key FROM t WHERE conv_id % 4 <> 0 AND 'm' || conv_id NOT IN (SELECT m FROM s) AND 'm' || (conv_id % 50) NOT IN (SELECT m FROM s)""")
def undelivered_topics(spark, sf_dir: str) -> DataFrame:
    """Topics of which neither the key nor a member was sent."""
    name = lambda word, n: F.concat(F.lit(word), n.cast("string"))
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    c = F.col("conv_id")
    rows = ids.select(name("k", c).alias("key"), F.array(name("m", c), name("m", c % 50)).alias("member_keys"))
    sent = ids.where(c % 4 == 0).select(name("k", c).alias("key"))
    return delivery.undelivered(rows, sent, ids.where(c % 9 == 0).select(name("m", c * 3 % 50).alias("key"))).select("key")


UPDATES = """u AS (SELECT conv_id * 100 + turn AS update_id, CASE WHEN conv_id % 7 = 0 THEN 'other' ELSE 'home' END AS chat_id, conv_id % 60 AS message_id,
  CASE (conv_id + turn) % 5 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '/start@bot now' WHEN 3 THEN 'hello' ELSE ' + ' END AS text FROM conversations)"""


def updates(spark, sf_dir: str) -> DataFrame:
    c, turn = F.col("conv_id"), F.col("turn")
    said = F.element_at(F.array(*map(F.lit, ("+", "-", "/start@bot now", "hello", " + "))), ((c + turn) % 5 + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select(
        (c * 100 + turn).alias("update_id"), F.when(c % 7 == 0, "other").otherwise("home").alias("chat_id"), (c % 60).alias("message_id"), said.alias("text")
    )


@query(f"""WITH {UPDATES}, m AS (SELECT u.*, trim(u.text) AS t, chat_id = 'home' AND b.item_id IS NOT NULL AND trim(u.text) IN ('+', '-') AS marks FROM u LEFT JOIN benchmark b ON b.item_id = u.message_id),
e AS (SELECT *, coalesce(bool_or(marks AND t = '+') OVER w, false) AS published, coalesce(bool_or(marks AND t = '-') OVER w, false) AS rejected FROM m
  WINDOW w AS (PARTITION BY chat_id, message_id ORDER BY update_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT update_id, CASE WHEN t LIKE '/start%' THEN CASE WHEN chat_id = 'home' THEN 'greeted' ELSE 'chat_id_told' END WHEN chat_id <> 'home' OR t NOT IN ('+', '-') THEN 'skipped'
  WHEN NOT marks THEN 'usage_hint' WHEN t = '+' THEN CASE WHEN published THEN 'already_published' ELSE 'published' END
  WHEN published THEN 'refused' WHEN rejected THEN 'already_rejected' ELSE 'rejected' END AS outcome FROM e""")
def feedback_updates(spark, sf_dir: str) -> DataFrame:
    """What each update of the feedback stream comes to, in order."""
    sent = read(spark, sf_dir, "benchmark").select(F.lit("home").alias("chat_id"), F.col("item_id").alias("message_id"))
    return registry.outcomes(updates(spark, sf_dir), sent, "home").select("update_id", "outcome")


@query(f"""WITH {UPDATES}, o AS (SELECT *, message_id <> 17 AS ok FROM u), f AS (SELECT chat_id, min(update_id) FILTER (NOT ok) AS failed, max(update_id) AS last FROM o GROUP BY ALL)
SELECT chat_id, coalesce(failed, last + 1) AS next_offset, count(*) FILTER (failed IS NULL OR update_id < failed) AS handled FROM o JOIN f USING (chat_id) GROUP BY chat_id, failed, last""")
def update_offsets(spark, sf_dir: str) -> DataFrame:
    """Where the next poll begins: after the last update, or at the first that failed."""
    return registry.offsets(updates(spark, sf_dir).withColumn("ok", F.col("message_id") != 17), ["chat_id"])


# Sources and records


@query("""WITH e AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title, 1704067200 + page_id * 61 AS ts FROM pages)
SELECT 'rss_feeds.example.org' AS source, ('0x' || substr(sha256(url), 1, 15))::BIGINT AS id, CASE WHEN page_id % 4 = 3 THEN 'Atom' ELSE 'feeds.example.org' END AS source_name, ts AS timestamp,
  strftime(to_timestamp(ts)::TIMESTAMP + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS date, title || ' Seen on page ' || page_id AS text, url FROM e WHERE page_id % 4 <> 2 AND title <> ''""")
def feed_posts(spark, sf_dir: str) -> DataFrame:
    """Posts of RSS and Atom feeds, one a page: times of both forms, and some that aren't times."""
    escaped = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    p = F.col("page_id")
    ts = F.lit(1704067200) + p * 61
    wall = lambda hours: civil(F.timestamp_seconds(ts).cast("timestamp_ntz"), hours)
    title, url = escaped(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), escaped(F.col("url"))
    iso = F.date_format(wall(0), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    when = F.when(p % 4 == 0, F.concat(F.date_format(wall(6), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0600"))).when(p % 4 == 1, iso).otherwise("yesterday")
    said = F.concat(F.lit("Seen on page "), p.cast("string"))
    rss = F.concat(
        F.lit("<rss><channel><item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><pubDate>"), when, F.lit("</pubDate><description>"), said,
        F.lit("</description></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), title, F.lit('</title><link href="'), F.replace(url, F.lit('"'), F.lit("&quot;")),
        F.lit('"/><updated>'), iso, F.lit("</updated><summary>"), said, F.lit("</summary></entry></feed>"),
    )
    name = F.when(p % 4 == 3, "Atom").otherwise("")
    bodies = read(spark, sf_dir, "pages").select(F.lit("http://feeds.example.org/x").alias("url"), name.alias("name"), F.when(p % 4 == 3, atom).otherwise(rss).alias("body"))
    return feeds.from_feeds(bodies).select("source", "id", "source_name", "timestamp", "date", "text", "url")


@query("""SELECT CASE WHEN owned THEN 'own' ELSE 'wall' END AS source, doc_id AS id, 'social' AS source_type, 1704067200 + doc_id * 60 AS timestamp,
  strftime(to_timestamp(1704067200 + doc_id * 60)::TIMESTAMP + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS date, md5(coalesce(text, '')) AS digest, 'https://vk.ru/wall-' || (doc_id % 10) || '_' || doc_id AS url,
  CASE WHEN owned THEN CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END END AS views, CASE WHEN owned THEN 1 END::BIGINT AS likes FROM documents, (VALUES (true), (false)) v(owned)""")
def wall_posts(spark, sf_dir: str) -> DataFrame:
    """Posts of walls: counters are kept of the own audiences' alone."""
    d = F.col("doc_id")
    count = lambda c: F.struct(c.cast("long").alias("count"))
    raw = read(spark, sf_dir, "documents").select(
        d.alias("id"), (F.lit(1704067200) + d * 60).alias("date"), "text", (-(d % 10)).alias("owner"), F.when(d % 3 != 0, count(d)).alias("views"),
        count(F.lit(1)).alias("likes"), count(F.lit(2)).alias("comments"), count(F.lit(3)).alias("reposts"),
    )
    raw = raw.withColumn("owner_id", F.concat(F.lit("-"), (-F.col("owner")).cast("string")))
    both = posts.from_wall(raw, F.lit("own"), owned=True).union(posts.from_wall(raw, F.lit("wall")))
    return both.select("source", "id", "source_type", "timestamp", "date", F.md5("text").alias("digest"), "url", "views", "likes")


@query("""WITH m AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '@chan_' || (conv_id % 10) WHEN 1 THEN '-100' || (conv_id % 10) WHEN 2 THEN 'bad name!' ELSE 'c' || (conv_id % 10) END AS channel,
  conv_id * 100 + turn AS id, CASE WHEN turn % 3 = 2 THEN '  ' ELSE ' ' || role || ' ' END AS message,
  CASE turn % 6 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' WHEN 2 THEN 'image' WHEN 3 THEN 'document' WHEN 4 THEN 'link_preview' END AS media_type FROM conversations)
SELECT 'tg_' || CASE WHEN channel LIKE '-100%' THEN substr(channel, 5) ELSE ltrim(channel, '@') END AS source, id, CASE WHEN channel LIKE 'c%' THEN ltrim(channel, '@') ELSE 'name' END AS source_name,
  trim(message) AS text, CASE WHEN channel LIKE '-100%' THEN 'https://t.me/c/' || substr(channel, 5) ELSE 'https://t.me/' || ltrim(channel, '@') END || '/' || id AS url, media_type
FROM m WHERE channel <> 'bad name!' AND trim(message) <> ''""")
def channel_posts(spark, sf_dir: str) -> DataFrame:
    """Posts of channels, with the kind of what is attached."""
    c, turn = F.col("conv_id"), F.col("turn")
    n = (c % 10).cast("string")
    channel = F.when(c % 4 == 0, F.concat(F.lit("@chan_"), n)).when(c % 4 == 1, F.concat(F.lit("-100"), n)).when(c % 4 == 2, "bad name!").otherwise(F.concat(F.lit("c"), n))
    k = turn % 6
    mime = F.when(k == 1, "video/mp4").when(k == 2, "image/png").otherwise("text/plain")
    kind = posts.media_type(k == 0, mime, k.isin(1, 2, 3), k == 4, k != 5)
    rows = read(spark, sf_dir, "conversations").select(
        channel.alias("channel"), (c * 100 + turn).alias("id"), F.lit(1704067200).alias("timestamp"),
        F.when(turn % 3 == 2, "  ").otherwise(F.concat(F.lit(" "), F.col("role"), F.lit(" "))).alias("message"), kind.alias("media_type"),
    )
    names = rows.select("channel").distinct().withColumn("name", F.when(F.col("channel").startswith("c"), "").otherwise("name"))
    return feeds.from_channels(rows, names).select("source", "id", "source_name", "text", "url", "media_type")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k')::BIGINT END AS k,
  CASE event_id % 4 WHEN 1 THEN 'limit' WHEN 2 THEN 'not an object' WHEN 3 THEN 'no response' END AS problem FROM events""")
def envelopes(spark, sf_dir: str) -> DataFrame:
    """Responses of an interface's answers, and why there is none."""
    i = F.col("event_id")
    value = (
        F.when(i % 4 == 0, F.concat(F.lit('{"response": '), F.col("props"), F.lit("}"))).when(i % 4 == 1, '{"error": {"error_msg": "limit"}}')
        .when(i % 4 == 2, "[1]").otherwise("{}")
    )
    rows = read(spark, sf_dir, "events").select("event_id", documents.envelope(value, "struct<k:bigint>").alias("e"))
    return rows.select("event_id", "e.response.k", "e.problem")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'published' ELSE 'rejected' END AS status FROM conversations WHERE turn % 3 <> 2""")
def registry_records(spark, sf_dir: str) -> DataFrame:
    """Decided records of registry files: objects in base64, as they are published."""
    turn = F.col("turn")
    status = F.when(turn % 3 == 0, "published").when(turn % 3 == 1, "rejected").otherwise("open")
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", status.alias("status"))).alias("topics"))
    files = rows.select("conv_id", documents.encoded("topics").alias("content"))
    records = files.select("conv_id", F.explode(documents.records_of(F.col("content"), "struct<turn:bigint,status:string>")).alias("r"))
    return registry.decided(records.select("conv_id", "r.turn", "r.status"))


@query("""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN json_extract_string(props, '$.k') END AS k, (CASE WHEN event_id % 5 < 3 THEN 1 ELSE 0 END)::INT AS keys FROM events""")
def configs(spark, sf_dir: str) -> DataFrame:
    """Configurations that are objects, and none of those that aren't."""
    i = F.col("event_id")
    value = F.when(i % 5 == 3, "[1, 2]").when(i % 5 == 4, "oops").otherwise(F.col("props"))
    rows = read(spark, sf_dir, "events").select("event_id", documents.config_of(value).alias("c"))
    return rows.select("event_id", F.try_element_at("c", F.lit("k")).alias("k"), F.size("c").alias("keys"))


@query("""WITH d AS (SELECT DISTINCT event_type AS audience, user_id AS post_id FROM events),
b AS (SELECT *, (row_number() OVER (PARTITION BY audience ORDER BY post_id) - 1) // 100 AS batch FROM d)
SELECT audience, batch, count(*) AS ids, min(post_id) AS first, max(post_id) AS last FROM b GROUP BY ALL""")
def counter_batches(spark, sf_dir: str) -> DataFrame:
    """Ids of each audience in batches of a hundred, as an interface is asked for their counters."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("audience"), F.col("user_id").alias("post_id"))
    found = lookups.batched(rows, "audience", "post_id")
    return found.groupBy("audience", "batch").agg(F.count("*").alias("ids"), F.min("post_id").alias("first"), F.max("post_id").alias("last"))


@query("""WITH d AS (SELECT user_id, event_type, event_id, ts, (ts + INTERVAL 6 HOURS)::DATE AS day FROM events)
SELECT day, user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM d GROUP BY ALL""")
def daily_posts(spark, sf_dir: str) -> DataFrame:
    """Posts that are new on their civil day: what was seen the day before counts again."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", F.to_date(civil(F.col("ts"))).alias("day"))
    keys = ["day", "user_id", "event_type"]
    return posts.unseen(rows, rows.limit(0), keys, ["ts", "event_id"]).drop("ts")


# Learning


@query(f"""WITH c AS (SELECT * FROM ({SQL['checkpoints']})), o AS (SELECT observation_id, min(predicted_at) AS predicted_at, bool_or(hours = 1 AND state = 'completed') AS one,
  bool_or(hours = 3 AND state = 'completed') AS three, max(CASE WHEN hours = 3 AND state = 'completed' THEN score END) AS score FROM c GROUP BY ALL)
SELECT observation_id, predicted_at, score, one AS paired FROM o WHERE three AND score IS NOT NULL""")
def training_rows(spark, sf_dir: str) -> DataFrame:
    """The rows that the model of three hours learns from, and which of them have both hours."""
    rows = tracker.completed(E.checkpoints(spark, sf_dir))
    rows = model.training_rows(rows, 3)
    return rows.select("observation_id", "predicted_at", "score", "paired")


@query(f"""WITH o AS (SELECT * FROM ({SQL['observation_ids']})) SELECT observation_id, audience, predicted_at FROM o
WHERE predicted_at >= 1704844800 AND observation_id NOT IN (SELECT observation_id FROM o WHERE predicted_at < 1704844800)""")
def inserted_observations(spark, sf_dir: str) -> DataFrame:
    """Observations that an insert adds: those whose id isn't there yet."""
    rows = E.observation_ids(spark, sf_dir).drop("members")
    return tracker.inserted(rows.where("predicted_at < 1704844800"), rows).where("predicted_at >= 1704844800")


@query("""WITH s AS (SELECT event_type AS audience, h.horizon, count(*) AS n FROM events, (VALUES (1), (3)) h(horizon) WHERE event_id % h.horizon = 0 GROUP BY ALL)
SELECT audience, horizon, n FROM s WHERE n >= 30 AND NOT (horizon = 1 AND audience IN ('click', 'view'))""")
def due_training(spark, sf_dir: str) -> DataFrame:
    """Models that are due: enough rows, and no model of as many with these features."""
    rows = read(spark, sf_dir, "events")
    horizon = F.explode(F.array(F.lit(1), F.lit(3))).alias("horizon")
    samples = rows.select(F.col("event_type").alias("audience"), "event_id", horizon).where("event_id % horizon = 0")
    samples = samples.groupBy("audience", "horizon").agg(F.count("*").alias("n"))
    current = samples.where("audience in ('click', 'view', 'error')").withColumnRenamed("n", "samples")
    features = F.when(F.col("audience") == "error", F.array(F.lit("other"))).otherwise(F.array(F.lit("intercept")))
    current = current.where("horizon = 1").withColumn("features", features)
    return lookups.due_for_training(samples, current, ["intercept"])
