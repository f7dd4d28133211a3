"""Queries over documents, conversations, pages and the benchmark as posts, topics and registry."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions.durable import shared_folder
from newsloom.functions.packs import CITY, CORPUS, Pack
from newsloom.operators import classify as C
from newsloom.operators import cluster, delivery, isolated, lookups, model, posts, rank, registry, topics
from newsloom.operators.postings import Stored
from newsloom.plans.registry import SQL, query, read, spread
from newsloom.sources import feeds
from newsloom.streaming.topics import Index

P = CORPUS


def _any(parts) -> str:
    return "(" + " OR ".join("contains(t, '" + p.replace("'", "''") + "')" for p in parts) + ")"


def _pattern(patterns) -> str:
    r"""RE2 takes \b and \w for ASCII, so both are spelled out."""
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''").replace(r"\w", r"[\p{L}\p{N}_]")
    joined = re.sub(r"\\b(?=[\w(])", lambda _: r"(?:^|[^\p{L}\p{N}_])", joined).replace(r"\b", r"(?:$|[^\p{L}\p{N}_])")
    return f"regexp_matches(t, '(?i)(?:{joined})')"


NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


def _rules(P: Pack, texts: str, _pattern=_pattern) -> str:
    """The signals of a pack over ``texts``, SQL that has doc_id, source and t."""
    return f"""n AS ({texts}),
g AS (SELECT *, ((regexp_matches(t, '{P.phone}') AND {_pattern([P.listing])}) OR {_any(P.help)} OR {_pattern([P.help_pattern])})
    AND NOT {_any(P.help_event)} AS help,
  {_any(P.nonlocal_)} AS nh, {_any(P.local)} AS lh, {_any(P.excluded)} AS excluded,
  {_any(P.promo)} OR {_pattern(P.promo_patterns)} AS ad, {_any(P.opinion)} OR {_pattern([P.opinion_pattern])} AS opinion,
  {_any(P.complaint)} AS complaint, {_any(P.news)} AS news, {_any(P.regional)} OR {_any(P.regional).replace("contains(t,", "contains(lower(source),")} AS media,
  NOT {_pattern(P.official_not)} AND {_pattern(P.official)} AS off0 FROM n),
s AS (SELECT *, off0 AND NOT help AS official, nh AND NOT lh AS away, nh AND lh AS explicit_local FROM g),
c AS (SELECT *, CASE WHEN excluded THEN 'excluded_topic' WHEN ad THEN 'advertising' WHEN opinion THEN 'opinion' WHEN help THEN 'help_request'
  WHEN away THEN 'nonlocal' WHEN official OR (media AND news) THEN 'news' WHEN complaint THEN 'complaint' WHEN news THEN 'news'
  ELSE 'social_story' END AS content_type,
  CASE WHEN excluded OR ad OR opinion OR help THEN 0 WHEN official THEN 90 WHEN media THEN 65 WHEN complaint THEN 10 ELSE 25 END AS c0,
  CASE WHEN official THEN 'official_attribution' WHEN media THEN 'regional_media' WHEN complaint THEN 'complaint' ELSE 'social' END AS source_kind FROM s),
d AS (SELECT *, CASE WHEN away THEN least(c0, 10) ELSE c0 END AS confidence FROM c)"""


def _gates(P: Pack, _pattern=_pattern) -> str:
    """The gates over what :func:`_rules` gives."""
    return f"""x AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'not_today_or_missing_timestamp' WHEN excluded THEN 'excluded_topic'
  WHEN ad THEN 'promotional' WHEN doc_id % 17 = 0 THEN 'advertising' WHEN away THEN 'nonlocal_topic' WHEN help THEN 'help_request'
  WHEN opinion THEN 'opinion' END AS reason, CASE WHEN {_pattern(P.fatal)} THEN 'fatal_incident' {" ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w, _ in P.events)}
  ELSE 'general' END AS class, CASE WHEN {_pattern(P.fatal)} THEN 100.0 {" ".join(f"WHEN {_any(w)} THEN {i}" for n, w, i in P.events)} ELSE 20.0 END::DOUBLE AS impact,
  CASE WHEN {_pattern([P.interview])} AND {_pattern([P.sport])} THEN 40.0 WHEN {_pattern([P.announcement])} THEN 42.0 ELSE 90.0 END::DOUBLE AS capped,
  ({" + ".join(f"CASE WHEN {_any(w)} THEN {n} ELSE 0 END" for n, w in P.hooks)})::INT AS hook FROM d)
SELECT doc_id, reason, class, impact, capped, hook FROM x"""


def _gated(docs: DataFrame, P: Pack) -> DataFrame:
    rows = C.signals(docs, P)
    t = X.norm(F.coalesce("text", F.lit("")))
    away = F.col("nonlocal_hit") & ~F.col("local_hit")
    reason = C.exclusion(
        F.col("doc_id") % 19 != 0, F.col("excluded"), F.col("ad"), F.col("doc_id") % 17 == 0, away, F.col("help"), F.col("opinion")
    )
    kind = C.event_class(t, P)
    return rows.select(
        "doc_id", reason.alias("reason"), kind["name"].alias("class"), kind["impact"].alias("impact"),
        C.capped(F.lit(90.0), t, P).alias("capped"), C.hook(t, P).alias("hook"),
    )  # fmt: skip


#: The signals of the corpus pack.
RULES = _rules(P, f"SELECT doc_id, source, {NORM.format("coalesce(text, '')")} AS t FROM documents")


@query(f"WITH {RULES} SELECT doc_id, content_type, source_kind, confidence, explicit_local FROM d")
def doc_rules(spark, sf_dir: str) -> DataFrame:
    """Content type, source kind and confidence of each document."""
    rows = C.classify(spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source")), P)
    return rows.select("doc_id", "content_type", "source_kind", "confidence", "explicit_local")


@query(f"WITH {RULES}, {_gates(P)}")
def doc_gates(spark, sf_dir: str) -> DataFrame:
    """Why a document isn't eligible, its event class, the score's cap and its hook."""
    return _gated(spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source")), P)


#: Phrases that the city pack's patterns are about; its literals come with them.
PHRASES = (
    "прокуратура сообщила о проверке", "по данным следствия", "мчс предупредило жителей", "суд вынес приговор", "администрация объявила",
    "официальной информации пока не поступало", "мэрия подтвердила", "руководитель департамента подписал", "угмс", "пристроим кота барсик 8 (913) 123-45-67",
    "огромная просьба, ищем очевидцев", "это реклама", "промокод на скидку", "купить билет", "при поддержке омского нпз", "? где автобусы", "погибли 2 человека",
    "водитель автобуса вчера погиб", "смертельное дтп", "скончался в больнице", "умер пациент", "интервью с хоккеистом авангарда", "состоится концерт", "автограф-сессия",
)  # fmt: skip
PIECES = (*dict.fromkeys((
    *PHRASES, *CITY.help, *CITY.nonlocal_, *CITY.local, *CITY.opinion, *CITY.complaint, *CITY.news, *CITY.excluded, *CITY.promo, *CITY.help_event,
    *(w for _, words in CITY.hooks for w in words), *(w for _, words, _ in CITY.events for w in words), "тихий вечер", "двор", "новая лавочка у дома",
)),)  # fmt: skip
#: For a regular expression engine whose words are of ASCII: the letters as others, some as two.
LETTERS = dict(zip("абвгдежзийклмнопрстухчшья", "ABCDEFGHIJKLMNOPQRSTUVWXY", strict=True)) | dict(zip("ёфцщъыэю", ("Za", "Zb", "Zc", "Zd", "Ze", "Zf", "Zg", "Zh"), strict=True))


def _ascii(text: str) -> str:
    return "".join(LETTERS.get(c, c) for c in text.replace("[её]", "(?:е|ё)"))


def _city_pattern(patterns) -> str:
    joined = "|".join(f"(?:{_ascii(p)})" for p in patterns).replace("'", "''")
    return f"regexp_matches(m, '{joined}')"


def _picked(values) -> str:
    listed = "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
    at = lambda e: f"list_extract({listed}, ({e})::INT + 1)"  # noqa: E731
    n = len(values)
    return f"{at(f'doc_id % {n}')} || ' ' || {at(f'(doc_id * 13 + 5) % {n}')} || ' ' || {at(f'(doc_id // 3) % {n}')}"


CITY_RULES = _rules(
    CITY, f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ngs55' ELSE 'vk' END AS source, {_picked(PIECES)} AS t, {_picked([_ascii(v) for v in PIECES])} AS m FROM documents", _city_pattern
)


def city_posts(spark, sf_dir: str) -> DataFrame:
    """Three phrases of the city for each document's id."""
    d, n = F.col("doc_id"), len(PIECES)
    at = lambda e: F.element_at(F.array(*map(F.lit, PIECES)), (e + 1).cast("int"))  # noqa: E731
    text = F.concat_ws(" ", at(d % n), at((d * 13 + 5) % n), at(F.floor(d / 3) % n))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.when(d % 4 == 0, "ngs55").otherwise("vk").alias("source"))


@query(f"WITH {CITY_RULES} SELECT doc_id, content_type, source_kind, confidence, explicit_local FROM d")
def city_rules(spark, sf_dir: str) -> DataFrame:
    """What the city pack makes of phrases that its rules are about."""
    return C.classify(city_posts(spark, sf_dir), CITY).select("doc_id", "content_type", "source_kind", "confidence", "explicit_local")


@query(f"WITH {CITY_RULES}, {_gates(CITY, _city_pattern)}")
def city_gates(spark, sf_dir: str) -> DataFrame:
    """The city pack's gates, event classes, caps and hooks over the same phrases."""
    return _gated(city_posts(spark, sf_dir), CITY)


@query(f"""WITH n AS (SELECT doc_id, {NORM.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT doc_id, list_distinct(regexp_extract_all(t, '{P.word}')) AS w, list_distinct(regexp_extract_all(t, '\\b\\d+(?:[.,]\\d+)?\\b')) AS d,
  list_filter([{", ".join(f"'{a}'" for a in P.anchors)}], lambda a: contains(t, a)) AS a FROM n)
SELECT doc_id, len(w)::INT AS n_words, md5(array_to_string(list_sort(w), ' ')) AS words_md5, len(d)::INT AS n_numbers,
  array_to_string(a, ',') AS anchors FROM w""")
def token_sets(spark, sf_dir: str) -> DataFrame:
    """The word, number and anchor sets of each document."""
    rows = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.norm(F.coalesce("text", F.lit(""))).alias("t"))
    t = F.col("t")
    rows = rows.select("doc_id", X.word_set(t, P.word).alias("w"), X.number_set(t).alias("d"), X.stems_in(t, P.anchors).alias("a"))
    return rows.select(
        "doc_id", F.size("w").alias("n_words"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("words_md5"),
        F.size("d").alias("n_numbers"), F.array_join("a", ",").alias("anchors"),
    )  # fmt: skip


SIMILAR = f"""n AS (SELECT doc_id AS pos, {NORM.format("coalesce(text, '')")} AS t FROM documents),
z AS (SELECT pos, t, list_distinct(regexp_extract_all(t, '{P.word}')) AS w, list_distinct(regexp_extract_all(t, '\\b\\d+(?:[.,]\\d+)?\\b')) AS d,
  list_filter([{", ".join(f"'{a}'" for a in P.anchors)}], lambda a: contains(t, a)) AS a,
  list_filter([{", ".join(f"'{a}'" for a in P.strong_event)}], lambda a: contains(t, a)) AS st,
  CASE WHEN contains(t, '{P.same_event[0]}') AND {_any(P.same_event[1])} THEN list_distinct(regexp_extract_all(t, '\\b\\d+\\b')) ELSE [] END AS pl FROM n),
k AS (SELECT pos, len(w) AS n, unnest(w) AS word FROM z),
m AS (SELECT x.pos AS p, y.pos AS q, x.n AS np, y.n AS nq, count(*) AS m FROM k x JOIN k y ON x.word = y.word AND y.pos < x.pos GROUP BY ALL),
e AS (SELECT p, q FROM m JOIN z x ON x.pos = p JOIN z y ON y.pos = q
  WHERE m / (np + nq - m)::DOUBLE >= 0.23 OR (m / (np + nq - m)::DOUBLE >= 0.12 AND (len(list_intersect(x.a, y.a)) >= 2
    OR len(list_intersect(x.d, y.d)) >= 2)) OR len(list_intersect(x.pl, y.pl)) > 0 OR len(list_intersect(x.st, y.st)) >= 3)"""
CLUSTERS = f"""WITH RECURSIVE {SIMILAR}, r AS (SELECT pos AS p, pos AS at FROM z UNION SELECT r.p, e.q FROM r JOIN e ON e.p = r.at),
t AS (SELECT r.p AS pos, min(r.at) AS root FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.p = r.at) GROUP BY r.p)"""


@query(f"{CLUSTERS} SELECT pos AS doc_id, root FROM t")
def doc_clusters(spark, sf_dir: str) -> DataFrame:
    """The topic of each document, named by its first one."""
    found = cluster.topics(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), P, "doc_id")
    return found.select(F.col("pos").alias("doc_id"), "root")


@query(f"{CLUSTERS} SELECT pos AS doc_id, root FROM t")
def doc_clusters_by_cycles(spark, sf_dir: str) -> DataFrame:
    """The same topics, where documents come in three cycles and join what is settled."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    index = Index(spark, shared_folder(spark), P)
    for k in range(3):
        cycle = F.floor((F.col("doc_id") - (least or 0)) * 3 / ((most or 0) - (least or 0) + 1)) == k
        index.cycle(docs.where(cycle), k, pos="doc_id")
    return index.posts(3).select(F.col("pos").alias("doc_id"), "root")


@query(f"""{CLUSTERS}, {RULES.replace("n AS (", "n2 AS (", 1).replace("FROM n)", "FROM n2)")},
j AS (SELECT t.root AS topic, d.* FROM t JOIN d ON d.doc_id = t.pos),
a AS (SELECT topic, bool_or(official) AS official, bool_and(help) AS help_only, bool_and(complaint AND NOT official) AS complaint_only,
  bool_and(opinion) AS opinion_only, bool_and(ad) AS ad_only, bool_and(away) AS nonlocal_only, bool_and(excluded) AS excluded_only,
  round(avg(confidence), 1) AS confidence, arg_min(content_type, doc_id) AS first_type, arg_min(source_kind, doc_id) AS source_kind, count(*) AS posts FROM j GROUP BY topic)
SELECT topic, official, excluded_only, confidence, source_kind, posts, CASE WHEN help_only THEN 'help_request' WHEN complaint_only THEN 'complaint'
  WHEN opinion_only THEN 'opinion' WHEN ad_only THEN 'advertising' WHEN nonlocal_only THEN 'nonlocal' ELSE first_type END AS content_type FROM a""")
def topic_flags(spark, sf_dir: str) -> DataFrame:
    """Flags and types of the documents' topics."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    found = cluster.topics(docs, P, "doc_id").select(F.col("pos").alias("doc_id"), F.col("root").alias("topic"))
    rows = topics.flags(C.classify(docs, P).join(found, "doc_id"), "topic", "doc_id")
    return rows.select("topic", "official", "excluded_only", "confidence", "source_kind", "posts", "content_type")


STOP = ", ".join(f"'{s}'" for s in P.stopwords)


def _folded(value: str) -> str:
    """Case folding in SQL: lower case, and what that leaves."""
    singles = {c: f for c, f in X.folds().items() if len(f) == 1}
    out = f"translate(lower({value}), '{''.join(singles)}', '{''.join(singles.values())}')"
    for c, f in X.folds().items():
        if len(f) > 1:
            out = f"replace({out}, '{c}', '{f}')"
    return out


def _terms(value: str) -> str:
    suffixes = "|".join(sorted(P.suffixes, key=len, reverse=True))
    words = f"list_filter(regexp_extract_all({_folded(value)}, '{P.story_word}'), lambda x: NOT regexp_full_match(x, '[0-9]+'))"
    stems = f"list_transform({words}, lambda x: regexp_replace(x, '^(.{{4,}}?)(?:{suffixes})$', '\\1'))"
    return f"list_distinct(list_filter({stems}, lambda x: length(x) >= 4 AND NOT list_contains([{STOP}], x)))"


#: The first line is the title, the first 900 characters the story, as records keep them.
LINE = r"""coalesce(list_extract(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\n\r\x0b\x0c]'),
  lambda x: trim(x)), lambda x: x <> ''), 1), '')"""
FLAT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
STORIES = f"""l AS (SELECT doc_id AS id, {LINE} AS title, substr({FLAT}, 1, 900) AS story FROM documents),
r AS (SELECT item_id AS id, {LINE} AS title, substr({FLAT}, 1, 900) AS story FROM benchmark),
lt AS (SELECT id, {_terms("title")} AS t, {_terms("title || ' ' || story")} AS s FROM l),
rt AS (SELECT id, {_terms("title")} AS t, {_terms("title || ' ' || story")} AS s FROM r)"""


@query(f"""WITH {STORIES}
SELECT lt.id AS left_id, rt.id AS right_id FROM lt, rt WHERE
  (len(list_intersect(lt.t, rt.s)) >= 3 AND len(list_intersect(lt.t, rt.s)) >= 0.4::DOUBLE * len(lt.t))
  OR (len(list_intersect(rt.t, lt.s)) >= 3 AND len(list_intersect(rt.t, lt.s)) >= 0.4::DOUBLE * len(rt.t))""")
def story_links(spark, sf_dir: str) -> DataFrame:
    """Documents that tell the same story as a record of the registry."""
    return rank.story_links(*stories(spark, sf_dir), P)


def stories(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    out = []
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        text = F.coalesce("text", F.lit(""))
        story = X.clean_start(text, 900).alias("story")
        rows = spread(read(spark, sf_dir, name).select(key, "text"))
        out.append(rows.select(F.col(key).alias("id"), X.first_line(text).alias("title"), story))
    return out[0], out[1]


@query(f"""WITH {STORIES},
h AS (SELECT DISTINCT lt.id FROM lt, rt WHERE
  (len(list_intersect(lt.t, rt.s)) >= 3 AND len(list_intersect(lt.t, rt.s)) >= 0.4::DOUBLE * len(lt.t))
  OR (len(list_intersect(rt.t, lt.s)) >= 3 AND len(list_intersect(rt.t, lt.s)) >= 0.4::DOUBLE * len(rt.t)))
SELECT id FROM l WHERE id NOT IN (SELECT id FROM h) AND id % 300 NOT IN (SELECT item_id FROM benchmark)""")
def story_antijoin(spark, sf_dir: str) -> DataFrame:
    """Documents that the registry doesn't have, by address or as a story."""
    left, right = stories(spark, sf_dir)
    urls = left.select("id", F.concat(F.lit("u"), (F.col("id") % 300).cast("string")).alias("url"))
    records = right.withColumn("url", F.concat(F.lit("u"), F.col("id").cast("string")))
    return rank.not_in_registry(left, urls, records, P).select("id")


@query(SQL["story_antijoin"])
def story_antijoin_stored(spark, sf_dir: str) -> DataFrame:
    """The same by postings that three changes of the registry have left: its records come without
    stories, then with other ones, then with their own."""
    left, right = stories(spark, sf_dir)
    urls = left.select("id", F.concat(F.lit("u"), (F.col("id") % 300).cast("string")).alias("url"))
    record = right.select(F.col("id").alias("pos"), "title", F.lit("rejected").alias("status"), F.lit("").alias("category"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), "story")
    stored = Stored(spark, shared_folder(spark), P)
    for version, told in enumerate((F.lit(""), F.reverse("story"), F.col("story")), 1):
        stored.change(record.withColumn("story", told), version)
    return stored.unknown(left, urls, 3).select("id")


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN length(text) END AS views, role FROM conversations)
SELECT conv_id, count(*)::INT AS members, coalesce(sum(views), 0)::BIGINT AS views, count(views) > 0 AS measured,
  string_agg(role, ',' ORDER BY turn) AS roles FROM m GROUP BY conv_id""")
def nested_members(spark, sf_dir: str) -> DataFrame:
    """Topics with nested members, old fields dropped at any depth, then aggregated in place."""
    rows = read(spark, sf_dir, "conversations")
    post = F.struct(
        F.when(F.col("turn") % 2 == 0, F.length("text")).cast("long").alias("views"), "role",
        F.lit(True).alias("verification_required"), F.lit("verification_required").alias("publication_mode"),
    )  # fmt: skip
    nested = posts.without_legacy(topics.gathered(rows, "conv_id", "turn", post))
    add = F.aggregate("members", F.lit(0).cast("long"), lambda total, m: total + F.coalesce(m["views"], F.lit(0)))
    return nested.select(
        "conv_id", F.size("members").alias("members"), add.alias("views"),
        F.exists("members", lambda m: m["views"].isNotNull()).alias("measured"),
        F.array_join(F.transform("members", lambda m: m["role"]), ",").alias("roles"),
    )  # fmt: skip


@query("""WITH RECURSIVE r AS (SELECT item_id AS pos, 'title ' || item_id AS title, CASE WHEN item_id % 3 = 0 THEN 'published' ELSE 'rejected' END AS status,
  'u' || item_id AS url FROM benchmark),
u AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, CASE WHEN doc_id % 31 = 0 THEN '' ELSE 'Title  ' || (doc_id // 5) END AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'rejected' ELSE 'published' END AS status, CASE WHEN doc_id % 7 = 0 THEN 'u' || (doc_id // 12) ELSE '' END AS url FROM documents),
k AS (SELECT 0::BIGINT AS n, (SELECT list({'title': title, 'key': trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), 'status': status, 'url': url, 'change': 'kept'} ORDER BY pos) FROM r) AS s
  UNION ALL SELECT n + 1, CASE WHEN key = '' THEN s
    WHEN hit IS NULL OR hit = 0 THEN list_append(s, {'title': title, 'key': key, 'status': status, 'url': url, 'change': 'inserted'})
    ELSE list_transform(s, lambda x, i: CASE WHEN i <> hit THEN x
      WHEN x.status = 'published' AND k2.status = 'rejected' THEN {'title': x.title, 'key': x.key, 'status': x.status, 'url': x.url,
        'change': CASE WHEN x.change = 'kept' THEN 'refused' ELSE x.change END}
      ELSE {'title': x.title, 'key': x.key, 'status': k2.status, 'url': coalesce(nullif(k2.url, ''), x.url),
        'change': CASE WHEN x.change IN ('kept', 'refused') THEN 'updated' ELSE x.change END} END) END
  FROM (SELECT k.n, k.s, v.title, v.key, v.status, v.url,
      list_position(list_transform(k.s, lambda x: (v.url <> '' AND x.url = v.url) OR x.key = v.key), true) AS hit
    FROM k JOIN (SELECT *, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS key FROM u) v ON v.n = k.n + 1) k2)
SELECT x.title, x.status, x.url, x.change FROM (SELECT unnest(s) AS x FROM k WHERE n = (SELECT max(n) FROM k))""")
def registry_upsert(spark, sf_dir: str) -> DataFrame:
    """The registry after updates by address or title, several of a record among them."""
    i, d = F.col("item_id"), F.col("doc_id")
    empty = [F.lit("").alias("category"), F.lit("").alias("story")]
    old = read(spark, sf_dir, "benchmark").select(
        i.alias("pos"), F.concat(F.lit("title "), i.cast("string")).alias("title"),
        F.when(i % 3 == 0, "published").otherwise("rejected").alias("status"), F.concat(F.lit("u"), i.cast("string")).alias("url"), *empty,
    )  # fmt: skip
    new = read(spark, sf_dir, "documents").select(
        d.alias("pos"), F.when(d % 31 == 0, "").otherwise(F.concat(F.lit("Title  "), F.floor(d / 5).cast("string"))).alias("title"),
        F.when(d % 2 == 0, "rejected").otherwise("published").alias("status"),
        F.when(d % 7 == 0, F.concat(F.lit("u"), F.floor(d / 12).cast("string"))).otherwise("").alias("url"), *empty,
    )  # fmt: skip
    return registry.upsert(old, new).select("title", "status", "url", "change")


@query("""WITH r AS (SELECT conv_id % 60 AS message_id, turn, conv_id, CASE WHEN turn % 3 = 0 THEN '+' WHEN turn % 3 = 1 THEN '-' ELSE '?' END AS symbol FROM conversations)
SELECT conv_id, turn, CASE WHEN b.item_id IS NULL THEN 'unknown_message' WHEN symbol = '+' THEN 'published' WHEN symbol = '-' THEN 'rejected'
  ELSE 'usage_hint' END AS outcome FROM r LEFT JOIN benchmark b ON b.item_id = r.message_id""")
def feedback(spark, sf_dir: str) -> DataFrame:
    """What each reply to a delivered message asks for."""
    replies = read(spark, sf_dir, "conversations").select(
        F.lit("c").alias("chat_id"), (F.col("conv_id") % 60).alias("message_id"), "conv_id", "turn",
        F.when(F.col("turn") % 3 == 0, "+").when(F.col("turn") % 3 == 1, "-").otherwise("?").alias("symbol"),
    )  # fmt: skip
    sent = read(spark, sf_dir, "benchmark").select(
        F.lit("c").alias("chat_id"), F.col("item_id").alias("message_id"), F.col("item_id").alias("topic")
    )
    return registry.answered(replies, sent).select("conv_id", "turn", "outcome")


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title,
  ('0x' || substr(sha256(url), 1, 15))::BIGINT AS id FROM p WHERE title <> ''""")
def feed_parse(spark, sf_dir: str) -> DataFrame:
    """Pages as entries of a feed: title, host and the stable id of the address."""
    title = X.collapsed(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    rows = read(spark, sf_dir, "pages").select("page_id", "url", title.alias("title")).where("title <> ''")
    return rows.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), "title", feeds.stable_id(F.col("url")).alias("id"))


@query(r"""WITH n AS (SELECT doc_id, coalesce(list_extract(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\n\r\x0b\x0c]'), lambda x: trim(x)), lambda x: x <> ''), 1), '') AS title,
  trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
f AS (SELECT *, regexp_extract(t, '^(.+?[.!?…])(?:\s|$)', 1) AS s, regexp_extract(t, '^((?s:.)*?[.!?…])(?:\s)', 1) AS r FROM n)
SELECT doc_id, title, CASE WHEN s <> '' THEN s WHEN length(t) <= 320 THEN t ELSE rtrim(substr(t, 1, 320)) || '…' END AS sentence,
  CASE WHEN t = '' THEN 'Без заголовка' WHEN r <> '' THEN r ELSE rtrim(substr(t, 1, 240)) END AS rejection, length(t)::INT AS units FROM f""")
def titles(spark, sf_dir: str) -> DataFrame:
    """First line, first sentence, rejection title and UTF-16 length of each document."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", X.clean(F.coalesce("text", F.lit(""))).alias("cleaned"))
    text, cleaned = F.col("text"), F.col("cleaned")
    return rows.select(
        "doc_id", X.first_line(text).alias("title"), X.first_sentence(text, cleaned=cleaned).alias("sentence"),
        X.rejection_title(text, cleaned=cleaned).alias("rejection"), X.utf16_units(cleaned).alias("units"),
    )  # fmt: skip


NAMES = ["intercept", "text_length", "hour_sin", "hour_cos", *[f"topic_{n}" for n, _ in P.features]]


def labelled(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    made = model.features(F.col("text"), F.col("doc_id") * 3600, P)
    rows = docs.join(labels, "doc_id").select("doc_id", "quality", "toxic", *[v.alias(n) for n, v in made.items()])
    return rows.withColumn("y", model.target(F.col("quality") + F.col("toxic") * 2.0))


FEATURES = f"""f AS (SELECT d.doc_id, quality, toxic, lower(coalesce(text, '')) AS t, 1.0::DOUBLE AS intercept, least(length(coalesce(text, '')), 2000) / 2000.0::DOUBLE AS text_length,
  sin(2 * pi() * (d.doc_id % 24) / 24) AS hour_sin, cos(2 * pi() * (d.doc_id % 24) / 24) AS hour_cos FROM documents d JOIN labels USING (doc_id)),
x AS (SELECT *, {", ".join(f"({_any(w)})::INT::DOUBLE AS topic_{n}" for n, w in P.features)}, ln(1 + greatest(0.0, quality + toxic * 2.0))::DOUBLE AS y FROM f)"""


@query(
    f"WITH {FEATURES} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS i, '{b}' AS j, round(sum({a} * {b}), 6) AS value FROM x" for k, a in enumerate(NAMES) for b in [*NAMES, "y"][k:]
    )
)
def ridge_gram(spark, sf_dir: str) -> DataFrame:
    """Sums of products of the model's features."""
    found = model.gram(labelled(spark, sf_dir), NAMES, "y")
    return found.withColumn("value", F.round("value", 6))


def _solved(rows: str) -> str:
    """SQL of the tables ``e`` and ``b``: the ridge's coefficients as a list, by elimination over
    the sums of products of some rows. The ridge leaves no column without a pivot."""
    sums = ", ".join(
        "[" + ", ".join(f"sum({a} * {c})" + (f" + {model.RIDGE}" if a == c and k else "") for c in [*NAMES, "y"]) + "]" for k, a in enumerate(NAMES)
    )
    d = len(NAMES)
    return f"""e AS (SELECT 0 AS k, [{sums}]::DOUBLE[][] AS m FROM {rows}
  UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
    ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM e WHERE k < {d}),
b AS (SELECT list_transform(m, lambda r: r[{d + 1}]) AS b FROM e WHERE k = {d})"""


DOT = "(" + " + ".join(f"{n} * b[{k}]" for k, n in enumerate(NAMES, 1)) + ")"


@query(f"""WITH RECURSIVE {FEATURES}, {_solved("x")},
q AS (SELECT greatest(exp(list_sort(list(y))[least(count(*) - 1, floor(0.9::DOUBLE * count(*)))::INT + 1]) - 1, 1e-6) AS scale FROM x),
p AS (SELECT doc_id, greatest(0.0::DOUBLE, exp({DOT}) - 1) AS v FROM x, b)
SELECT doc_id, round(v, 6) AS predicted, round(least(100.0::DOUBLE, 100.0 * v / scale), 1) AS priority FROM p, q""")
def ridge_scores(spark, sf_dir: str) -> DataFrame:
    """Predictions of the model that is fitted on the labelled documents."""
    rows = labelled(spark, sf_dir)
    fitted = model.fit(rows, NAMES, "y")
    return rows.select("doc_id", F.round(fitted.predicted(), 6).alias("predicted"), fitted.priority().alias("priority"))


@query(f"""WITH {FEATURES}, o AS (SELECT doc_id, y, text_length, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM x),
s AS (SELECT *, place <= greatest(1, least(n - 1, floor(n * 0.8))) AS trains FROM o),
m AS (SELECT list_sort(list(y))[len(list(y)) // 2 + 1] AS median FROM s WHERE trains)
SELECT count(*) FILTER (trains) AS train_rows, count(*) FILTER (NOT trains) AS test_rows, round(any_value(median), 6) AS median,
  round(avg(abs(y - median)) FILTER (NOT trains), 6) AS mae_median, round(avg(abs(y - text_length)) FILTER (NOT trains), 6) AS mae_length,
  round(100 * (avg(abs(y - median)) FILTER (NOT trains) - avg(abs(y - text_length)) FILTER (NOT trains)) / nullif(avg(abs(y - median)) FILTER (NOT trains), 0), 4) AS improvement
FROM s, m""")
def holdout(spark, sf_dir: str) -> DataFrame:
    """A chronological holdout: errors of the training median and of one feature."""
    rows = model.split(labelled(spark, sf_dir).select("doc_id", "y", "text_length"), ["doc_id"])
    train = rows.where("trains")
    median = F.lit(model.nth(train, "y", train.count() // 2 + 1))  # the upper one
    base = F.avg(F.when(~F.col("trains"), F.abs(F.col("y") - median)))
    own = F.avg(F.when(~F.col("trains"), F.abs(F.col("y") - F.col("text_length"))))
    return rows.agg(
        F.count_if("trains").alias("train_rows"), F.count_if(~F.col("trains")).alias("test_rows"), F.round(F.max(median), 6).alias("median"),
        F.round(base, 6).alias("mae_median"), F.round(own, 6).alias("mae_length"),
        F.round(F.try_divide(100 * (base - own), F.nullif(base, F.lit(0.0))), 4).alias("improvement"),
    )  # fmt: skip


@query(f"""WITH RECURSIVE {FEATURES}, o AS (SELECT *, doc_id % 2 AS audience, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM x),
s AS (SELECT *, place <= greatest(1, least(n - 1, floor(n * 0.8::DOUBLE))) AS trains FROM o), learned AS (SELECT * FROM s WHERE trains), {_solved("learned")},
m AS (SELECT list_sort(list(y))[count(*) // 2 + 1] AS median, count(*) AS train_rows FROM learned),
t AS (SELECT audience, place, y, {DOT} AS predicted, text_length AS score FROM s, b WHERE NOT trains),
r AS (SELECT *, row_number() OVER (ORDER BY predicted, place)::DOUBLE AS p, row_number() OVER (ORDER BY score, place)::DOUBLE AS h,
  row_number() OVER (PARTITION BY audience ORDER BY predicted, place)::DOUBLE AS pa, row_number() OVER (PARTITION BY audience ORDER BY score, place)::DOUBLE AS ha FROM t),
a AS (SELECT *, row_number() OVER (ORDER BY y, place)::DOUBLE AS ry,
  row_number() OVER (PARTITION BY audience ORDER BY y, place)::DOUBLE AS rya FROM r)
SELECT NULL::BIGINT AS audience, count(*) AS test_rows, round(corr(p, ry), 4) AS spearman_model, round(corr(h, ry), 4) AS spearman_score, round(avg(abs(y - predicted)), 6) AS mae_model,
  round(avg(abs(y - median)), 6) AS mae_median, round(100 * (avg(abs(y - median)) - avg(abs(y - predicted))) / nullif(avg(abs(y - median)), 0), 2) AS improvement, any_value(train_rows) AS train_rows FROM a, m
UNION ALL SELECT audience, count(*), round(corr(pa, rya), 4), round(corr(ha, rya), 4), NULL, NULL, NULL, any_value(train_rows) FROM a, m GROUP BY audience""")
def ridge_holdout(spark, sf_dir: str) -> DataFrame:
    """The model fitted on the first labelled documents, measured on the rest."""
    rows = labelled(spark, sf_dir).withColumn("audience", F.col("doc_id") % 2)
    return model.evaluate(rows, NAMES, "y", "text_length", "audience", ["doc_id"])


@query("""SELECT source, count(*) AS posts, count(DISTINCT id) AS ids FROM (SELECT 'doc' AS source, doc_id AS id FROM documents
  UNION ALL SELECT 'conv', conv_id FROM conversations UNION ALL SELECT 'page', page_id FROM pages) GROUP BY source""")
def source_union(spark, sf_dir: str) -> DataFrame:
    """Posts of all sources together."""
    parts = (("documents", "doc", "doc_id"), ("conversations", "conv", "conv_id"), ("pages", "page", "page_id"))
    made = [posts.shaped(read(spark, sf_dir, t).select(F.lit(s).alias("source"), F.col(k).alias("id"))) for t, s, k in parts]
    every = made[0].unionByName(made[1]).unionByName(made[2])
    return every.groupBy("source").agg(F.count("*").alias("posts"), F.count_distinct("id").alias("ids"))


@query("""WITH a AS (SELECT 'c' || item_id AS channel, 'own' AS name FROM benchmark UNION ALL SELECT '@DPS155', 'own'),
b AS (SELECT DISTINCT 'c' || (doc_id % 60) AS channel, 'set' AS name FROM documents)
SELECT channel, coalesce(b.name, a.name) AS name FROM a FULL JOIN b USING (channel) WHERE lower(ltrim(channel, '@')) <> 'dps155'""")
def channel_override(spark, sf_dir: str) -> DataFrame:
    """Default channels overridden by configured ones, without the excluded."""
    channel = lambda n: F.concat(F.lit("c"), n.cast("string")).alias("channel")  # noqa: E731
    own = read(spark, sf_dir, "benchmark").select(channel(F.col("item_id")))
    own = own.union(spark.createDataFrame([("@DPS155",)], "channel string")).withColumn("name", F.lit("own"))
    configured = read(spark, sf_dir, "documents").select(channel(F.col("doc_id") % 60)).distinct()
    return posts.channels(own, configured.withColumn("name", F.lit("set")))


@query(f"""WITH RECURSIVE {STORIES}, b AS (SELECT id::INT AS rank, 'k' || (id % 8) AS topic_key, t, s, row_number() OVER (ORDER BY id) AS n FROM lt ORDER BY id LIMIT {rank.SHOWN}),
c AS (SELECT y.n, list(x.n) AS l FROM b x JOIN b y ON x.n < y.n AND (x.topic_key = y.topic_key
  OR (len(list_intersect(x.t, y.s)) >= 3 AND len(list_intersect(x.t, y.s)) >= 0.4::DOUBLE * greatest(len(x.t), 1))
  OR (len(list_intersect(y.t, x.s)) >= 3 AND len(list_intersect(y.t, x.s)) >= 0.4::DOUBLE * greatest(len(y.t), 1))) GROUP BY y.n),
k AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT k.n + 1, CASE WHEN c.l IS NOT NULL AND list_has_any(k.kept, c.l) THEN k.kept ELSE list_append(k.kept, k.n + 1) END
  FROM k LEFT JOIN c ON c.n = k.n + 1 WHERE k.n < (SELECT count(*) FROM b))
SELECT rank, topic_key, CASE WHEN row_number() OVER (ORDER BY rank) <= {rank.FIRST} THEN 'send' ELSE 'mark' END AS delivery
FROM b WHERE list_contains((SELECT kept FROM k ORDER BY n DESC LIMIT 1), n)""")
def delivery_batch(spark, sf_dir: str) -> DataFrame:
    """Of the first documents in rank order those that repeat no earlier one, and what is sent."""
    left, _ = stories(spark, sf_dir)
    shown = left.orderBy("id").limit(rank.SHOWN).select(
        F.col("id").cast("int").alias("rank"), F.concat(F.lit("k"), (F.col("id") % 8).cast("string")).alias("topic_key"),
        F.array(F.concat(F.lit("m"), F.col("id").cast("string"))).alias("member_keys"),
        X.story_terms(F.col("title"), P).alias("title_terms"),
        X.story_terms(F.concat_ws(" ", "title", "story"), P).alias("story_terms"),
    )  # fmt: skip
    return rank.first_delivery(rank.fresh_in_batch(shown))


#: The feed whose documents are the ranked topics; what the other feeds had was sent before.
FEED = "src0"


def _same(a: str, b: str) -> str:
    one = lambda x, y: f"(len(list_intersect({x}.t, {y}.s)) >= 3 AND len(list_intersect({x}.t, {y}.s)) >= 0.4::DOUBLE * greatest(len({x}.t), 1))"  # noqa: E731
    return f"({one(a, b)} OR {one(b, a)})"


@query(f"""WITH RECURSIVE {STORIES}, d AS (SELECT lt.*, source, lang, row_number() OVER (PARTITION BY source = '{FEED}' ORDER BY id) AS rank FROM lt JOIN documents ON doc_id = id),
b0 AS (SELECT rank::INT AS rank, 'k' || id AS topic_key, 'm' || id AS member, 'n' || (id % 16) AS other, t, s FROM d WHERE source = '{FEED}' AND rank <= {rank.SHOWN}),
b AS (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM b0 x WHERE NOT EXISTS (SELECT 1 FROM rt WHERE {_same("x", "rt")})
  AND NOT EXISTS (SELECT 1 FROM d WHERE d.source <> '{FEED}' AND {_same("x", "d")}) AND x.member NOT IN (SELECT 'm' || (item_id * 11) FROM benchmark)
  AND x.topic_key NOT IN (SELECT 'k' || (page_id * 7) FROM pages)),
c AS (SELECT y.n, list(x.n) AS l FROM b x JOIN b y ON x.n < y.n AND (x.other = y.other OR {_same("x", "y")}) GROUP BY y.n),
k AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT k.n + 1, CASE WHEN c.l IS NOT NULL AND list_has_any(k.kept, c.l) THEN k.kept ELSE list_append(k.kept, k.n + 1) END
  FROM k LEFT JOIN c ON c.n = k.n + 1 WHERE k.n < (SELECT count(*) FROM b))
SELECT rank, topic_key, 'send' AS delivery FROM b WHERE list_contains((SELECT kept FROM k ORDER BY n DESC LIMIT 1), n)""")
def delivery_after_others(spark, sf_dir: str) -> DataFrame:
    """What is delivered of one feed's documents where the others' stories were sent before, with
    keys and members that were, and a registry."""
    left, right = stories(spark, sf_dir)
    docs = left.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    i = F.col("id").cast("string")
    own = docs.where(F.col("source") == FEED).orderBy("id").limit(rank.SHOWN)  # the feature: as many are ranked
    topics_ = own.select(
        F.row_number().over(W.orderBy("id")).alias("rank"), F.concat(F.lit("k"), i).alias("topic_key"), "title", "story",
        F.array(F.concat(F.lit("m"), i), F.concat(F.lit("n"), (F.col("id") % 16).cast("string"))).alias("member_keys"), F.lit(True).alias("linked"),
    )  # fmt: skip
    key = lambda word, c: F.concat(F.lit(word), c.cast("string")).alias("key")  # noqa: E731
    state = delivery.State(
        read(spark, sf_dir, "pages").select(key("k", F.col("page_id") * 7)),
        read(spark, sf_dir, "benchmark").select(key("m", F.col("item_id") * 11)),
        rank.postings(docs.where(F.col("source") != FEED).select("id", "title", "story"), P),
        initialized=True,
    )
    none = topics_.select("rank", F.lit("").alias("url")).where("url <> ''")
    return delivery.batch(topics_, none, right.withColumn("url", F.lit("")), state, P)


@query("""WITH c AS (SELECT 'src' || (item_id % 30) AS name FROM benchmark GROUP BY ALL), f AS (SELECT source AS name, min(doc_id) AS id FROM documents GROUP BY source)
SELECT c.name, f.id, f.id IS NULL AS missing FROM c LEFT JOIN f USING (name)""")
def group_lookup(spark, sf_dir: str) -> DataFrame:
    """Configured groups with their ids, and those that weren't found."""
    names = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 30).cast("string")).alias("name")).distinct()
    found = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("id"))
    gone = lookups.missing(names, found).withColumn("missing", F.lit(True))
    rows = lookups.resolved(names, found).join(gone, "name", "left")
    return rows.select("name", "id", F.coalesce("missing", F.lit(False)).alias("missing"))


@query("""SELECT DISTINCT user_id, event_type FROM events e WHERE ts < TIMESTAMP '2024-01-20' AND EXISTS (SELECT 1 FROM events t
  WHERE t.user_id = e.user_id AND t.event_type = e.event_type AND t.ts >= TIMESTAMP '2024-01-29')""")
def still_seen(spark, sf_dir: str) -> DataFrame:
    """Remembered keys that the last days' posts still have."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    at = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp_ntz")  # noqa: E731
    seen = events.where(F.col("ts") < at("2024-01-20")).select("user_id", "event_type").distinct()
    return lookups.still_seen(seen, events.where(F.col("ts") >= at("2024-01-29")), ["user_id", "event_type"])


def conversation_topics(spark, sf_dir: str) -> DataFrame:
    """Conversations as topics: turns are members, the user's turns have an address."""
    rows = read(spark, sf_dir, "conversations")
    c = F.col("conv_id").cast("string")
    url = F.when(F.col("role") == "user", F.concat(F.lit("http://c/"), c, F.lit("/"), F.col("turn").cast("string")))
    post = F.struct(F.col("role").alias("source"), F.when(F.col("turn") % 3 != 2, F.col("turn")).alias("id"), url.alias("url"), "text", F.lit(None).cast("string").alias("source_name"))
    nested = topics.gathered(rows, "conv_id", "turn", post)
    return nested.select(
        "conv_id", "members", F.col("members")[0]["text"].alias("text"),
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("http://p/"), F.col("conv_id").cast("string"))).alias("primary_url"),
        F.when(F.col("conv_id") % 3 == 0, "assistant").alias("primary_source"), F.array().cast("array<string>").alias("source_urls"),
    )  # fmt: skip


@query(r"""WITH m AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN 'http://c/' || conv_id || '/' || turn END AS url,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
t AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'http://p/' || conv_id END AS pu, CASE WHEN conv_id % 3 = 0 THEN 'assistant' ELSE '' END AS ps,
  arg_min(text, turn) AS text FROM m GROUP BY conv_id),
s AS (SELECT t.conv_id, t.text AS topic_text, pu, ps, m.text AS mtext, m.url AS murl, m.role, row_number() OVER (PARTITION BY t.conv_id ORDER BY (ps <> '' AND m.role = ps) DESC, place) AS n
  FROM t JOIN m USING (conv_id)),
c AS (SELECT *, coalesce(pu, murl, '') AS url FROM s WHERE n = 1),
k AS (SELECT conv_id, CASE WHEN turn % 3 <> 2 THEN role || ':' || turn ELSE url END AS k FROM m UNION ALL SELECT conv_id, nullif(url, '') FROM c),
a AS (SELECT conv_id, array_to_string(list_sort(list_distinct(list(k) FILTER (k IS NOT NULL))), ' ') AS member_keys FROM k GROUP BY conv_id),
l AS (SELECT c.*, coalesce(list_extract(list_filter(list_transform(regexp_split_to_array(coalesce(topic_text, ''), '[

]'), lambda x: trim(x)), lambda x: x <> ''), 1), '') AS line FROM c)
SELECT l.conv_id, CASE WHEN url <> '' THEN url ELSE substr(FOLDED, 1, 240) END AS key, member_keys,
  CASE WHEN l.conv_id % 2 = 0 THEN 'Г: ' ELSE '' END || trim(regexp_replace(line, '\s+', ' ', 'g')) || chr(10) || chr(10) || 'Источник: ' || url AS message,
  CASE WHEN role IS NULL OR ps <> '' THEN CASE WHEN ps = '' THEN 'Источник' ELSE ps END ELSE 'Источник' END AS name
FROM l JOIN a USING (conv_id)""".replace("FOLDED", _folded("line")))
def topic_messages(spark, sf_dir: str) -> DataFrame:
    """Keys, source and message of each conversation as a topic."""
    rows = conversation_topics(spark, sf_dir)
    label = F.when(F.col("conv_id") % 2 == 0, "first")
    made = rows.select("conv_id", delivery.keys().alias("k"), delivery.message(label, {"first": "Г:"}).alias("message"), delivery.source_of().alias("s"))
    return made.select("conv_id", "k.key", F.array_join("k.member_keys", " ").alias("member_keys"), "message", "s.name")


@query(f"""WITH j AS (SELECT conv_id, lower(string_agg(coalesce(text, ''), ' ' ORDER BY turn)) AS t, count(*) FILTER (role = 'user') > 0 OR conv_id % 4 = 0 AS linked
  FROM conversations GROUP BY conv_id)
SELECT conv_id FROM j WHERE conv_id % 7 <> 0 AND conv_id % 5 <> 1 AND (conv_id % 200) * 100 BETWEEN 0 AND 10800 AND linked
  AND NOT {_any(P.excluded)} AND NOT {_any(P.promo)} AND NOT {_pattern(P.promo_patterns)}""")
def actionable_topics(spark, sf_dir: str) -> DataFrame:
    """Conversations that could be delivered as topics."""
    i = F.col("conv_id")
    score = F.when(i % 5 != 1, F.lit(1.0))
    rows = conversation_topics(spark, sf_dir)
    holds = delivery.actionable(-(i % 200) * 100, F.lit(0), i % 7 != 0, score, P, rows.schema)
    return rows.where(holds).select("conv_id")


MODELS = [("north", 3, 40, 0.5, [0.1, 0.5]), ("north", 1, 35, 0.0, [0.0, -0.2]), ("south", 3, 50, 2.0, [-0.5, 2.0])]


@query("""WITH m(audience, horizon, samples, scale, b0, b1) AS (VALUES ('north', 3, 40, 0.5::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE),
  ('north', 1, 35, 0.0, 0.0, -0.2), ('south', 3, 50, 2.0, -0.5, 2.0)),
f AS (SELECT doc_id, least(length(coalesce(text, '')), 2000) / 2000.0::DOUBLE AS x FROM documents),
p AS (SELECT *, greatest(0.0::DOUBLE, exp(b0 + b1 * x) - 1) AS v FROM f, m)
SELECT doc_id, audience, horizon::INT AS horizon, round(v, 6) AS predicted, round(least(100.0, 100.0 * v / greatest(scale, 1e-6::DOUBLE)), 1) AS priority, samples::INT AS training_samples FROM p""")
def audience_predictions(spark, sf_dir: str) -> DataFrame:
    """Predictions of every audience's models."""
    rows = [(a, h, n, s, ["intercept", "text_length"], b) for a, h, n, s, b in MODELS]
    models = spark.createDataFrame(rows, "audience string, horizon int, samples int, scale double, features array<string>, coefficients array<double>")
    made = model.features(F.col("text"), F.lit(0), P)
    docs = read(spark, sf_dir, "documents").select("doc_id", *[made[n].alias(n) for n in ("intercept", "text_length")])
    found = lookups.audience_scores(docs, models, ["intercept", "text_length"])
    return found.select("doc_id", "audience", "horizon", F.round("predicted", 6).alias("predicted"), "priority", "training_samples")


# From posts to a queue

#: The time of the run, the day it is in, and when each document was posted: some on other days.
RUN, DAY = 1_705_320_000, "2024-01-15"


def _isolated() -> str:
    start = RUN - 18 * 3600  # midnight at six hours from UTC
    posts = f"SELECT doc_id, text, source, ts FROM (SELECT *, {RUN} - (doc_id * 7919) % 90000 AS ts FROM documents) WHERE ts >= {start} AND ts < {start + 86400}"
    clusters = CLUSTERS.replace("FROM documents)", "FROM posts)").replace("WITH RECURSIVE ", f"WITH RECURSIVE posts AS ({posts}), ")
    rules = _rules(P, f"SELECT doc_id, source, {NORM.format("coalesce(text, '')")} AS t FROM posts").replace("n AS (", "n2 AS (", 1).replace("FROM n)", "FROM n2)")
    hook = " + ".join(f"CASE WHEN {_any(w)} THEN {n} ELSE 0 END" for n, w in P.hooks).replace("contains(t,", "contains(joined,")
    kinds = " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w, _ in P.events)
    impacts = " ".join(f"WHEN {_any(w)} THEN {i}" for _, w, i in P.events)
    spread = "100.0 * (1.0 - exp(-(sources - 1) / 2.0::DOUBLE))"
    return f"""{clusters}, {rules},
j AS (SELECT t.root AS topic, d.*, ts, coalesce(text, '') AS raw FROM t JOIN d ON d.doc_id = t.pos JOIN posts USING (doc_id)),
a AS (SELECT topic, bool_and(help) AS help_only, bool_and(complaint AND NOT official) AS complaint_only, bool_and(opinion) AS opinion_only, bool_and(ad) AS ad_only,
  bool_and(away) AS nonlocal_only, bool_and(excluded) AS excluded_only, round(avg(confidence), 1) AS confidence, arg_min(content_type, doc_id) AS first_type,
  count(*) AS posts, max(ts) AS newest, count(DISTINCT nullif(lower(trim(source)), '')) AS sources, bool_or(contains(t, '{P.local_name}')) AS named,
  {NORM.format("string_agg(raw, ' ' ORDER BY doc_id)")} AS joined, lower(arg_min(raw, doc_id) || '     ' || string_agg(raw || '   ', ' ' ORDER BY doc_id)) AS t FROM j GROUP BY topic),
b AS (SELECT *, CASE WHEN help_only THEN 'help_request' WHEN complaint_only THEN 'complaint' WHEN opinion_only THEN 'opinion' WHEN ad_only THEN 'advertising'
  WHEN nonlocal_only THEN 'nonlocal' ELSE first_type END AS content_type, round(({hook}) * 0.35::DOUBLE, 1) AS viral, greatest(0, ({RUN} - newest) / 60.0::DOUBLE) AS age,
  CASE WHEN nonlocal_only THEN 0 WHEN named THEN 100 ELSE 30 END AS locality FROM a),
v AS (SELECT *, round(round(viral * 0.5::DOUBLE + (locality * 0.6::DOUBLE + viral * 0.4::DOUBLE) * 0.5::DOUBLE, 1) * 0.72::DOUBLE
  + round(greatest(0, 100.0::DOUBLE * (1 - age / 180.0::DOUBLE)), 1) * 0.28::DOUBLE, 1) AS score FROM b),
w AS (SELECT *, CASE WHEN excluded_only OR ad_only OR help_only THEN 'reject' WHEN complaint_only AND (viral >= 60 OR posts >= 3) THEN 'take_now'
  WHEN complaint_only OR opinion_only OR nonlocal_only THEN 'reject' WHEN confidence <= 25 AND viral >= 60 THEN 'take_now' WHEN score >= 45 THEN 'take_now' ELSE 'reject' END AS status,
  CASE WHEN {_any(P.excluded)} OR excluded_only THEN 'excluded_topic' WHEN {_any(P.promo)} OR {_pattern(P.promo_patterns)} THEN 'promotional'
  WHEN ad_only OR content_type = 'advertising' THEN 'advertising' WHEN nonlocal_only THEN 'nonlocal_topic' WHEN help_only OR content_type = 'help_request' THEN 'help_request'
  WHEN content_type = 'opinion' OR opinion_only THEN 'opinion' END AS exclusion, CASE WHEN {_pattern(P.fatal)} THEN 'fatal_incident' {kinds} ELSE 'general' END AS class,
  CASE WHEN {_pattern(P.fatal)} THEN 100.0 {impacts} ELSE 20.0 END::DOUBLE AS impact, greatest(0, 100.0::DOUBLE * (1 - age / 180.0::DOUBLE)) AS fresh,
  CASE WHEN nonlocal_only THEN 0.0 WHEN {_any(P.local_scoring)} THEN 80.0 ELSE 30.0 END::DOUBLE AS near FROM v),
y AS (SELECT *, round((fresh * 0.2::DOUBLE + near * 0.16::DOUBLE + impact * 0.16::DOUBLE + CASE WHEN sources > 0 THEN {spread} * 0.06::DOUBLE ELSE 0 END)
  / (0.52::DOUBLE + CASE WHEN sources > 0 THEN 0.06::DOUBLE ELSE 0 END), 1) AS mean FROM w),
p AS (SELECT *, CASE WHEN exclusion IS NULL THEN round(least(100, CASE WHEN {_pattern([P.interview])} AND {_pattern([P.sport])} THEN least(mean, 40) WHEN {_pattern([P.announcement])} THEN least(mean, 42) ELSE mean END
  + CASE WHEN content_type = 'complaint' AND (posts >= 3 OR sources >= 3) THEN 8 ELSE 0 END), 1) END AS priority_score FROM y)
SELECT topic, posts, content_type, confidence, viral, score, status, exclusion, class, priority_score,
  CASE WHEN exclusion IS NULL THEN CASE WHEN priority_score >= 70 THEN 'high' WHEN priority_score >= 45 THEN 'medium' ELSE 'low' END END AS label,
  CASE WHEN exclusion IS NULL THEN CASE WHEN priority_score >= 45 THEN 'take_now' ELSE 'reject' END END AS decision,
  CASE WHEN exclusion IS NULL THEN row_number() OVER (PARTITION BY exclusion IS NULL ORDER BY priority_score DESC, score DESC, topic) END AS place FROM p"""


@query(_isolated())
def isolated_queue(spark, sf_dir: str) -> DataFrame:
    """The documents of one day from classification to the ranked queue, at a given time."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    at = (F.lit(RUN) - (F.col("doc_id") * 7919) % 90000).cast("long")
    posts_ = docs.select(F.col("doc_id").alias("pos"), "text", "source", at.alias("timestamp"))
    names = ["topic", "posts", "content_type", "confidence", "viral", "score", "status", "exclusion", "class", "priority_score", "label", "decision", "place"]
    return isolated.queue(posts_, RUN, DAY, P).select(*names)
