"""Deliveries against what is stored, by the rule gone through one by one."""

import random
from dataclasses import replace

from newsloom.functions.packs import CORPUS
from newsloom.functions.text import story_terms
from newsloom.operators import delivery, rank

PACK = replace(CORPUS, stopwords=(), suffixes=("zzz",))
TOPIC = "rank int, topic_key string, member_keys array<string>, title string, story string, linked boolean"


def alike(a, b):
    one = lambda x, y: len(x[0] & y[1]) >= 3 and len(x[0] & y[1]) >= 0.4 * max(1, len(x[0]))
    return one(a, b) or one(b, a)


def terms(title, story):
    own = set(title.split())
    return own, own | set(story.split())


def expected(topics, urls, records, sent, initialized):
    keys, members, stories = set(sent[0]), set(sent[1]), [terms(t, s) for t, s in sent[2]]
    fresh = []
    for r, key, own, title, story, linked in sorted(topics)[: rank.SHOWN]:
        told = terms(title, story)
        if any((u and (r, u) in urls) or alike(told, terms(t, s)) for t, s, u in records):
            continue
        if not key or key in keys or set(own) & members or not linked or any(alike(told, s) for s in stories):
            continue
        fresh.append((r, key))
        keys.add(key)
        members |= set(own)
        stories.append(told)
    return [(r, k, "send" if initialized or n < rank.FIRST else "mark") for n, (r, k) in enumerate(fresh)]


def test_batches_until_nothing_is_new(spark):
    """Two batches, the second with the first one's marks; later ones send all."""
    rng = random.Random(6)
    words = [f"word{k}" for k in range(25)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    records = [(k, said(4), said(6), rng.choice(["", "u1", "u2"])) for k in range(2)]
    sent = ([], [], [(said(4), said(5))])
    frames = lambda: delivery.State(
        spark.createDataFrame([(k,) for k in sent[0]], "key string"),
        spark.createDataFrame([(k,) for k in sent[1]], "key string"),
        rank.postings(spark.createDataFrame([(str(k), *s) for k, s in enumerate(sent[2])], "id string, title string, story string"), PACK),
        initialized,
    )
    for initialized in (False, True):
        topics = [(k, rng.choice(["", *[f"k{n}" for n in range(30)]]), [f"m{rng.randrange(25)}"], said(4), said(5), rng.random() < 0.9) for k in range(1, 14)]
        urls = {(k, rng.choice(["u1", "u3", "u4", "u5"])) for k in range(1, 14)}
        shown = spark.createDataFrame(topics, TOPIC)
        listed = spark.createDataFrame(sorted(urls), "rank int, url string")
        known = spark.createDataFrame(records, "id long, title string, story string, url string")
        got = delivery.batch(shown, listed, known, frames(), PACK)
        rows = sorted((r["rank"], r["topic_key"], r["delivery"]) for r in got.collect())
        assert rows == expected(topics, urls, [r[1:] for r in records], sent, initialized) and rows
        keys, members, stories = delivery.marks(shown, got, PACK)
        told = [t for t in topics if t[0] in {r[0] for r in rows}]
        assert sorted(r["key"] for r in keys.collect()) == sorted(t[1] for t in told)
        assert sorted(r["key"] for r in members.collect()) == sorted(m for t in told for m in t[2])
        assert {(r["id"], r["term"]) for r in stories.collect()} == {(t[1], w) for t in told for w in terms(t[3], t[4])[1]}
        sent = (sent[0] + [t[1] for t in told], sent[1] + [m for t in told for m in t[2]], sent[2] + [(t[3], t[4]) for t in told])


def test_terms_are_the_library_s(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("word1 word2 word1",)], "t string").select(story_terms(F.col("t"), PACK).alias("s")).first()
    assert set(row["s"]) == {"word1", "word2"}
