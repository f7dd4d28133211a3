"""Updates of the registry in order, by the rule gone through one by one."""

import random

from newsloom.operators import registry

SHAPE = "pos long, title string, status string, category string, url string, story string"


def expected(records, updates):
    norm = lambda t: " ".join((t or "").casefold().split())
    out = [{"title": t or "", "status": s, "category": c or "", "url": u or "", "story": x or "", "change": "kept"} for _, t, s, c, u, x in sorted(records)]
    for _, title, status, category, url, story in sorted(updates, key=lambda u: u[0]):
        title, url = (title or "").strip(), (url or "").strip()
        if not title:
            continue
        old = next((r for r in out if (url and r["url"] == url) or norm(r["title"]) == norm(title)), None)
        if old is None:
            out.append({"title": title, "status": status, "category": category or "", "url": url, "story": story or "", "change": "inserted"})
        elif status == "rejected" and old["status"] == "published":
            old["change"] = "refused" if old["change"] == "kept" else old["change"]
        else:
            old |= {"status": status, "category": category or old["category"], "url": url or old["url"], "story": story or old["story"]}
            old["change"] = "updated" if old["change"] in ("kept", "refused") else old["change"]
    return sorted(map(repr, (tuple(r[c] for c in (*registry.RECORD, "change")) for r in out)))


def check(spark, records, updates):
    found = registry.upsert(spark.createDataFrame(records, SHAPE), spark.createDataFrame(updates, SHAPE)).collect()
    assert sorted(repr(tuple(r[c] for c in (*registry.RECORD, "change"))) for r in found) == expected(records, updates)


def test_several_updates_of_a_record(spark):
    """Published then rejected stays published; a url moves a record on; an empty title is refused."""
    records = [(1, "Bridge", "rejected", "", "u1", ""), (2, "Fire", "published", "c", "", "s"), (3, "", "rejected", "", "u9", "")]
    updates = [(1, "x", "published", "", "u1", ""), (2, " BRIDGE ", "rejected", "", "", ""), (3, "New one", "rejected", "", "u5", "a"), (4, "other", "published", "k", "u5", "b")]
    updates += [(5, "Bridge", "published", "", "u6", ""), (6, "y", "rejected", "", "u1", ""), (7, "  ", "published", "", "u6", ""), (8, None, "published", None, "u9", None), (9, "z", "published", "", "u9", "")]
    check(spark, records, updates)


def test_at_random(spark):
    rng = random.Random(2)
    made = lambda k: (k, rng.choice(["", None, *[f"{rng.choice(['T', 't '])} {n}" for n in range(12)]]), rng.choice(["published", "rejected"]), rng.choice(["", "a", "b"]), rng.choice(["", None, *[f"u{n}" for n in range(9)]]), rng.choice(["", "s", "t"]))
    for _ in range(2):
        check(spark, [made(k) for k in range(15)], [made(k) for k in range(60)])


def test_none(spark):
    none, some = spark.createDataFrame([], SHAPE), spark.createDataFrame([(1, "t", "published", "", "", "")], SHAPE)
    assert registry.upsert(none, none).count() == 0
    assert [r["change"] for r in registry.upsert(some, none).collect()] == ["kept"]
    assert [r["change"] for r in registry.upsert(none, some).collect()] == ["inserted"]


def test_postings_follow_the_records(spark, tmp_path):
    """A story that an update replaces is no longer met, a version made again replaces itself."""
    from dataclasses import replace

    from newsloom.functions.packs import CORPUS
    from newsloom.operators import rank
    from newsloom.operators.postings import Stored

    pack = replace(CORPUS, stopwords=(), suffixes=("zzz",))
    stored = Stored(spark, f"file://{tmp_path}/registry", pack)
    first = [(1, "alpha bravo charlie", "rejected", "", "u1", "delta echoes zulus"), (2, "kilos limas mikes", "published", "", "", "novembers")]
    second = [(1, "alpha bravo charlie", "rejected", "", "", "other words here"), (2, "quebec romeo sierra", "rejected", "", "u3", "tango")]
    stored.change(spark.createDataFrame(first, SHAPE), 1)
    for _ in range(2):
        stored.change(spark.createDataFrame(second, SHAPE), 2)
    topics = [(1, "delta echoes zulus", "alpha bravo"), (2, "alpha bravo charlie", ""), (3, "sierra romeo quebec", "x"), (4, "none", "of these"), (5, "any", "thing"), (6, "other words here", "")]
    frame = spark.createDataFrame(topics, "id long, title string, story string")
    urls = spark.createDataFrame([(5, "u3"), (4, "u9")], "id long, url string")
    for version in (0, 1, 2):
        records = stored.records(version).selectExpr("pos as id", "title", "story", "url")
        want = {r["id"] for r in rank.not_in_registry(frame, urls, records, pack).collect()}
        assert {r["id"] for r in stored.unknown(frame, urls, version).collect()} == want
    assert want == {1, 4} and {r["id"] for r in stored.unknown(frame, urls, 1).collect()} == {3, 4, 5, 6}


def test_stories_are_compared_only_where_no_address_tells(spark, monkeypatch):
    from newsloom.functions.packs import CORPUS
    from newsloom.operators import rank

    met, own = [], rank.story_links
    monkeypatch.setattr(rank, "story_links", lambda left, *a: met.append(sorted(r["id"] for r in left.collect())) or own(left, *a))
    shape = "id long, title string, story string"
    topics = spark.createDataFrame([(1, "delta echo golf", ""), (2, "hotel india juliet", ""), (3, "kilo lima mike", "")], shape)
    urls = spark.createDataFrame([(1, "u1"), (1, "u2"), (3, "u9")], "id long, url string")
    records = spark.createDataFrame([(7, "hotel juliet india", "", ""), (8, "x", "", "u1"), (9, "y", "", "u2")], shape + ", url string")
    assert [r["id"] for r in rank.not_in_registry(topics, urls, records, CORPUS).collect()] == [3]
    assert met == [[2, 3]]
