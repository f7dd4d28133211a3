"""Ranking topics, and keeping those that are new."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.durable import durable
from newsloom.functions.order import numbered
from newsloom.functions.packs import Pack
from newsloom.functions.text import story_terms

#: Samples that make a model usable, minutes of rapid spread, its sources, minutes of freshness.
SAMPLES, SPREAD_MINUTES, SPREAD_SOURCES, FRESH_MINUTES = 30, 30, 3, 180
#: Topics that are shown, and sent at the first delivery.
SHOWN, FIRST = 10, 3


def recent_sources(df: DataFrame, key: str, now: Column, source: str = "source", timestamp: str = "timestamp") -> DataFrame:
    """Distinct sources of each topic within the last half hour."""
    age = now - F.col(timestamp)
    name = F.nullif(F.lower(F.trim(F.col(source).cast("string"))), F.lit(""))
    recent = F.when((age >= 0) & (age <= SPREAD_MINUTES * 60), name)
    return df.groupBy(key).agg(F.count_distinct(recent).alias("recent_sources"))


def strongest(models: dict[str, tuple[Column, Column]]) -> Column:
    """(score, label) of the strongest usable audience model, null without one. ``models`` gives
    (score, samples) by label; of equals the first counts, and two within 0.05 share a label."""
    usable = {k: F.when((n >= SAMPLES) & s.isNotNull(), s) for k, (s, n) in models.items()}
    names, values = list(usable), list(usable.values())
    best = F.greatest(*values) if len(values) > 1 else values[0]
    label = None
    for name, value in usable.items():
        label = F.when(value == best, name) if label is None else label.when(value == best, name)
    if len(values) == 2:
        label = F.when(F.abs(values[0] - values[1]) < 0.05, "/".join(names)).otherwise(label)
    return F.when(best.isNotNull(), F.struct(best.alias("score"), label.alias("label")))


def is_fresh(newest: Column, now: Column) -> Column:
    return (now - newest >= 0) & (now - newest <= FRESH_MINUTES * 60)


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place`` in an order without ties, over ranges rather than in one task."""
    return numbered(df, list(order))


def top(df: DataFrame, order: list[Column], limit: int, name: str) -> DataFrame:
    """A display list: the first rows with their ``place`` under a name; each task keeps ``limit``."""
    rows = df.orderBy(*order).limit(limit)
    return rows.select(F.lit(name).alias("list"), F.row_number().over(W.orderBy(*order)).alias("place"), *df.columns)


def ranked(df: DataFrame, tie: str, limit: int = SHOWN) -> DataFrame:
    """The first topics by rapid spread, recent sources, all sources, model and priority, with
    ``rank``; ties stay in the order of ``tie``. A sort and limit, so each task keeps ``limit``."""
    order = [
        F.desc(F.col("recent_sources") >= SPREAD_SOURCES),
        F.desc("recent_sources"),
        F.desc("sources"),
        F.desc("model_score"),
        F.desc("priority_score"),
        F.asc(tie),
    ]
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def told_by(titles: DataFrame, stories: DataFrame) -> DataFrame:
    """``a, b``: titles (id, terms, n) that share three terms, and two fifths of their n, with the
    terms ``all`` of stories (id, all). ``terms`` may lack some of the n that no story has."""
    need = F.greatest(F.lit(3), F.ceil(F.col("n") * 0.4).cast("int"))
    titles = titles.where(F.size("terms") >= need).select(F.col("id").alias("a"), "terms", "n", need.alias("need"))
    stories = stories.select(F.col("id").alias("b"), "all")
    told = stories.select("b", F.explode("all").alias("term"))
    often = told.groupBy("term").agg(F.count("*").alias("df"))
    # who shares enough terms shares one of the rarest: frequent ones need no join
    listed = titles.select("a", "need", F.explode("terms").alias("term")).join(often, "term", "left")
    rare = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("rare")
    prefix = F.slice("rare", 1, F.size("rare") - F.col("need") + 1)
    shown = listed.groupBy("a", "need").agg(rare).select("a", F.explode(prefix).alias("r")).select("a", "r.term")
    candidates = shown.join(told, "term").select("a", "b").distinct()
    shared = F.size(F.array_intersect("terms", "all"))
    both = candidates.join(titles, "a").join(stories, "b")
    return both.where((shared >= 3) & (shared >= 0.4 * F.col("n"))).select("a", "b")


def stated(rows: DataFrame, pack: Pack) -> DataFrame:
    """``id, terms, n, all`` of stories (id, title, story): the title's terms, how many, and all."""
    every = story_terms(F.concat_ws(" ", "title", "story"), pack)
    told = rows.select("id", story_terms(F.col("title"), pack).alias("terms"), every.alias("all"))
    return durable(told.select("id", "terms", F.size("terms").alias("n"), "all"))


def story_links(left: DataFrame, right: DataFrame, pack: Pack) -> DataFrame:
    """``left_id, right_id`` of the same story: (id, title, story) rows where one's title shares
    three terms and two fifths of its own with the other's title and story."""
    left, right = stated(left, pack), stated(right, pack)
    there = told_by(left, right).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"))
    back = told_by(right, left).select(F.col("b").alias("left_id"), F.col("a").alias("right_id"))
    return there.union(back).distinct()


def not_in_registry(topics: DataFrame, urls: DataFrame, records: DataFrame, pack: Pack) -> DataFrame:
    """Topics (id, title, story) that no record (id, title, story, url) has, by any of the topic's
    ``urls`` (id, url) or as the same story."""
    known = records.where("url <> ''").select("url").distinct()
    by_url = urls.join(known, "url", "left_semi").select("id").distinct()
    topics = topics.join(by_url, "id", "left_anti")  # stories are compared only where no address tells
    linked = story_links(topics.select("id", "title", "story"), records.select("id", "title", "story"), pack)
    return topics.join(linked.select(F.col("left_id").alias("id")), "id", "left_anti")


def fresh_in_batch(shown: DataFrame) -> DataFrame:
    """Of the ranked topics (rank, topic_key, member_keys, title_terms, story_terms), at most
    ``SHOWN`` rows, those that no earlier kept one repeats: by key, by a member or as a story.
    A dropped topic drops none itself, so the rows are gone through in order, in one group."""

    def alike(a, b) -> bool:
        one = lambda t, s: len(t & s) >= 3 and len(t & s) >= 0.4 * max(1, len(t))
        return one(a[0], b[1]) or one(b[0], a[1])

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        keys, met, stories, kept = set(), set(), [], []
        for r in rows.sort_values("rank").itertuples():
            own, story = set(r.member_keys), (set(r.title_terms), set(r.story_terms))
            if not r.topic_key or r.topic_key in keys or own & met or any(alike(story, s) for s in stories):
                continue
            keys.add(r.topic_key)
            met |= own
            stories.append(story)
            kept.append((r.rank, r.topic_key))
        return pd.DataFrame(kept, columns=["rank", "topic_key"])

    bounded = shown.orderBy("rank").limit(SHOWN).withColumn("one", F.lit(1))
    return bounded.groupBy("one").applyInPandas(keep, "rank int, topic_key string")


def postings(stories: DataFrame, pack: Pack) -> DataFrame:
    """``term, id, of_title, terms`` of stories (id, title, story): a row for each term, whether the
    title has it and how many the title has. Kept with what is sent, it is what later batches meet."""
    every = story_terms(F.concat_ws(" ", "title", "story"), pack)
    rows = stories.select("id", story_terms(F.col("title"), pack).alias("own"), every.alias("all"))
    each = rows.select("id", "own", F.explode(F.array_union("own", "all")).alias("term"))
    return each.select("term", "id", F.array_contains("own", F.col("term")).alias("of_title"), F.size("own").alias("terms"))


def told_before(shown: DataFrame, sent: DataFrame) -> DataFrame:
    """``rank`` of the topics (rank, title_terms, story_terms), at most ``SHOWN`` rows, that are the
    same story as one whose :func:`postings` are in ``sent``. Only postings of the topics' own terms
    are met; they are counted before the shuffle."""
    bounded = shown.orderBy("rank").limit(SHOWN)
    own = bounded.select("rank", F.col("title_terms").alias("title"), F.array_union("title_terms", "story_terms").alias("all"))
    terms = own.select("rank", F.size("title").alias("n"), "title", F.explode("all").alias("term"))
    terms = terms.select("rank", "n", "term", F.array_contains("title", F.col("term")).alias("mine"))
    met = sent.join(F.broadcast(terms), "term")
    counts = met.groupBy("rank", "id", "n", "terms").agg(F.count_if("mine").alias("mine"), F.count_if("of_title").alias("theirs"))
    enough = lambda m, n: (F.col(m) >= 3) & (F.col(m) >= 0.4 * F.greatest(F.lit(1), F.col(n)))
    return counts.where(enough("mine", "n") | enough("theirs", "terms")).select("rank").distinct()


def first_delivery(fresh: DataFrame, first: int = FIRST) -> DataFrame:
    """What is sent at the start, and what is only marked as sent."""
    place = F.row_number().over(W.orderBy("rank"))
    return fresh.withColumn("delivery", F.when(place <= first, "send").otherwise("mark"))
