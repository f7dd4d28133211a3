"""The registry of published and rejected topics."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions.durable import durable
from newsloom.functions.text import normalized_title


def decided(records: DataFrame) -> DataFrame:
    return records.where(F.col("status").isin("published", "rejected"))


def _parts(keyed: DataFrame) -> DataFrame:
    """``id, part``: rows (id, keys) that share a key, directly or through others, have one part,
    the least id. Labels spread by keys, and then each is replaced by its own label."""
    met = durable(keyed.select("id", F.explode("keys").alias("key")))
    state = durable(keyed.select("id", F.col("id").alias("part")))
    while True:
        least = met.join(state, "id").groupBy("key").agg(F.min("part").alias("least"))
        near = met.join(least, "key").groupBy("id").agg(F.min("least").alias("least"))
        spread = durable(state.join(near, "id", "left").select("id", F.coalesce("least", "part").alias("next"), F.col("part").alias("was")))
        further = spread.select(F.col("id").alias("at"), F.col("next").alias("further"))
        moved = durable(spread.join(further, spread.next == F.col("at")).select("id", F.least("next", "further").alias("part"), "was"))
        state = moved.select("id", "part")
        if not moved.where("part <> was").limit(1).count():
            return state


RECORD = ("title", "status", "category", "url", "story")


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order, each its records and then its updates: the records as the updates leave them.
    Only a part's records are held; titles don't change, so the first of a title is known, while
    the places of an address are kept in order."""
    here, records, titles, places = None, [], {}, {}

    def made():
        columns = [pa.array([r[c] for r in records], pa.string()) for c in (*RECORD, "change")]
        return pa.RecordBatch.from_arrays([pa.array([r["pos"] for r in records], pa.int64()), *columns], names=["pos", *RECORD, "change"])

    def added(row: dict, change: str) -> None:
        at = len(records)
        records.append({c: row[c] for c in ("pos", *RECORD)} | {"change": change})
        if row["key"]:
            titles.setdefault(row["key"], at)
        if row["url"]:
            places.setdefault(row["url"], []).append(at)

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != here:
                if records:
                    yield made()
                here, records, titles, places = row["part"], [], {}, {}
            if not row["new"]:
                added(row, "kept")
                continue
            found = [x for x in (titles.get(row["key"]), next(iter(places.get(row["url"], ())), None)) if x is not None]
            if not found:
                added(row, "inserted")
                continue
            at = min(found)
            old = records[at]
            if row["status"] == "rejected" and old["status"] == "published":
                old["change"] = "refused" if old["change"] == "kept" else old["change"]
                continue
            if row["url"] and row["url"] != old["url"]:
                if old["url"]:
                    places[old["url"]].remove(at)
                insort(places.setdefault(row["url"], []), at)
                old["url"] = row["url"]
            old["status"] = row["status"]
            for c in ("category", "story"):
                old[c] = row[c] or old[c]
            old["change"] = "updated" if old["change"] in ("kept", "refused") else old["change"]
    if records:
        yield made()


def upsert(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """``registry`` (pos, title, status, category, url, story) after ``updates`` of the same shape
    in the order of their ``pos``, with ``change``: inserted (under the update's ``pos``); updated, if any update applied;
    refused, if there were only such that reject what is published; else kept.

    An update goes to the first record that has its url or its title (case folded, white space
    collapsed), those that the updates inserted included; without one it is inserted. What is
    published isn't rejected any more, empty values don't overwrite, a url that is given does. An
    update without a title is refused and leaves no trace. Updates and records that share a title or
    a url, also through others, are gone through in one task, in order; records that none meets
    stay where they are. A null value counts as empty.
    """
    def stated(rows: DataFrame, new: bool) -> DataFrame:
        value = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RECORD}
        if new:
            value |= {"title": X.collapsed_ends(value["title"]), "url": X.collapsed_ends(value["url"]), "story": X.clean_start(value["story"], 900)}
        out = rows.select(F.struct(F.lit(new).alias("new"), F.col("pos").cast("long").alias("pos")).alias("id"), *[v.alias(c) for c, v in value.items()])
        return out.withColumn("key", normalized_title(F.col("title")))

    old, fresh = stated(registry, False), stated(updates, True).where("key <> ''")
    every = durable(old.union(fresh))
    named = lambda kind, c: F.when(F.col(c) != "", F.concat(F.lit(kind), c))
    keyed = every.select("id", F.array_compact(F.array(named("t", "key"), named("u", "url"))).alias("keys"))
    placed = durable(every.join(_parts(keyed), "id"))
    met = placed.where("id.new").select("part").distinct()
    kept = placed.join(met, "part", "left_anti").select(F.col("id.pos").alias("pos"), *RECORD, F.lit("kept").alias("change"))
    order = ["part", "new", "pos"]
    rows = placed.join(met, "part", "left_semi").select(F.to_json("part").alias("part"), "id.new", "id.pos", *RECORD, "key")
    dealt = rows.repartition("part").sortWithinPartitions(*order)
    return kept.union(dealt.mapInArrow(_folded, "pos long, " + ", ".join(f"{c} string" for c in (*RECORD, "change"))))


def outcomes(updates: DataFrame, delivered: DataFrame, home: str) -> DataFrame:
    """``updates`` (update_id, chat_id, text, message_id of what is answered) with ``outcome``, as
    if handled in order: a start is greeted in the home chat and told the chat's number elsewhere;
    other chats and texts are skipped; + and - mark the delivered message (chat_id, message_id),
    a repeated mark changes nothing, and what is published isn't rejected any more."""
    text = F.trim(F.coalesce("text", F.lit("")))
    start = F.regexp_extract(text, r"^(\S+)", 1).rlike("^/start(?:@.*)?$")
    known = delivered.select("chat_id", "message_id").distinct().withColumn("known", F.lit(True))
    rows = updates.join(known, ["chat_id", "message_id"], "left").withColumn("mark", F.when(F.col("known") & text.isin("+", "-") & (F.col("chat_id") == home), text))
    # earlier marks of the same message; rows without a mark need no window and would share a key
    before = W.partitionBy("chat_id", "message_id").orderBy("update_id").rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda mark: F.coalesce(F.max(F.col("mark") == mark).over(before), F.lit(False))
    marked = rows.where("mark is not null").select("*", earlier("+").alias("published"), earlier("-").alias("rejected"))
    plus = F.when(F.col("published"), "already_published").otherwise("published")
    minus = F.when(F.col("published"), "refused").when(F.col("rejected"), "already_rejected").otherwise("rejected")
    marked = marked.withColumn("outcome", F.when(F.col("mark") == "+", plus).otherwise(minus))
    here = F.col("chat_id") == home
    other = F.when(start & here, "greeted").when(start, "chat_id_told").when(~here | ~text.isin("+", "-"), "skipped").otherwise("usage_hint")
    rest = rows.where("mark is null").withColumn("outcome", other)
    return marked.select(*updates.columns, "outcome").union(rest.select(*updates.columns, "outcome"))


def offsets(updates: DataFrame, by: list[str]) -> DataFrame:
    """``next_offset`` and ``handled`` updates (update_id, ok): all before the first that failed
    are handled, and the next poll begins there, or after the last."""
    failed = F.min(F.when(~F.col("ok"), F.col("update_id")))
    ends = updates.groupBy(*by).agg(failed.alias("failed"), F.max("update_id").alias("last"))
    rows = updates.join(ends, by).groupBy(*by).agg(
        F.coalesce(F.first("failed"), F.first("last") + 1).alias("next_offset"),
        F.count_if(F.col("failed").isNull() | (F.col("update_id") < F.col("failed"))).alias("handled"),
    )
    return rows


def answered(replies: DataFrame, delivered: DataFrame) -> DataFrame:
    """Each reply with the message it answers (chat and message id), or a hint if there is none."""
    joined = replies.join(delivered, ["chat_id", "message_id"], "left")
    status = F.when(F.col("symbol") == "+", "published").when(F.col("symbol") == "-", "rejected")
    return joined.withColumn(
        "outcome", F.when(F.col("topic").isNull(), "unknown_message").otherwise(F.coalesce(status, F.lit("usage_hint")))
    )
