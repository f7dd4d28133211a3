"""Feeds and messages as posts."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import collapsed, first_filled
from newsloom.operators.lookups import small
from newsloom.operators.posts import shaped, wall_date


def feed_time(value: Column) -> Column:
    """Epoch seconds of an RFC 2822 or ISO 8601 time; null if it is neither. The name of the day
    is taken off first, and a missing zone counts as UTC."""
    bare = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3}, *", "")
    zoned = F.regexp_replace(bare, r" (?:GMT|UTC|UT)$", " +0000")
    mail = [F.try_to_timestamp(zoned, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")]
    return F.unix_seconds(F.coalesce(*mail, F.try_to_timestamp(value)))


def stable_id(link: Column) -> Column:
    """60 bits of the link's SHA-256."""
    return F.conv(F.substring(F.sha2(link, 256), 1, 15), 16, 10).cast("long")


def entries(feeds: DataFrame) -> DataFrame:
    """``url, name, pos`` and the texts of each entry of RSS or Atom feeds (url, name, body). Tags
    count without their namespace; of repeated tags the last text counts, but the first link's
    address. A body that isn't XML has no entries."""
    fields = ("title", "description", "summary", "content", "link", "pubdate", "published", "updated", "date")

    def tag(element) -> str:
        return element.tag.rpartition("}")[2].lower() if isinstance(element.tag, str) else ""

    def of(body: str) -> list[dict]:
        try:
            root = ElementTree.fromstring(body)
        except (ElementTree.ParseError, TypeError):
            return []
        out = []
        for element in (e for e in root.iter() if tag(e) in ("item", "entry")):
            found = {tag(child): (child.text or "").strip() for child in element}
            link = next((child for child in element if tag(child) == "link"), None)
            if link is not None and "href" in link.attrib:
                found["link"] = link.attrib["href"]
            out.append({f: found.get(f) for f in fields})
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                {"url": r.url, "name": r.name, "pos": k, **e}
                for r in batch.itertuples(index=False)
                for k, e in enumerate(of(r.body))
            ]
            yield pd.DataFrame(rows, columns=["url", "name", "pos", *fields])

    schema = "url string, name string, pos int, " + ", ".join(f"`{f}` string" for f in fields)
    return feeds.select("url", "name", "body").mapInPandas(run, schema)


def from_feeds(feeds: DataFrame) -> DataFrame:
    """Posts of feeds; entries without title, link or time are left out."""
    summary = F.coalesce(first_filled(F.col("description"), F.col("summary"), F.col("content")), F.lit(""))
    date = first_filled(F.col("pubdate"), F.col("published"), F.col("updated"), F.col("date"))
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    rows = entries(feeds).withColumn("timestamp", feed_time(date))
    rows = rows.where("title <> '' and link <> '' and timestamp <> 0")
    return shaped(
        rows.select(
            F.concat(F.lit("rss_"), host).alias("source"),
            stable_id(F.col("link")).alias("id"),
            F.coalesce(first_filled(F.col("name")), host).alias("source_name"),
            F.lit("regional_media").alias("source_type"),
            "timestamp",
            wall_date(F.col("timestamp")).alias("date"),
            collapsed(F.concat(F.col("title"), F.lit("\n"), summary)).alias("text"),
            F.col("link").alias("url"),
        )
    )


def from_channels(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Posts of channel messages (channel, id, timestamp, message, media_type) with the channels'
    names (channel, name). Messages without text and channels with an impossible address are left
    out; numbered channels lose their prefix."""
    bare = F.ltrim(F.trim("channel"), F.lit("@"))
    valid = bare.rlike(r"^(?:(?:-100)?[0-9]+|[A-Za-z0-9_]+)$")
    key = F.regexp_replace(bare, "^-100", "")
    numbered = bare.rlike(r"^(?:-100)?[0-9]+$")
    rows = messages.join(small(names), "channel").where(valid & (F.trim("message") != ""))
    place = F.when(numbered, F.concat(F.lit("https://t.me/c/"), key)).otherwise(F.concat(F.lit("https://t.me/"), bare))
    return shaped(
        rows.select(
            F.concat(F.lit("tg_"), key).alias("source"),
            "id",
            F.coalesce(first_filled(F.col("name")), bare).alias("source_name"),
            F.lit("telegram").alias("source_type"),
            "timestamp",
            wall_date(F.col("timestamp")).alias("date"),
            F.trim("message").alias("text"),
            F.concat(place, F.lit("/"), F.col("id").cast("string")).alias("url"),
            "media_type",
        )
    )
