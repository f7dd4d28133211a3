"""The post, and normalising what sources deliver to it."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.order import numbered
from newsloom.functions.text import civil, first_filled

COUNTERS = ("views", "likes", "comments", "reposts")
POST = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("media_type", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
    ]
)
# Names of the fields that are dropped at any depth, and of those that are read.
LEGACY = (
    "verification_required",
    "publish_disclaimer_required",
    "disclaimer_required",
    "verification_note",
    "verification_status",
)
SOURCE_KEYS = ("source", "source_name", "group_name", "community_name", "source_id", "group_id")
TEXT_KEYS = ("text", "description", "content", "post_text", "message")


def first_of(df: DataFrame, keys) -> Column:
    """The first filled of those of the keys that the table has."""
    here = [F.col(k) for k in keys if k in df.columns]
    return F.coalesce(first_filled(*here), F.lit("")) if here else F.lit("")


def wall_date(timestamp: Column, hours: int = 6) -> Column:
    """The wall clock at a fixed offset as text, of epoch seconds."""
    return F.date_format(civil(F.timestamp_seconds(timestamp).cast("timestamp_ntz"), hours), "yyyy-MM-dd HH:mm:ss")


def shaped(df: DataFrame) -> DataFrame:
    """The columns of a post in order, missing ones null."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in POST]
    )


def from_wall(raw: DataFrame, group: Column, owned: bool = False) -> DataFrame:
    """Posts of a wall (id, date, text, owner_id and nested counts). Counters of other people's
    audiences are forgotten; of ``owned`` ones a missing count is zero."""
    counts = {
        c: F.coalesce(F.col(f"{c}.count"), F.lit(0)) if owned else F.lit(None).cast("long") for c in COUNTERS
    }
    return shaped(
        raw.select(
            group.alias("source"),
            F.col("id").cast("long").alias("id"),
            F.lit("social").alias("source_type"),
            F.col("date").cast("long").alias("timestamp"),
            wall_date(F.col("date")).alias("date"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.concat(F.lit("https://vk.ru/wall"), F.col("owner_id").cast("string"), F.lit("_"), F.col("id").cast("string")).alias("url"),
            *[v.cast("long").alias(c) for c, v in counts.items()],
        )
    )


def media_type(photo: Column, mime: Column, has_document: Column, preview: Column, media: Column) -> Column:
    """The kind of an attachment, most specific first; null without any."""
    return (
        F.when(~media, F.lit(None).cast("string"))
        .when(photo, "photo")
        .when(has_document & mime.startswith("video/"), "video")
        .when(has_document & mime.startswith("image/"), "image")
        .when(has_document, "document")
        .when(preview, "link_preview")
        .otherwise("media")
    )


def without_legacy(df: DataFrame) -> DataFrame:
    """Old verification fields go from the rows, from members and from the posts in them; a
    publication mode that only asked for verification becomes null."""

    def stripped(kind: T.DataType, value: Column) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: stripped(kind.elementType, x))
        if isinstance(kind, T.StructType):
            kept = [f for f in kind.fields if f.name not in LEGACY]
            made = F.struct(*[of(f, value[f.name]).alias(f.name) for f in kept])
            return F.when(value.isNotNull(), made)
        return value

    def of(field: T.StructField, value: Column) -> Column:
        if field.name == "publication_mode":
            return F.when(value != "verification_required", value)
        return stripped(field.dataType, value)

    return df.select(*[of(f, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields if f.name not in LEGACY])


def of_day(df: DataFrame, day: str, hours: int = 6, timestamp: str = "timestamp") -> DataFrame:
    """Posts of one civil day at a fixed offset, as a range of the column itself, which reaches
    the scan. The column holds epoch seconds, of which only positive ones count, or UTC times
    without a zone."""
    start = datetime.fromisoformat(day) - timedelta(hours=hours)
    at = F.col(timestamp)
    if isinstance(df.schema[timestamp].dataType, T.TimestampNTZType):
        edges = [F.lit(x).cast("timestamp_ntz") for x in (start.isoformat(), (start + timedelta(days=1)).isoformat())]
        return df.where((at >= edges[0]) & (at < edges[1]))
    first = int(start.replace(tzinfo=timezone.utc).timestamp())
    return df.where((at > 0) & (at >= first) & (at < first + 86400))


def latest(df: DataFrame, keys, order) -> DataFrame:
    """The last row of each key. Aggregates before the shuffle, so a frequent key stays small."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("kept")
    return df.groupBy(*keys).agg(picked).select(*keys, "kept.*").select(*df.columns)


def unseen(df: DataFrame, seen: DataFrame, keys, order) -> DataFrame:
    """Rows whose key isn't in ``seen``, the first of each key."""
    fresh = df.join(seen.select(*keys).distinct(), list(keys), "left_anti")
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("kept")
    return fresh.groupBy(*keys).agg(picked).select(*keys, "kept.*").select(*df.columns)


def in_order(parts: list[DataFrame], pos: str) -> DataFrame:
    """All posts of the groups in the groups' order, each group's by ``pos``, with ``place``."""
    every = None
    for k, part in enumerate(parts):
        numbered_part = part.withColumn("group", F.lit(k))
        every = numbered_part if every is None else every.unionByName(numbered_part)
    return numbered(every, ["group", pos]).drop("group")


def channels(default: DataFrame, configured: DataFrame, excluded: tuple[str, ...] = ("dps155",)) -> DataFrame:
    """``channel, name``: defaults overridden by configured ones, without the excluded."""
    a, b = default.select("channel", F.col("name").alias("own")), configured.select("channel", F.col("name").alias("set"))
    both = a.join(b, "channel", "full").select("channel", F.coalesce("set", "own").alias("name"))
    bare = F.lower(F.ltrim(F.trim("channel"), F.lit("@")))
    return both.where(~bare.isin(*excluded))
