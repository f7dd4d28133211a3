"""JSON documents of posts and topics, and their sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

CONTAINERS = ("posts", "items", "data")
BUCKETS = ("take_now", "reject", "unconfirmed_signals", "check", "watch")


def rows_of(spark: SparkSession, path: str, row: StructType, containers: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """Rows of whole-file JSON documents: a list, or an object whose first present container
    holds one. Documents that are neither give none."""
    kind = ArrayType(row)
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", kind)
    inside = F.from_json("value", f"struct<{', '.join(f'{c}:{kind.simpleString()}' for c in containers)}>")
    is_list = F.ltrim("value").startswith("[")
    rows = F.when(is_list, listed).otherwise(F.coalesce(*[inside[c] for c in containers]))
    return whole.select(F.explode(rows).alias("row")).where("row is not null").select("row.*")


def topics_of(document: Column) -> Column:
    """A queue's topics, or its buckets one after the other if it has none."""
    own, buckets = document["topics"], [document[b] for b in BUCKETS]
    empty = F.filter(F.coalesce(own, *buckets), lambda _: F.lit(False))
    return F.when(F.size(own) > 0, own).otherwise(F.concat(*[F.coalesce(b, empty) for b in buckets]))


def decoded(content: Column) -> Column:
    """A base64 payload as text."""
    return F.decode(F.unbase64(content), "UTF-8")


def encoded(*columns: str) -> Column:
    """Columns as a JSON object in base64, the form in which a pool is published."""
    return F.base64(F.encode(F.to_json(F.struct(*columns)), "UTF-8"))


def envelope(value: Column, response: str) -> Column:
    """(response, problem) of an interface's answer: an object with a response of the given type,
    else why there is none."""
    error = F.get_json_object(value, "$.error")
    message = F.coalesce(F.get_json_object(value, "$.error.error_msg"), error)
    found = F.from_json(value, f"response {response}")["response"]
    problem = (
        F.when(value.isNull() | ~F.ltrim(value).startswith("{"), "not an object")
        .when(error.isNotNull(), message)
        .when(found.isNull(), "no response")
    )
    return F.struct(F.when(problem.isNull(), found).alias("response"), problem.alias("problem"))


def records_of(content: Column, record: str) -> Column:
    """Records of a registry file: an object with topics, in base64."""
    return F.from_json(decoded(content), f"topics array<{record}>")["topics"]


def config_of(value: Column) -> Column:
    """A configuration's keys and values as a map: of a JSON object, else none."""
    empty = F.create_map().cast("map<string,string>")
    found = F.when(F.ltrim(value).startswith("{"), F.from_json(value, "map<string,string>"))
    return F.coalesce(found, empty)


def _path(spark: SparkSession, path: str):
    """The path and its file system, whichever store it is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str) -> None:
    """Replaces a table as a whole. The new one is written beside it first; then the two change
    places by renaming, and the old one goes. A failure while writing leaves the old one as it
    was; one between the two renames leaves it under its second name, from which the next call
    takes it back if the path is missing."""
    spark = df.sparkSession
    here, fs = _path(spark, path)
    fresh, _ = _path(spark, f"{path}.new-{uuid.uuid4().hex}")
    old, _ = _path(spark, f"{path}.old")
    if fs.exists(old) and not fs.exists(here):
        fs.rename(old, here)
    df.write.parquet(fresh.toString())
    fs.delete(old, True)
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"{path} can't be renamed")
    if not fs.rename(fresh, here):
        raise OSError(f"{fresh.toString()} can't be renamed")
    fs.delete(old, True)


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small document atomically: to a file beside it, renamed over it."""
    here, fs = _path(spark, path)
    fresh, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(fresh, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = fs.makeQualified(here)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(
        fs.makeQualified(fresh), qualified, over
    )


def read_document(spark: SparkSession, path: str) -> str | None:
    """A small document; None if there is none."""
    here, fs = _path(spark, path)
    if not fs.exists(here):
        return None
    return spark.read.text(path, wholetext=True).first()["value"]


def append_lines(df: DataFrame, path: str, at: Column, message: Column) -> None:
    """Adds lines of time and message to a log."""
    df.select(F.concat_ws(" ", F.concat(F.lit("["), at, F.lit("]")), message).alias("value")).write.mode("append").text(path)


def create_or_update(client, path: str, content: str, attempts: int = 2) -> bool:
    """Puts base64 content where a versioned store has none, or over the version that it has;
    whether it was created. ``client.get(path)`` gives (version, content) or None, and
    ``client.put(path, content, version)`` raises Conflict if another version came between."""
    for attempt in range(attempts):
        held = client.get(path)
        try:
            client.put(path, content, held[0] if held else None)
            return held is None
        except Conflict:
            if attempt + 1 == attempts:
                raise
    return False


class Conflict(RuntimeError):
    """A versioned store has another version than the one to be replaced."""
