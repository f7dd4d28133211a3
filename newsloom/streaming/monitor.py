"""The collecting loop as Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.text import civil
from newsloom.sources.documents import read_document, write_document

#: Seconds between polls, and how long a key is remembered.
PERIOD, REMEMBERED = 300, "1 day"


def new_posts(stream: DataFrame, at: str = "at", keys: tuple[str, ...] = ("source", "id"), hours: int | None = 6) -> DataFrame:
    """Posts whose key hasn't come on the same civil day at a fixed offset (``hours``; None: within
    a day): state is dropped behind the watermark."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    if hours is None:
        return timed.withWatermark(at, REMEMBERED).dropDuplicatesWithinWatermark(list(keys))
    day = F.to_date(civil(F.col(at), hours))
    watched = timed.withColumn("__day", day).withWatermark(at, REMEMBERED)
    return watched.dropDuplicatesWithinWatermark([*keys, "__day"]).drop("__day")


def by_civil_day(stream: DataFrame, at: str = "at", hours: int = 6, late: str = "10 minutes") -> DataFrame:
    """Posts per civil day at a fixed offset: tumbling windows that begin at local midnight."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, "1 day", startTime=f"{(24 - hours) % 24} hours")).agg(F.count("*").alias("posts"))


def rapid_spread(stream: DataFrame, topic: str, source: str, at: str = "at") -> DataFrame:
    """Sources per topic within half an hour, sliding by five minutes."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, "10 minutes")
    counted = timed.groupBy(F.window(at, "30 minutes", "5 minutes"), topic)
    return counted.agg(F.size(F.collect_set(source)).alias("sources"))


def run(stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Polls and publishes: a batch is published under its number, so a repeated one replaces
    itself, and progress is committed only after it."""
    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{PERIOD} seconds")
    return writer.start()


class Progress:
    """Two-phase progress that a restart can rely on: what is pending is on disk before it is
    done, so work that was cut short is done again, and publishing alone is repeated alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def pending(self) -> dict[str, bool]:
        state = json.loads(read_document(self.spark, self.path) or "{}")
        return {k: bool(state.get(k)) for k in ("pipeline", "publish")}

    def mark(self, pipeline: bool, publish: bool) -> None:
        write_document(self.spark, self.path, json.dumps({"pipeline": pipeline, "publish": publish}))

    def cycle(self, fresh: bool, pipeline: Callable[[], None], publish: Callable[[], None]) -> None:
        """One cycle: the pipeline runs if there are fresh posts or it was cut short, then the
        result is published; a failure leaves its phase pending and is raised."""
        state = self.pending()
        if fresh or state["pipeline"]:
            self.mark(True, False)
            pipeline()
            self.mark(False, True)
        elif not state["publish"]:
            return
        publish()
        self.mark(False, False)


def deliver(messages: DataFrame, send: Callable[[dict], bool], log: str, most: int = 10) -> int:
    """Sends the first ``most`` messages (rank, key, message) that the log table hasn't, in order,
    and adds each to the log before the next one is sent; how many were sent. A message that
    isn't taken ends the delivery."""
    spark = messages.sparkSession
    shape = "key string, rank int"
    spark.createDataFrame([], shape).write.mode("append").parquet(log)
    known = spark.read.schema(shape).parquet(log).select("key")
    sent = 0
    for row in messages.join(known, "key", "left_anti").orderBy("rank").limit(most).collect():
        if not send(row.asDict()):
            break
        spark.createDataFrame([(row["key"], row["rank"])], shape).coalesce(1).write.mode("append").parquet(log)
        sent += 1
    return sent


def to_folder(folder: str) -> Callable[[DataFrame, int], None]:
    """A publisher that keeps each batch in its own folder."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
