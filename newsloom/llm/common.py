"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns,
    whatever they are called, cannot clash with what the operator adds."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a single machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/newsloom-shared"
    return f"{base}/newsloom-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def discard(spark: SparkSession) -> None:
    """Has what nothing refers to any more removed now, shuffle files and broadcasts: Spark waits for
    the driver's garbage collection, which a driver of many small jobs sees seldom while it grows."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


_held: tuple = (None, None)


def held(key: tuple, make: Callable):
    """What ``make()`` gives, kept in this worker until another operator keeps something: the
    workers of an executor share its memory and run stage after stage."""
    global _held
    if _held[0] != key:
        release()
        _held = (key, make())
    return _held[1]


def release() -> None:
    """Gives what is held back to the system."""
    global _held
    if _held[0] is not None:
        _held = (None, None)
        gc.collect()
        with suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[pa.Table], pa.Table]], schema: str, rows: int = 512
) -> DataFrame:
    """Runs ``make()`` once per task and what it returns on slices of at most ``rows`` rows.

    Slices bound the working memory of a task however large Spark's Arrow batches are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from step(batch.slice(at, rows))

    return df.mapInArrow(run, schema)
