"""Cutting a long lineage so that a lost executor costs little."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset on a single machine, a place in
    its temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return base or f"file://{tempfile.gettempdir()}/newsloom-shared"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share."""
    return f"{_base(spark)}/newsloom-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint below the cluster's ``spark.checkpoint.dir``; where that is unset on
    a single machine, below its temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_base(df.sparkSession))
    return df.checkpoint(eager=True)


def discard(spark: SparkSession) -> None:
    """Has what nothing refers to any more removed now, shuffle files and broadcasts: Spark waits for
    the driver's garbage collection, which a driver of many small jobs sees seldom while it grows."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
