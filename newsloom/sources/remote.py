"""Answers of a remote interface as a table: a data source whose partitions are the requests.

``spark.read.format("newsloom_remote")`` with the options ``call`` (module:function), ``requests``
(a JSON array of objects) and ``rows`` (the schema). The function gets a request and gives rows as
dicts; a call that fails is repeated after a pause, and a request is a task of its own.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def called(function: Callable, *arguments, retries: int = 2, pause: float = 1.0):
    """What the function gives; after a failure it is called again, ``retries`` times at most,
    with pauses of one, two, ... times ``pause`` seconds. The last failure is raised."""
    for attempt in range(retries + 1):
        try:
            return function(*arguments)
        except Exception:
            if attempt == retries:
                raise
            time.sleep(pause * (attempt + 1))


def checked(answer):
    """The response of an interface's answer; an error, or no object at all, is raised."""
    if not isinstance(answer, dict):
        raise RuntimeError("the answer isn't an object")
    if "error" in answer:
        error = answer["error"]
        raise RuntimeError(error.get("error_msg", str(error)) if isinstance(error, dict) else str(error))
    return answer.get("response")


class Request(InputPartition):
    def __init__(self, value: dict):
        self.value = value


class RemoteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, dict(options)

    def partitions(self) -> list[Request]:
        return [Request(r) for r in json.loads(self.options["requests"])]

    def read(self, partition: Request):
        module, _, name = self.options["call"].partition(":")
        function = getattr(importlib.import_module(module), name)
        rows = called(
            function, partition.value, retries=int(self.options.get("retries", 2)), pause=float(self.options.get("pause", 1.0))
        )
        for row in rows:
            yield tuple(row.get(n) for n in self.names)


class RemoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsloom_remote"

    def schema(self) -> str:
        return self.options["rows"]

    def reader(self, schema: StructType) -> RemoteReader:
        return RemoteReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RemoteSource)
