"""Lookups against small tables of groups, audiences and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.order import numbered

#: Rows that a lookup table may have to be broadcast: beyond, the join shuffles.
BROADCAST = 10_000


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcasting if a count of at most BROADCAST + 1 rows shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def resolved(names: DataFrame, found: DataFrame) -> DataFrame:
    """Configured groups (name) with what the source answered (name, id); id null if nothing."""
    return names.join(small(found.select("name", "id")), "name", "left")


def missing(names: DataFrame, found: DataFrame) -> DataFrame:
    return names.join(found.select("name"), "name", "left_anti")


def still_seen(seen: DataFrame, today: DataFrame, keys: list[str]) -> DataFrame:
    """Of the keys that are remembered those that today's posts still have."""
    return seen.join(today.select(*keys), keys, "left_semi")


def batched(df: DataFrame, by: str, id: str, size: int = 100) -> DataFrame:
    """Distinct (by, id) rows with the ``batch`` of at most ``size`` ids of one ``by`` in which an
    interface is asked for them."""
    placed = numbered(df.select(by, id).distinct(), [by, id])
    first = placed.groupBy(by).agg(F.min("place").alias("first"))
    return placed.join(small(first), by).select(by, id, F.floor((F.col("place") - F.col("first")) / size).alias("batch"))


def audience_scores(topics: DataFrame, models: DataFrame, names: list[str]) -> DataFrame:
    """``topics`` by (audience, horizon) with the model's prediction and priority.

    ``models`` has audience, horizon, samples, scale, features and coefficients, one row per
    model; a model of other features predicts null from 0 samples.
    """
    vector = F.array(*[F.col(n).cast("double") for n in names])
    same = F.col("features") == F.array(*[F.lit(n) for n in names])
    dot = F.aggregate(F.zip_with("coefficients", vector, lambda b, x: b * x), F.lit(0.0), lambda a, b: a + b)
    value = F.when(same, F.greatest(F.lit(0.0), F.expm1(dot)))
    share = 100.0 * value / F.greatest(F.col("scale"), F.lit(1e-6))
    if models.limit(BROADCAST + 1).count() > BROADCAST:
        raise ValueError(f"more than {BROADCAST} models")
    rows = topics.crossJoin(F.broadcast(models))  # each row under each model: a stated, bounded set
    return rows.select(
        *topics.columns, "audience", "horizon", value.alias("predicted"),
        F.round(F.least(F.lit(100.0), share), 1).alias("priority"),
        F.when(same, F.col("samples")).otherwise(0).alias("training_samples"),
    )


def due_for_training(samples: DataFrame, models: DataFrame, features: list[str], least: int = 30) -> DataFrame:
    """(audience, horizon, n) that have enough rows and no model of as many rows and these features."""
    same = F.col("features") == F.array(*[F.lit(n) for n in features])
    current = models.where(same).select("audience", "horizon", F.col("samples").alias("n"))
    return samples.where(F.col("n") >= least).join(current, ["audience", "horizon", "n"], "left_anti")
