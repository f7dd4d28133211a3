"""The engagement model: ridge regression over a few features, and its evaluation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.order import numbered, values_at
from newsloom.functions.packs import Pack
from newsloom.functions.text import contains_any

#: Rows that a model needs, the ridge on all but the intercept, the share of rows to train on.
LEAST, RIDGE, TRAIN = 30, 0.1, 0.8


def features(text: Column, timestamp: Column, pack: Pack) -> dict[str, Column]:
    """Length, hour of the UTC day, and a flag for each group of words."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")
    hour = F.pmod(F.floor(timestamp / 3600), F.lit(24))
    out = {
        "intercept": F.lit(1.0),
        "text_length": F.least(F.length(F.coalesce(text, F.lit(""))), F.lit(2000)) / 2000.0,
        "hour_sin": F.sin(hour * (2 * math.pi) / 24),
        "hour_cos": F.cos(hour * (2 * math.pi) / 24),
    }
    return out | {f"topic_{n}": contains_any(t, words).cast("double") for n, words in pack.features}


def target(score: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), score))


def gram(df: DataFrame, names: list[str], y: str) -> DataFrame:
    """``i, j, value``: sums of products of the features (i <= j), and with the target (j is
    ``y``); one aggregation whose size the rows don't change."""
    columns = [*names, y]
    sums = [
        F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.sum(F.col(a) * F.col(b)).alias("value"))
        for k, a in enumerate(names)
        for b in columns[k:]
    ]
    return df.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("one")).select("one.*")


@dataclass
class Ridge:
    """Coefficients with their names, rows learned from, and the scale of a full score."""

    names: list[str]
    coefficients: list[float]
    samples: int
    scale: float

    def logged(self) -> Column:
        total = F.lit(0.0)
        for name, b in zip(self.names, self.coefficients, strict=True):
            total = total + F.col(name) * b
        return total

    def predicted(self) -> Column:
        return F.greatest(F.lit(0.0), F.expm1(self.logged()))

    def priority(self) -> Column:
        share = 100.0 * self.predicted() / max(self.scale, 1e-6)
        return F.round(F.least(F.lit(100.0), share), 1)


def fit(df: DataFrame, names: list[str], y: str, least: int = LEAST) -> Ridge | None:
    """The ridge solution of the normal equations; None under ``least`` rows."""
    n = df.count()
    if n < least:
        return None
    d = len(names)
    x, rhs, at = np.zeros((d, d)), np.zeros(d), {name: k for k, name in enumerate(names)}
    for row in gram(df, names, y).collect():  # d * (d + 3) / 2 numbers
        i = at[row["i"]]
        if row["j"] == y:
            rhs[i] = row["value"]
        else:
            x[i, at[row["j"]]] = x[at[row["j"]], i] = row["value"]
    x[np.arange(1, d), np.arange(1, d)] += RIDGE
    high = nth(df, y, min(n - 1, int(0.9 * n)) + 1)
    return Ridge(names, solved(x, rhs).tolist(), n, max(math.expm1(high), 1e-6))


def solved(x: np.ndarray, rhs: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """The solution of the equations by elimination with the largest pivot of each column. Without
    a pivot the column is passed over, and what is left of the right side stands for its value."""
    rows = np.column_stack([x, rhs]).astype(float)
    for k in range(len(rhs)):
        at = k + int(np.abs(rows[k:, k]).argmax())
        if abs(rows[at, k]) < least:
            continue
        rows[[k, at]] = rows[[at, k]]
        rows[k] /= rows[k, k]
        others = np.arange(len(rhs)) != k
        rows[others] -= np.outer(rows[others, k], rows[k])
    return rows[:, -1]


def nth(df: DataFrame, column: str, place: int) -> float:
    """The value at a place (from 1) of a column in order."""
    return values_at(df, column, [place])[0]


def split(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place`` in time and whether it ``trains``: the first rows do, the last test."""
    placed = numbered(df, order)
    n = placed.count()
    cut = max(1, min(n - 1, int(n * TRAIN)))
    return placed.withColumn("trains", F.col("place") <= cut)


def spearman(df: DataFrame, a: str, b: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Correlation of ordinal ranks, ties in the order of ``tie``; null if it isn't defined.

    Ranks are places in the whole table ordered by the groups first: within a group they are the
    group's ranks and a constant, which correlation doesn't see.
    """
    by = by or []
    ranked = numbered(numbered(df.select(*by, a, b, tie), [*by, a, tie], "ra"), [*by, b, tie], "rb")
    ra, rb = (F.col(c).cast("double") for c in ("ra", "rb"))
    sums = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.covar_pop(ra, rb).alias("cov"), (F.stddev_pop(ra) * F.stddev_pop(rb)).alias("spread")
    )
    value = F.when(F.col("n") >= 2, F.try_divide("cov", F.nullif("spread", F.lit(0.0))))
    return sums.select(*by, "n", value.alias("spearman"))


def training_rows(observations: DataFrame, hours: int, other: int = 1) -> DataFrame:
    """Observations whose hour is complete and has a score, with ``score``, and whether the other
    hour is complete too (``paired``)."""
    done = observations.where(F.col(f"completed_{hours}h") & F.col(f"score_{hours}h").isNotNull())
    return done.select("*", F.col(f"score_{hours}h").alias("score"), F.col(f"completed_{other}h").alias("paired"))


def evaluate(
    df: DataFrame, names: list[str], y: str, score: str, audience: str, order: list[str], paired: str | None = None
) -> DataFrame | None:
    """How the ridge of the first rows predicts the rest: one row for all (audience null) and one
    for each audience, the errors for all alone. None under ``LEAST`` rows.

    ``score`` is the heuristic that the model is compared with, null as 0; ``paired`` names the
    flag of the rows that have the other horizon too: then only those count.
    """
    rows = df.where(F.col(paired)) if paired else df
    if rows.count() < LEAST:
        return None
    rows = split(rows, order)
    train = rows.where("trains")
    fitted = fit(train, names, y, 1)
    middle = F.lit(nth(train, y, fitted.samples // 2 + 1))  # the upper one
    test = rows.where("not trains").select(
        F.col(audience).alias("audience"), "place", F.col(y).alias("y"), fitted.logged().alias("predicted"),
        F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"),
    )
    own, base = F.avg(F.abs(F.col("y") - F.col("predicted"))), F.avg(F.abs(F.col("y") - middle))
    errors = test.agg(
        F.round(own, 6).alias("mae_model"), F.round(base, 6).alias("mae_median"),
        F.round(F.try_divide(100 * (base - own), F.nullif(base, F.lit(0.0))), 2).alias("improvement"),
    )

    def ranks(by: list[str]) -> DataFrame:
        found = [
            spearman(test, a, "y", "place", by).select(*by, F.col("n").alias("test_rows"), F.round("spearman", 4).alias(f"spearman_{name}"))
            for a, name in (("predicted", "model"), ("score", "score"))
        ]
        if not by:
            return found[0].crossJoin(found[1].drop("test_rows")).withColumn("audience", F.lit(None).cast(test.schema["audience"].dataType))
        return found[0].join(found[1].drop("test_rows"), by)

    out = ranks([]).crossJoin(errors).unionByName(ranks(["audience"]), allowMissingColumns=True)
    return out.withColumn("train_rows", F.lit(fitted.samples).cast("long"))
