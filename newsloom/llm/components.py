"""Connected components of a graph whose vertices have bounded degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertex, label``: the least ``label`` that any vertex of the component had.

    ``vertices`` (vertex, label) has each vertex once; ``edges`` (a, b) may hold an edge once,
    several times or both ways. Labels spread along edges and then, in the same round, each label
    is replaced by the label of the vertex that gave it, so chains shorten fast. Rounds are cut
    by checkpoints; nothing but the number of changes reaches the driver. Joins on labels meet
    a component's rows on one side only, which adaptive execution splits.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = durable(both.where("a <> b").distinct())
    linked = both.select(F.col("a").alias("vertex")).distinct()
    state = durable(vertices.select("vertex", "label").join(linked, "vertex"))
    owner = durable(state.groupBy(F.col("label").alias("label0")).agg(F.min("vertex").alias("vertex0")))
    while True:
        near = both.join(state, both.b == state.vertex).groupBy("a").agg(F.min("label").alias("near"))
        spread = state.join(near, state.vertex == near.a).select(
            "vertex", F.least("label", "near").alias("label"), F.col("label").alias("was")
        )
        spread = durable(spread)
        # the vertex whose own label this is, and the label that this vertex has by now
        jump = spread.select(F.col("vertex").alias("vertex0"), F.col("label").alias("further")).join(owner, "vertex0")
        moved = spread.join(jump.select("label0", "further"), spread.label == F.col("label0"), "left").select(
            "vertex", F.coalesce(F.least("label", "further"), "label").alias("label"), "was"
        )
        moved = durable(moved)
        state = moved.select("vertex", "label")
        if not moved.where("not label <=> was").limit(1).count():
            break
        discard(vertices.sparkSession)
    rest = vertices.select("vertex", "label").join(linked, "vertex", "left_anti")
    return state.union(rest)
