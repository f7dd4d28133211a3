"""Ranks over a whole table without bringing it to one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.durable import durable


#: Buckets that an interval of values is cut into at a pass.
BUCKETS = 4096


def values_at(df: DataFrame, column: str, places: list[int]) -> list[float]:
    """The values at ``places`` (from 1) of a column in order, nulls left out, NaN last.

    Each pass counts the values of the intervals that hold a wanted place, in buckets of like
    widths, and keeps of each wanted bucket its least and greatest value as the next interval, until
    these are one: all places narrow down together, each pass by a factor of 4,096. Counts are
    summed before the shuffle; no task holds more rows than there are buckets.
    """
    rows = durable(df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"))
    v, finite = F.col("v"), (F.col("v") > float("-inf")) & (F.col("v") < float("inf"))
    total = rows.agg(F.count_if(v == float("-inf")), F.count_if(finite), F.min(F.when(finite, v)), F.max(F.when(finite, v)), F.count_if(v == float("inf"))).first()
    low, n, least, most, high = total
    found: dict[int, float] = {}
    for place in places:
        if place <= low:
            found[place] = float("-inf")
        elif place > low + n:
            found[place] = float("inf") if place <= low + n + high else float("nan")
    open_ = {(least, most): low}  # an interval of values, and how many are less than all of it
    while any(p not in found for p in places):
        for (least, most), before in open_.items():
            if least == most:
                found |= {p: least for p in places if p not in found and p > before}
        open_ = {k: before for k, before in open_.items() if k[0] < k[1]}
        if not open_:
            break
        bucket, index = F.lit(None), F.lit(None)
        for number, (least, most) in enumerate(open_):
            # a quarter of everything, so that no difference overflows; each step keeps the order
            part = (v / 4 - F.lit(least) / 4) / (F.lit(most) / 4 - F.lit(least) / 4) * BUCKETS
            inside = (v >= least) & (v <= most)
            bucket = F.when(inside, F.least(F.floor(part), F.lit(BUCKETS - 1))).otherwise(bucket)
            index = F.when(inside, number).otherwise(index)
        cut = rows.select("v", index.cast("int").alias("i"), bucket.cast("int").alias("b")).where("i IS NOT NULL")
        counts = cut.groupBy("i", "b").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        after: dict[tuple[float, float], int] = {}
        for number, before in enumerate(open_.values()):
            for r in sorted((r for r in counts if r["i"] == number), key=lambda r: r["b"]):
                own = [p for p in places if p not in found and before < p <= before + r["n"]]
                if own and r["least"] == r["most"]:
                    found |= {p: r["least"] for p in own}
                elif own:
                    after[r["least"], r["most"]] = before
                before += r["n"]
        open_ = after
    return [found.get(p) for p in places]


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 1) in an order that has no ties.

    Rows are dealt by ranges of the order and sorted within them; the places follow from the
    rows' numbers within their ranges and the ranges' sizes, of which there are as many as
    partitions, so broadcasting them is bounded.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = durable(dealt.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = sorted(marked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for part_id, n in sizes:
        rows.append((part_id, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "__part long, __before long")
    inner = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    joined = marked.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__before") + inner + 1).drop("__part", "__before", "__id")


def chained(rows: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """``p, q``: each position with the one before it that has the same ``by`` (two numbers), and
    with a first one: that of its range. Ranges of the order cut groups of any size; a group that
    goes on in the next range is joined to its last position before, of which each range has one."""
    own = rows.select(F.col(by[0]).alias("k0"), F.col(by[1]).alias("k1"), F.col(pos).alias("p"))
    dealt = own.repartitionByRange("k0", "k1", "p").sortWithinPartitions("k0", "k1", "p")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None  # (key, position) of the last row so far, and of the first of its key

        def made(p, q, k0, k1, edge):
            columns = [pa.array(c, pa.int64()) for c in (p, q, k0, k1)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([edge] * len(p), pa.int32())], names=["p", "q", "k0", "k1", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k0, k1, p = (batch.column(c).to_numpy() for c in ("k0", "k1", "p"))
            if last is None:
                yield made(p[:1], p[:1], k0[:1], k1[:1], 1)
                last = first = (k0[0], k1[0], p[0])
                same0 = False
            else:
                same0 = (k0[0], k1[0]) == last[:2]
            same = np.r_[same0, (k0[1:] == k0[:-1]) & (k1[1:] == k1[:-1])]
            before = np.r_[last[2], p[:-1]]
            starts = np.where(same, 0, np.arange(len(p)))
            begin = np.maximum.accumulate(starts)
            heads = p[begin]
            if same0:
                heads = np.where((begin == 0), first[2], heads)
            x, y = np.r_[p[same], p[same]], np.r_[before[same], heads[same]]
            if len(x):
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
                x, y = x[new], y[new]
                yield made(x, y, np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0)
            first, last = (k0[-1], k1[-1], heads[-1]), (k0[-1], k1[-1], p[-1])
        if last is not None:
            yield made([last[2]], [last[2]], [last[0]], [last[1]], 2)

    found = durable(dealt.mapInArrow(run, "p long, q long, k0 long, k1 long, edge int"))
    ends, begins = (found.where(F.col("edge") == e) for e in (2, 1))
    ends = ends.select("k0", "k1", F.col("p").alias("end"))
    over = begins.join(ends, ["k0", "k1"]).where("end < p").groupBy("k0", "k1", "p").agg(F.max("end").alias("q"))
    return found.where("edge = 0").select("p", "q").union(over.select("p", "q")).where("q < p").distinct()
