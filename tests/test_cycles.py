"""Topics by cycles are those of all posts at once."""

import random
from dataclasses import replace

from newsloom.functions.packs import CORPUS
from newsloom.operators import cluster
from newsloom.streaming import topics
from newsloom.streaming.monitor import run

PACK = replace(CORPUS, anchors=("anch", "orst"), same_event=("school", ("fire", "burnt")), strong_event=("stormy", "flood", "rescue", "bridge"))
PARTS = ["school", "fire", "burnt", "12", "15", "anchor", "orstem", "stormy", "flood", "rescue", "bridge", *[f"word{k:02}" for k in range(30)]]


def texts(n, seed):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    return [out[rng.randrange(k + 1)] if rng.random() < 0.3 else t for k, t in enumerate(out)]  # copies


def test_cycles_and_restarts(spark, tmp_path, monkeypatch):
    """Cycles of several sizes, one of them repeated, across a compaction; also an empty one."""
    monkeypatch.setattr(topics, "EVERY", 2)
    rows = list(enumerate(texts(90, 3)))
    want = {r["pos"]: r["root"] for r in cluster.topics(spark.createDataFrame(rows, "pos long, text string"), PACK, "pos").collect()}
    index, got = topics.Index(spark, f"file://{tmp_path}/index", PACK), {}
    for number, (a, b) in enumerate([(0, 40), (40, 55), (55, 55), (55, 90)]):
        for _ in range(2 if number == 1 else 1):
            found = index.cycle(spark.createDataFrame(rows[a:b], "pos long, text string"), number).collect()
        got |= {r["pos"]: r["root"] for r in found}
    assert got == want
    assert {r["pos"]: r["root"] for r in index.posts(4).collect()} == want


def test_stream(spark, tmp_path):
    """A stream stopped between its batches goes on where it was."""
    rows = list(enumerate(texts(60, 8)))
    shape = "pos long, text string"
    want = {r["pos"]: r["root"] for r in cluster.topics(spark.createDataFrame(rows, shape), PACK, "pos").collect()}
    index, got = topics.Index(spark, f"file://{tmp_path}/index", PACK), {}

    def out(found, number):
        got.update({r["pos"]: r["root"] for r in found.collect()})

    for part in (rows[:35], rows[35:]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
        run(stream, index.publisher(out), f"{tmp_path}/checkpoint", once=True).awaitTermination()
    assert got == want
