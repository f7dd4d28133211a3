import json
import os

from pyspark.sql import functions as F

from newsloom.streaming import monitor, tracker


def stream_of(spark, tmp_path, schema, batches):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate(batches):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(folder / f"{k}.json", (10**9 + k, 10**9 + k))  # files come in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def collected(spark, stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode)
    query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_repeated_posts_come_once(spark, tmp_path):
    rows = [[{"source": "a", "id": 1, "at": "2024-01-01T00:00:00"}], [{"source": "a", "id": 1, "at": "2024-01-01T01:00:00"}, {"source": "a", "id": 2, "at": "2024-01-01T01:00:00"}]]
    stream = stream_of(spark, tmp_path, "source string, id long, at timestamp_ntz", rows)
    assert sorted(r["id"] for r in collected(spark, monitor.new_posts(stream), tmp_path, "new_posts")) == [1, 2]


def test_civil_days_begin_at_18_utc(spark, tmp_path):
    rows = [[{"id": k, "at": t} for k, t in enumerate(("2024-01-01T17:59:59", "2024-01-01T18:00:00", "2024-01-02T17:00:00"))]]
    stream = monitor.by_civil_day(stream_of(spark, tmp_path, "id long, at timestamp_ntz", rows))
    got = collected(spark, stream, tmp_path, "days", "complete")
    assert sorted((r["window"]["start"].hour, r["posts"]) for r in got) == [(18, 1), (18, 2)]


def test_batches_are_published_under_their_number(spark, tmp_path):
    rows = [[{"id": 1}], [{"id": 2}]]
    stream = stream_of(spark, tmp_path, "id long", rows)
    monitor.run(stream, monitor.to_folder(str(tmp_path / "out")), str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted((r["id"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 0), (2, 1)]


def test_first_seen_stream(spark, tmp_path):
    rows = [[{"audience": "a", "post_id": p} for p in (1, 2)], [{"audience": a, "post_id": p} for a, p in (("a", 2), ("a", 3), ("b", 1))]]
    stream = stream_of(spark, tmp_path, "audience string, post_id long", rows)
    out = str(tmp_path / "out")
    publish = tracker.first_seen(spark, str(tmp_path / "seen"), out)
    monitor.run(stream, publish, str(tmp_path / "cp"), once=True).awaitTermination()
    assert [(r["audience"], r["post_id"]) for r in spark.read.parquet(out).collect()] == [("a", 3)]
    publish(spark.createDataFrame([("a", 3), ("a", 2)], "audience string, post_id long"), 1)  # a repeated batch
    assert [(r["audience"], r["post_id"]) for r in spark.read.parquet(out).collect()] == [("a", 3)]


def test_a_key_counts_again_on_the_next_civil_day(spark, tmp_path):
    rows = [[{"source": "a", "id": 1, "at": t}] for t in ("2024-01-01T17:00:00", "2024-01-01T17:59:00", "2024-01-01T18:30:00")]
    stream = stream_of(spark, tmp_path, "source string, id long, at timestamp_ntz", rows)
    got = collected(spark, monitor.new_posts(stream), tmp_path, "day_posts")
    assert sorted((r["at"].hour, r["at"].minute) for r in got) == [(17, 0), (18, 30)]


def test_rapid_spread_counts_sources_in_sliding_windows(spark, tmp_path):
    rows = [[{"topic": "t", "source": s, "at": f"2024-01-01T10:{m:02d}:00"} for s, m in (("a", 0), ("b", 20), ("b", 25), ("c", 40))]]
    stream = stream_of(spark, tmp_path, "topic string, source string, at timestamp_ntz", rows)
    got = collected(spark, monitor.rapid_spread(stream, "topic", "source"), tmp_path, "spread", "complete")
    found = {(r["window"]["start"].hour, r["window"]["start"].minute): r["sources"] for r in got}
    assert found[10, 0] == 2 and found[10, 15] == 2 and found[10, 30] == 1 and found[9, 35] == 1


def test_progress_survives_failures(spark, tmp_path):
    progress = monitor.Progress(spark, f"file://{tmp_path}/state/pending.json")
    done = []

    def fails():
        raise RuntimeError("cut short")

    for pipeline, publish in ((fails, lambda: done.append("publish")), (lambda: done.append("pipeline"), fails)):
        try:
            progress.cycle(pipeline is fails, pipeline, publish)
        except RuntimeError:
            pass
    assert done == ["pipeline"] and progress.pending() == {"pipeline": False, "publish": True}
    progress.cycle(False, lambda: done.append("again"), lambda: done.append("publish"))
    progress.cycle(False, lambda: done.append("again"), lambda: done.append("again"))
    assert done == ["pipeline", "publish"] and progress.pending() == {"pipeline": False, "publish": False}


def test_each_message_is_logged_before_the_next(spark, tmp_path):
    messages = spark.createDataFrame([(k, f"k{k}", "m") for k in range(4)], "rank int, key string, message string")
    log, sent = str(tmp_path / "log"), []
    taken = lambda row: sent.append(row["key"]) or row["key"] != "k2"
    assert monitor.deliver(messages, taken, log) == 2 and sent == ["k0", "k1", "k2"]
    assert monitor.deliver(messages, lambda row: sent.append(row["key"]) or True, log) == 2 and sent[3:] == ["k2", "k3"]
    assert monitor.deliver(messages, taken, log) == 0


def test_checkpoint_stream_takes_rows_out_of_order(spark, tmp_path):
    schema = "kind string, observation_id string, member_ids array<long>, post_ids array<long>, views long, likes long, comments long, reposts long, ts long"
    snap = lambda o, ts, ids: {"kind": "snapshot", "observation_id": o, "post_ids": ids, "views": 100, "likes": 10, "comments": 2, "reposts": 1, "ts": ts}
    batches = [
        [{"kind": "observation", "observation_id": "x", "member_ids": [1], "ts": 10_000}, snap("q", 13_900, [5])],
        [snap("x", 13_900, [1])],
        [snap("x", 13_700, [1])],  # comes later, but counts first
        [snap("z", 90_000, [9])],
        [snap("z", 200_000, [9])],
    ]
    stream = stream_of(spark, tmp_path, schema, batches).withColumn("at", F.timestamp_seconds("ts"))
    query = tracker.checkpoints(stream).writeStream.format("memory").queryName("out_of_order").outputMode("append")
    query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    states = {(r["observation_id"], r["hours"]): (r["state"], r["measured_at"]) for r in spark.table("out_of_order").collect()}
    assert states == {("x", 1): ("completed", 13_700), ("x", 3): ("missed", None)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1  # z's last snapshot may still wait


def test_checkpoint_stream(spark, tmp_path):
    schema = "kind string, observation_id string, member_ids array<long>, post_ids array<long>, views long, likes long, comments long, reposts long, ts long"
    snap = lambda o, ts, ids: {"kind": "snapshot", "observation_id": o, "post_ids": ids, "views": 100, "likes": 10, "comments": 2, "reposts": 1, "ts": ts}
    batches = [
        [{"kind": "observation", "observation_id": o, "member_ids": [1, 2], "ts": 10_000} for o in "xy"],
        [snap("x", 13_600, [1]), snap("x", 13_700, [2, 1]), snap("x", 13_800, [1, 2]), snap("y", 14_201, [1, 2])],
        [snap("z", 60_000, [9])],
        [snap("z", 90_000, [9])],
    ]
    stream = stream_of(spark, tmp_path, schema, batches).withColumn("at", F.timestamp_seconds("ts"))
    got = collected(spark, tracker.checkpoints(stream), tmp_path, "checkpoint_stream")
    states = {(r["observation_id"], r["hours"]): (r["state"], r["measured_at"]) for r in got}
    assert states["x", 1] == ("completed", 13_700) and states["y", 1] == ("missed", None)
    assert states["x", 3] == ("missed", None)
