from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators import tracker
from newsloom.plans import events


def test_observations_hold_every_event(spark, tmp_path):
    start = datetime(2024, 1, 3, 10)
    rows = [(k, 7, "view", start + timedelta(seconds=k)) for k in range(5)]
    rows += [(10 + k, k, "view", start + timedelta(minutes=9 * k)) for k in range(20, 30)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz")
    df.write.parquet(f"{tmp_path}/events.parquet")
    found = events.observation_ids(spark, str(tmp_path)).collect()
    assert sorted(r["members"] for r in found) == [1] * 10 + [5]
    states = events.checkpoints(spark, str(tmp_path)).collect()
    assert len(states) == 22 and {r["state"] for r in states} == {"completed"}
    assert sorted(r["views"] for r in states) == [400] * 20 + [2000] * 2


def test_a_post_is_sent_once_for_all_hours(spark):
    observed = spark.createDataFrame([("o", "a", [1, 2], 0)], "observation_id string, audience string, member_ids array<long>, predicted_at long")
    rows = [("a", p, t, 1, 0, 0, 0) for p in (1, 1, 2) for t in (3600, 11400)]
    snaps = spark.createDataFrame(rows, "audience string, post_id long, snap_ts long, views long, likes long, comments long, reposts long")
    found = tracker.checkpoints(observed, snaps, F.lit(99_999))
    assert sorted((r["hours"], r["state"], r["measured_at"], r["views"]) for r in found.collect()) == [(1, "completed", 3600, 3), (3, "completed", 11400, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan  # which would send each post a second time
