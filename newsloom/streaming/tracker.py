"""The tracker's states as Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators.tracker import HOURS, TOLERANCE


def first_seen(spark: SparkSession, state: str, out: str) -> Callable[[DataFrame, int], None]:
    """A publisher of posts (audience, post_id) that come after their audience's first poll, which
    only marks what is there.

    What was seen is a table, a folder for each batch: posts are told apart by joins, so no
    audience has to fit a task, and a repeated batch replaces its own folders.
    """
    shape = "audience string, post_id long"
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{state}/batch=-1")

    def publish(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.schema(f"{shape}, batch long").parquet(state).where(F.col("batch") < number)
        fresh = batch.select("audience", "post_id").distinct().join(old, ["audience", "post_id"], "left_anti")
        later = fresh.join(old.select("audience").distinct(), "audience", "left_semi")
        later.write.mode("overwrite").parquet(f"{out}/batch={number}")
        fresh.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return publish


def checkpoints(stream: DataFrame) -> DataFrame:
    """``observation_id, hours, state, measured_at, score`` as checkpoints are completed or missed.

    ``stream`` has, by event time ``at``, observations (kind 'observation': observation_id,
    member_ids, ts) and snapshots (kind 'snapshot': observation_id, post_ids and the counters'
    sums, ts). A snapshot within the window with exactly the members completes the hour, the
    first one counts; a timer after the window declares it missed. Rows may be late by the
    tolerance: as long the first snapshot waits to be declared. State goes when all hours are
    settled, and when no observation has come for the snapshots by the time that they could count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"began": None, "members": [], "open": list(HOURS), "seen": []}
        for r in [] if state.hasTimedOut else [r for b in batches for r in b.itertuples(index=False)]:
            if r.kind == "observation" and held["began"] is None:
                held |= {"began": int(r.ts), "members": sorted(int(m) for m in r.member_ids)}
            elif r.kind == "snapshot":
                rate = (r.likes + 2 * r.comments + 4 * r.reposts) / max(r.views, 1)
                held["seen"].append([int(r.ts), sorted(int(p) for p in r.post_ids), float(rate)])
        watermark = state.getCurrentWatermarkMs()
        now, began, out, wake, kept = watermark // 1000, held["began"], [], [], []
        if began is None:  # an observation that is still to come is not before the watermark
            kept = [s for s in held["seen"] if s[0] - 3600 * HOURS[0] >= now]
            wake = [s[0] - 3600 * HOURS[0] + 1 for s in kept]
        else:
            for h in list(held["open"]):
                due = began + 3600 * h
                fits = sorted(s for s in held["seen"] if due <= s[0] <= due + TOLERANCE and s[1] == held["members"])
                if fits and now >= fits[0][0]:  # none before it can come any more
                    out.append((key[0], h, "completed", fits[0][0], fits[0][2]))
                elif not fits and now > due + TOLERANCE:
                    out.append((key[0], h, "missed", None, None))
                else:
                    wake.append(fits[0][0] if fits else due + TOLERANCE + 1)
                    continue
                held["open"].remove(h)
            windows = [began + 3600 * h for h in held["open"]]
            kept = [s for s in held["seen"] if any(due <= s[0] <= due + TOLERANCE for due in windows)]
        held["seen"] = kept
        if wake:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(1000 * min(wake), watermark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["observation_id", "hours", "state", "measured_at", "score"]).astype(
            {"hours": "int32", "measured_at": "Int64", "score": "float64"}
        )

    return stream.withWatermark("at", f"{TOLERANCE} seconds").groupBy("observation_id").applyInPandasWithState(
        step,
        "observation_id string, hours int, state string, measured_at long, score double",
        "held string",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
