"""Cooldowns as state of a stream against the batch operator, over restarts."""

import os

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import windows
from codeatlas.streaming import claims

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stream_agrees_with_batch_over_restarts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts")
    events = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")))  # a hot key
    to, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    cuts = ["2024-01-01", "2024-01-04", "2024-01-15", "2024-02-15"]
    for lo, hi in zip(cuts, cuts[1:]):
        events.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(to)
        claims.stream_grants(spark, to, "user_id long, event_id long, ts timestamp_ntz", out, mark).awaitTermination()  # each run starts from the checkpoint
    got = sorted((r.user_id, r.ident, r.granted, r.remaining) for r in spark.read.parquet(out).collect())
    want = sorted((r.user_id, r.event_id, r.granted, r.remaining) for r in windows.cooldown(events, "user_id", "ts", "event_id", 3600).collect())
    assert got == want and len(got) == 1000 and {g[2] for g in got} == {True, False}


def test_remaining_seconds_and_late_requests():
    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    class Handle:
        timers: set = set()

        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.discard(t)

    p = claims.Cooldown("k", 60)
    p.init(Handle())
    ask = lambda *ts: [(r.granted, r.remaining) for r in p.handleInputRows((1,), iter([claims.Row(ident=i, t=int(t * 1e6)) for i, t in enumerate(ts)]), None)]
    assert ask(59.5, 0.0) == [(True, 0), (False, 1)] and Handle.timers == {60_000}
    assert ask(60.0, 119.999) == [(True, 0), (False, 1)] and Handle.timers == {120_000}
    assert ask(30.0) == [(False, 90)]
