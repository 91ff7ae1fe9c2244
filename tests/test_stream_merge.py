"""Merged streams: a register that stays unique and running outcome counts in any file order."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from helpline.operators import outcomes as O
from helpline.operators import sessions as S
from helpline.streaming import calls as ST
from helpline.streaming import merge as MG

CALLS = "call_id long, room_name string, started_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def deliver(spark, path, rows):
    spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").json(path)


def rooms(spark, path, schema):
    return sorted((r["room_name"], r["call_id"]) for r in MG.read_register(spark, path, schema).collect())


def test_a_room_is_registered_once_for_good(spark, tmp):
    src, reg, ck = (os.path.join(tmp, x) for x in ("in", "register", "ck"))
    schema = spark.createDataFrame([], CALLS).schema

    def run():
        ST.run_available_now(spark.readStream.schema(schema).json(src), MG.register_sink(reg, buckets=4), ck)
        return rooms(spark, reg, schema)
    deliver(spark, src, [(1, "room-1", T0), (7, "room-1", T0 - dt.timedelta(hours=1)), (2, "room-2", T0)])
    assert run() == [("room-1", 7), ("room-2", 2)]  # the earliest of one batch
    # nine days later: the old room again, and a new room whose call is older than all
    deliver(spark, src, [(1, "room-1", T0), (3, "room-3", T0 + dt.timedelta(days=9)), (4, "room-4", T0 - dt.timedelta(days=400))])
    assert run() == [("room-1", 7), ("room-2", 2), ("room-3", 3), ("room-4", 4)]
    assert run() == rooms(spark, reg, schema)  # nothing new


def test_a_batch_run_again_leaves_no_row_twice(spark, tmp):
    reg = os.path.join(tmp, "register")
    first = spark.createDataFrame([(1, "a", T0), (2, "b", T0)], CALLS)
    second = spark.createDataFrame([(3, "c", T0), (1, "a", T0)], CALLS)
    merge, schema = MG.register_sink(reg, buckets=3), first.schema
    merge(first, 0)
    merge(second.limit(0), 1)  # an attempt at batch 1 that got nowhere
    merge(second, 1)
    merge(second, 1)           # and one that was written but not committed
    assert rooms(spark, reg, schema) == [("a", 1), ("b", 2), ("c", 3)]
    MG.register_sink(reg, stream="other", buckets=3)(first.union(spark.createDataFrame([(9, "z", T0)], CALLS)), 0)
    assert rooms(spark, reg, schema) == [("a", 1), ("b", 2), ("c", 3), ("z", 9)]


def test_a_failed_sink_resumes_with_its_batch(spark, tmp):
    src, reg, ck = (os.path.join(tmp, x) for x in ("in", "register", "ck"))
    schema = spark.createDataFrame([], CALLS).schema
    deliver(spark, src, [(i, f"room-{i}", T0) for i in range(5)])
    merge = MG.register_sink(reg, buckets=4)

    def broken(batch, batch_id):
        merge(batch, batch_id)
        raise RuntimeError("lost after the write, before the commit")
    with pytest.raises(Exception, match="lost after the write"):
        ST.run_available_now(spark.readStream.schema(schema).json(src), broken, ck)
    deliver(spark, src, [(9, "room-9", T0), (1, "room-1", T0)])
    ST.run_available_now(spark.readStream.schema(schema).json(src), merge, ck)
    assert rooms(spark, reg, schema) == [(f"room-{i}", i) for i in (0, 1, 2, 3, 4, 9)]


PAGES = "call_id long, page_no long, started_at timestamp_ntz, outcome string"


def pages_of(n):
    rng = random.Random(4)
    kinds = ["verified_resolved", "ai_resolved", "transferred", O.OPEN_OUTCOME, O.OPEN_OUTCOME]
    return [(i, p, T0 + dt.timedelta(minutes=7 * i), rng.choice(kinds)) for i in range(n) for p in range(rng.randint(1, 4))]


def run_outcomes(spark, tmp, files, retention):
    src, out, ck = (os.path.join(tmp, x) for x in ("in", "out", "ck"))
    for f in files:
        spark.createDataFrame(f, PAGES).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(spark.createDataFrame([], PAGES).schema).option("maxFilesPerTrigger", 1).json(src)
    q = (MG.outcome_changes(stream, retention).writeStream.outputMode("append").option("checkpointLocation", ck)
         .foreachBatch(MG.outcome_sink(out, "1 hour")).trigger(availableNow=True).start())
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return sorted(tuple(r) for r in MG.outcome_counts(spark, out).collect()), states


def test_running_counts_equal_the_batch_in_any_file_order(spark, tmp):
    rows = pages_of(40)
    want = sorted(tuple(r) for r in S.outcome_windows(spark.createDataFrame(rows, PAGES), "1 hour").collect())
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    files = [shuffled[k::5] for k in range(5)] + [rows[:6]]  # the last one is delivered again
    got, _ = run_outcomes(spark, tmp, files, "3650 days")
    assert got == want


def test_state_goes_with_the_watermark(spark, tmp):
    rows = [(i, 0, T0 + dt.timedelta(days=i), "ai_resolved") for i in range(8)]
    got, states = run_outcomes(spark, tmp, [[r] for r in rows], "2 days")
    assert sum(r[3] for r in got) == 8
    assert max(states) <= 4 < 8
