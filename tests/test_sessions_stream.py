import datetime as dt
import json
import os

import numpy as np
from pyspark.sql import functions as F

from helpline.operators import sessions as S
from helpline.streaming import calls as ST


def _naive(events, gap):
    out = []
    by = {}
    for e in sorted(events, key=lambda e: (e[0], e[1])):
        by.setdefault(e[0], []).append(e)
    for u, es in by.items():
        cur = None
        for _, ts, v in es:
            if cur is None or (ts - cur[2]).total_seconds() >= gap:
                if cur:
                    out.append(cur)
                cur = [u, ts, ts, 0, 0.0]
            cur[2] = ts
            cur[3] += 1
            cur[4] += v
        out.append(cur)
    return sorted((u, s, e + dt.timedelta(seconds=gap), n, round(v, 6)) for u, s, e, n, v in out)


def test_bucket_sessions_equal_naive_with_hot_user(spark):
    rng = np.random.default_rng(11)
    t0 = dt.datetime(2024, 1, 1)
    ev = []
    for i in range(600):
        u = 0 if i < 250 else int(rng.integers(1, 8))  # user 0 holds a large share
        ev.append((u, t0 + dt.timedelta(seconds=int(rng.integers(0, 3 * 86400))), float(rng.integers(0, 100)) / 4))
    ev.append((9, t0, 1.0))
    ev.append((9, t0 + dt.timedelta(seconds=3600), 1.0))  # exactly the gap -> new session
    df = spark.createDataFrame(ev, "user_id long, ts timestamp_ntz, value double")
    got = sorted(tuple(r) for r in S.call_sessions(df, 3600).collect())
    assert got == _naive(ev, 3600)
    same = sorted(tuple(r) for r in S.streaming_sessions(df, 3600).collect())
    assert same == got  # Spark's session_window agrees on a static frame


def test_streaming_outcomes_equal_batch_and_late_rows_dropped(spark, tmp):
    src = os.path.join(tmp, "in")
    os.makedirs(src)
    rows = [{"call_id": i, "started_at": f"2024-01-01 0{i // 3}:{(i * 7) % 60:02d}:00", "outcome": ["open", "ai_resolved"][i % 2]}
            for i in range(12)]
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    schema = "call_id long, started_at timestamp_ntz, outcome string"
    batch = sorted(tuple(r) for r in S.outcome_windows(spark.read.schema(schema).json(src)).collect())
    stream = ST.outcomes(spark.readStream.schema(schema).json(src), watermark="10 minutes")
    out = os.path.join(tmp, "out")
    ST.run_available_now(stream, lambda df, _: df.write.mode("append").parquet(out), os.path.join(tmp, "ck"))
    # append mode emits windows once the watermark passes them; the last window stays open
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("window_start", "window_end", "outcome", "n_calls").collect())
    assert set(got) <= set(batch) and len(got) >= 2
    # a late row (behind the watermark) sent in a new trigger is dropped
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write(json.dumps({"call_id": 99, "started_at": "2024-01-01 00:05:00", "outcome": "open"}))
    ST.run_available_now(ST.outcomes(spark.readStream.schema(schema).json(src), watermark="10 minutes"),
                         lambda df, _: df.write.mode("append").parquet(out), os.path.join(tmp, "ck"))
    after = spark.read.parquet(out).filter(F.col("window_start") == dt.datetime(2024, 1, 1, 0, 0)).collect()
    assert all(r["n_calls"] == dict(((b[0], b[2]), b[3]) for b in batch)[(r["window_start"], r["outcome"])] for r in after)


def test_stream_transcripts_equals_batch(spark, tmp):
    from helpline.operators.calls import format_items
    from helpline.sources.files import scan_transcripts
    src = os.path.join(tmp, "t")
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"transcript_2031-04-05_01-0{i}-00_{i}.json"), "w") as f:
            json.dump({"items": [{"id": "a", "type": "message", "role": "user", "content": [f"hi {i}"]},
                                 {"id": "b", "type": "message", "role": "assistant", "content": ["ok"]}]}, f)
    out = os.path.join(tmp, "o")
    ST.run_available_now(ST.stream_transcripts(spark, src), lambda df, _: df.write.mode("append").parquet(out),
                         os.path.join(tmp, "ck2"))
    s = sorted((r["call_id"], r["transcript"]) for r in spark.read.parquet(out).collect())
    b = sorted((r["call_id"], r["t"]) for r in scan_transcripts(spark, src).select("call_id", format_items(F.col("items")).alias("t")).collect())
    assert s == b and s[0][1] == "User: hi 0\nAssistant: ok"


def test_register_calls_dedup_within_watermark(spark, tmp):
    src = os.path.join(tmp, "c")
    os.makedirs(src)
    rows = [{"call_id": 1, "room_name": "r1", "started_at": "2024-01-01 00:00:00"},
            {"call_id": 2, "room_name": "r1", "started_at": "2024-01-01 00:01:00"},
            {"call_id": 3, "room_name": "r2", "started_at": "2024-01-01 00:02:00"}]
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    schema = "call_id long, room_name string, started_at timestamp_ntz"
    out = os.path.join(tmp, "reg")
    ST.run_available_now(ST.register_calls(spark.readStream.schema(schema).json(src)),
                         lambda df, _: df.write.mode("append").parquet(out), os.path.join(tmp, "ck3"))
    assert sorted(r["room_name"] for r in spark.read.parquet(out).collect()) == ["r1", "r2"]


def test_file_sink_resumes_without_duplicates(spark, tmp):
    src, out, ck = os.path.join(tmp, "s"), os.path.join(tmp, "o"), os.path.join(tmp, "ck")
    os.makedirs(src)
    schema = "call_id long, room_name string, started_at timestamp_ntz"
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write(json.dumps({"call_id": 1, "room_name": "r1", "started_at": "2024-01-01 00:00:00"}))
    ST.run_to_files(ST.register_calls(spark.readStream.schema(schema).json(src)), out, ck)
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write(json.dumps({"call_id": 2, "room_name": "r2", "started_at": "2024-01-01 00:03:00"}))
    ST.run_to_files(ST.register_calls(spark.readStream.schema(schema).json(src)), out, ck)  # restart: resumes
    assert sorted(r["call_id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def _deliver(spark, path, rows):
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").write.mode("append").parquet(path)


def test_streamed_sessions_drop_what_is_behind_the_watermark(spark, tmp):
    base = dt.datetime(2024, 1, 1)

    def at(hours):
        return base + dt.timedelta(hours=hours)
    src, out, ck = (os.path.join(tmp, x) for x in ("in", "out", "ck"))

    def run():
        stream = spark.readStream.schema("user_id long, ts timestamp_ntz, value double").parquet(src)
        ST.run_to_files(ST.sessions(stream, 3600, watermark="2 hours"), out, ck)
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())
    _deliver(spark, src, [(1, at(0), 1.0), (1, at(0.5), 1.0), (2, at(9), 1.0), (3, at(10), 1.0)])
    closed = [(1, at(0), at(1.5), 2, 2.0)]  # the watermark is at hour 8: users 2 and 3 are open
    assert run() == closed
    # behind the watermark: dropped; late but ahead of it: joins the open session
    _deliver(spark, src, [(1, at(1), 5.0), (2, at(8.5), 3.0), (3, at(20), 1.0)])
    assert run() == closed + [(2, at(8.5), at(10), 2, 4.0), (3, at(10), at(11), 1, 1.0)]


def test_outcome_of_stored_items_is_the_rule_over_turns(spark):
    from helpline.operators import calls as C
    from helpline.operators import outcomes as O
    rows = [(1, 0, "assistant", "Desea ser transferido a una persona real"), (1, 1, "user", "Qué bueno haberle ayudado"),
            (1, 2, "assistant", "Qué bueno haberle ayudado."), (1, 3, "assistant", "Adiós"), (2, 0, "user", "hola"),
            (3, 0, "assistant", None), (4, 0, None, "No pudo ser identificado")]
    t = spark.createDataFrame(rows, "call_id long, pos long, role string, text string")
    got = {r["call_id"]: r["o"] for r in C.build_transcripts(t).select("call_id", O.outcome_of_items(F.col("items")).alias("o")).collect()}
    assert got == {r["call_id"]: r["outcome"] for r in O.call_outcome(t).collect()}
    assert got == {1: "verified_resolved", 2: "open", 3: "open", 4: "open"}


def test_stream_outcomes_lose_no_call_over_many_files(spark, monkeypatch):
    from helpline.operators import outcomes as O
    from helpline.plans import q_stream
    from helpline.sinks import writers
    from helpline.sources import fixtures as fx
    monkeypatch.setattr(writers, "MAX_DOCS_PER_FILE", 20)  # many files, each over all times
    monkeypatch.setattr(ST.stream_transcripts, "__defaults__", (1, True))
    monkeypatch.setattr(q_stream, "build_transcripts", lambda t, f=q_stream.build_transcripts: f(t, 2))  # calls of several pages
    sf = "/root/testdata/sf0.01"
    one = O.call_outcome(fx.turns_with_closings(spark, sf)).join(fx.calls(spark, sf), "call_id")
    want = sorted(tuple(r) for r in S.outcome_windows(one, "15 minutes").collect())
    assert sorted(tuple(r) for r in q_stream.q_t4(spark, sf).collect()) == want and len(want) > 4


def test_pages_of_a_call_count_once(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 0, "ai_resolved"), (1, 1, "verified_resolved"), (1, 2, "open"), (2, 0, "open"), (2, 1, "open")]
    df = spark.createDataFrame([(i, p, t0, o) for i, p, o in rows], "call_id long, page_no long, started_at timestamp_ntz, outcome string")
    got = {r["outcome"]: r["n_calls"] for r in ST.outcomes(df).collect()}
    assert got == {"verified_resolved": 1, "open": 1}
