"""Faults found in review: sparse ids, gaps, swallowed errors, streamed sessions."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helpline.operators import calls, kb
from helpline.operators.sessions import call_sessions
from helpline.sinks import index, writers
from helpline.streaming import calls as stream


def test_one_document_per_client_whatever_the_ids(spark):
    companies = spark.createDataFrame([(5, "a"), (250_005, "b"), (9_000_000_000, "c")], "Id long, Nombre string")
    pairs = spark.createDataFrame([(10, 5), (10, 250_005), (10, 9_000_000_000)], "ClienteId long, EmpresaId long")
    clients = spark.createDataFrame([(10, "x")], "Id long, NombreCompleto string")
    rows = kb.client_docs(clients, pairs, companies).collect()
    assert [(r.doc_id, r.enterprise_ids) for r in rows] == [("client_10", "5, 250005, 9000000000")]


def test_steps_of_one_code_stay_one_document(spark):
    steps = spark.createDataFrame([(1, 7 if i % 2 else None, f"s{i}") for i in range(50)],
                                  "ProtocolId long, CodigoPasoProtocolo long, PasoProtocolo string")
    assert [r.page_no for r in kb.protocol_steps_text(steps).collect()] == [0]


def test_unknown_layout_is_refused(spark):
    with pytest.raises(ValueError):
        kb.corpus(*[None] * 7, layout="automatic")


def test_reply_pairs_over_gaps(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 5, "assistant", "a"), (1, 9, "user", "r"), (2, 3, "assistant", "z")],
                                  "call_id long, pos long, role string, text string")
    assert [tuple(r) for r in calls.reply_pairs(turns).collect()] == [(1, 0, 5, "q", "a")]


def test_register_errors_are_not_swallowed(spark, tmp):
    spark.createDataFrame([(1,)], "other long").write.parquet(f"{tmp}/register")
    new = spark.createDataFrame([("r1",)], "room_name string")
    with pytest.raises(AnalysisException):
        writers.append_calls(new, f"{tmp}/register")
    assert writers.append_calls(new, f"{tmp}/fresh") == 1 and writers.append_calls(new, f"{tmp}/fresh") == 0
    assert index.latest(spark, f"{tmp}/none") is index.NONE


def test_sessions_on_a_stream_of_ntz_times_drop_late_rows(spark, tmp):
    t0 = dt.datetime(2024, 1, 1)
    schema = "user_id long, ts timestamp_ntz, value double"
    early = [(1, t0 + dt.timedelta(minutes=m), 1.0) for m in (0, 5, 60, 300)]
    late = [(2, t0 - dt.timedelta(days=3), 1.0), (1, t0 + dt.timedelta(days=5), 1.0)]
    src = f"{tmp}/in"
    spark.createDataFrame(early, schema).coalesce(1).write.parquet(src)

    def run():
        events = spark.readStream.schema(schema).parquet(src)
        stream.run_to_files(stream.sessions(events, 1800, "1 hour"), f"{tmp}/out", f"{tmp}/ckpt")
    run()
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([(3, t0 + dt.timedelta(days=9), 1.0)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    want = call_sessions(spark.createDataFrame(early + late[1:], schema), 1800)
    got = spark.read.parquet(f"{tmp}/out").select("user_id", "session_start", "session_end", "n_events")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert got.where(F.col("user_id") == 2).count() == 0
