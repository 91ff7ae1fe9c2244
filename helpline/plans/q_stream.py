"""Sessions, windowed outcomes and index-delta queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpline.functions.columns import PAGE_SPAN
from helpline.operators import delta as D
from helpline.operators.calls import build_transcripts, transcript_file_name
from helpline.plans.sqltext import page
from helpline.session import scratch_path
from helpline.sinks.writers import write_transcripts
from helpline.streaming import calls as ST
from helpline.streaming import merge as MG
from helpline.operators import sessions as S
from helpline.plans.catalog import register
from helpline.plans.q_calls import C1_SQL
from helpline.sources import fixtures as fx
from helpline.sources.fixtures import with_fixtures as W
from helpline.sources.tables import read_table

GAP = S.DEFAULT_GAP_SECONDS


SESSIONS_SQL = f"""SELECT user_id, min(ts) AS session_start, max(ts) + to_seconds({GAP}) AS session_end,
    count(*) AS n_events, round(sum(value), 6) AS total_value FROM (
      SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= to_seconds({GAP}) THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) a) b
    GROUP BY user_id, sid"""


@register("call_sessions", SESSIONS_SQL)
def q_t3(spark, d):
    return S.call_sessions(read_table(spark, d, "events", ["user_id", "ts", "value"]))


@register("stream_sessions", f"""SELECT * FROM ({SESSIONS_SQL}) s
    WHERE session_end - to_microseconds(1) <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_t3_stream(spark, d):
    """T3 as a stream over the events (append mode): a session is written once,
    when the watermark (an hour behind the latest event) has passed its end;
    those still open stay in the state."""
    base = scratch_path(spark, "stream-sessions")
    read_table(spark, d, "events", ["user_id", "ts", "value"]).write.parquet(f"{base}/in")
    src = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    ST.run_to_files(ST.sessions(src, GAP, watermark="1 hour"), f"{base}/out", f"{base}/ck")
    return spark.read.parquet(f"{base}/out")


@register("stream_outcomes", W(f"""SELECT time_bucket(INTERVAL 15 MINUTE, c.started_at) AS window_start,
    time_bucket(INTERVAL 15 MINUTE, c.started_at) + INTERVAL 15 MINUTE AS window_end, o.outcome, count(*) AS n_calls
    FROM ({C1_SQL}) o JOIN calls c ON c.call_id = o.call_id GROUP BY 1, 2, 3""", "turns_with_closings", "calls"))
def q_t4(spark, d):
    """T4 as a stream: transcripts arrive as files, each with pages of calls of all
    times; the stream takes the outcome of each page (C1) and keeps running counts by
    window, whatever the order of the files. The state spans ten years here, so
    no call of the tables is late."""
    t = build_transcripts(fx.turns_with_closings(spark, d)).join(fx.calls(spark, d), "call_id")
    base = scratch_path(spark, "stream-outcomes")
    write_transcripts(t.withColumn("file_name", transcript_file_name("call_id", "started_at")), f"{base}/in")
    src = ST.stream_transcripts(spark, f"{base}/in", multi_line=False)
    ST.run_available_now(MG.outcome_changes(src, "3650 days"), MG.outcome_sink(f"{base}/out", "15 minutes"), f"{base}/ck")
    return MG.outcome_counts(spark, f"{base}/out")


def _stored(spark, d):
    """The stored index: hashes of every document as loaded."""
    docs = read_table(spark, d, "documents", ["doc_id", "text", "lang", "source"])
    return docs.select("doc_id", F.sha2(F.concat_ws("|", "lang", "source", "text"), 256).alias("content_hash"))


def _current(spark, d):
    """Today's corpus: German documents removed, French ones edited, and the
    benchmark passages added as new documents."""
    docs = read_table(spark, d, "documents", ["doc_id", "text", "lang", "source"]).filter(F.col("lang") != "de")
    text = F.when(F.col("lang") == "fr", F.concat(F.col("text"), F.lit("\n(rev. 2)"))).otherwise(F.col("text"))
    cur = docs.select("doc_id", F.sha2(F.concat_ws("|", "lang", "source", text), 256).alias("content_hash"))
    bench = read_table(spark, d, "benchmark", ["item_id", "text"]).select(
        (F.col("item_id") + F.lit(fx.NOT_FOUND_OFFSET)).alias("doc_id"),
        F.sha2(F.concat_ws("|", F.lit("en"), F.lit("benchmark"), F.col("text")), 256).alias("content_hash"))
    return cur.unionByName(bench)


STORED_SQL = "SELECT doc_id, sha256(concat_ws('|', lang, source, text)) AS content_hash FROM documents"
CURRENT_SQL = f"""SELECT doc_id, sha256(concat_ws('|', lang, source,
      CASE WHEN lang = 'fr' THEN text || chr(10) || '(rev. 2)' ELSE text END)) AS content_hash FROM documents WHERE lang <> 'de'
    UNION ALL SELECT item_id + {fx.NOT_FOUND_OFFSET}, sha256(concat_ws('|', 'en', 'benchmark', text)) FROM benchmark"""


@register("index_delta", f"""SELECT coalesce(c.doc_id, s.doc_id) AS doc_id,
    CASE WHEN s.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'deleted'
         WHEN c.content_hash = s.content_hash THEN 'unchanged' ELSE 'changed' END AS status,
    coalesce(c.content_hash, s.content_hash) AS content_hash
    FROM ({CURRENT_SQL}) c FULL OUTER JOIN ({STORED_SQL}) s ON s.doc_id = c.doc_id""")
def q_s5(spark, d):
    return D.index_delta(_current(spark, d), _stored(spark, d))


@register("corpus_minus_index", f"""SELECT doc_id, 'not_indexed' AS side FROM ({CURRENT_SQL}) c
      WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT doc_id, 'stale_in_index' FROM documents WHERE lang = 'de'""")
def q_u2(spark, d):
    return D.corpus_minus_index(_current(spark, d), _stored(spark, d))


@register("stream_transcripts", W(f"""SELECT call_id, {page('pos', PAGE_SPAN)} AS page_no, count(*) AS n_items,
    coalesce(string_agg(CASE WHEN text IS NOT NULL THEN
      CASE WHEN role = 'assistant' THEN 'Assistant' ELSE 'User' END || ': ' || text END, chr(10) ORDER BY pos), '') AS transcript
    FROM turns GROUP BY 1, 2""", "turns"))
def q_t1(spark, d):
    """T1 as a stream: transcripts built from the conversations are written by
    the sink (K4) and picked up by the file stream (trigger availableNow, its
    checkpoint in the shared folder) into an exactly-once file sink; the
    formatted rows are read back."""
    t = build_transcripts(fx.turns(spark, d))
    c = fx.calls(spark, d).select("call_id", "started_at")
    base = scratch_path(spark, "stream-transcripts")
    write_transcripts(t.join(c, "call_id").select("call_id", "page_no", "items",
                                                 transcript_file_name("call_id", "started_at").alias("file_name")),
                      f"{base}/in", mode="overwrite")
    ST.run_to_files(ST.stream_transcripts(spark, f"{base}/in", multi_line=False), f"{base}/out", f"{base}/ck")
    return spark.read.parquet(f"{base}/out").select("call_id", "page_no", "n_items", "transcript")


@register("stream_register_calls", W("""SELECT DISTINCT call_id, room_name, started_at FROM calls""", "calls"))
def q_t2(spark, d):
    """T2 as a stream: every call is delivered twice, in two runs of the stream; its
    batches are merged into a register that holds each room once for good."""
    c = fx.calls(spark, d).select("call_id", "room_name", "started_at")
    base = scratch_path(spark, "stream-calls")
    for _ in range(2):
        c.write.mode("append").json(f"{base}/in")
        src = spark.readStream.schema(c.schema).json(f"{base}/in")
        ST.run_available_now(src, MG.register_sink(f"{base}/register"), f"{base}/ck")
    return MG.read_register(spark, f"{base}/register", c.schema)
