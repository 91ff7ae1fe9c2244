"""Call sessions from events (T3, batch form) and windowed outcome counts (T4).

Sessions: a new session starts when the gap to the user's previous event is
at least ``gap``. Instead of ordering every event of a user in one task (a
user holding a third of all events would be one task), events are cut into
time buckets of width ``gap``: all events of one (user, bucket) belong to one
session (they are less than ``gap`` apart), and a bucket continues the session
of bucket ``b-1`` exactly when ``min(b) - max(b-1) < gap``. So per-(user,
bucket) partial aggregates plus one ordered pass over *buckets* (bounded by
time span / gap per user, not by event count) give exact sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helpline.operators.outcomes import OPEN_OUTCOME

EPOCH_NTZ = "1970-01-01 00:00:00"
DEFAULT_GAP_SECONDS = 6 * 3600


def _micros(ts: str) -> F.Column:
    # timestamp_ntz arithmetic: no session time zone involved
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{EPOCH_NTZ}', CAST({ts} AS TIMESTAMP_NTZ))")


def ntz_to_instant(c: F.Column) -> F.Column:
    """TIMESTAMP_NTZ -> TIMESTAMP at the same wall clock read as UTC (watermarks
    need TIMESTAMP); no session time zone is involved either way."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(f"TIMESTAMP_NTZ '{EPOCH_NTZ}'"), c))


def instant_to_ntz(c: F.Column) -> F.Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr(f"TIMESTAMP_NTZ '{EPOCH_NTZ}'"))


def _event_time(df: DataFrame, ts: str) -> tuple[DataFrame, str, bool]:
    """Streaming with an NTZ event time: add an instant column to watermark on."""
    if df.isStreaming and dict(df.dtypes)[ts] == "timestamp_ntz":
        return df.withColumn("_event_ts", ntz_to_instant(F.col(ts))), "_event_ts", True
    return df, ts, False


def call_sessions(events: DataFrame, gap_seconds: int = DEFAULT_GAP_SECONDS, key: str = "user_id",
                  ts: str = "ts", value: str = "value") -> DataFrame:
    g_us = gap_seconds * 1_000_000
    e = events.select(F.col(key).alias("k"), F.col(ts).alias("ts"), _micros(ts).alias("us"), F.col(value).alias("v"))
    b = (e.withColumn("bucket", F.floor(F.col("us") / F.lit(g_us)).cast("bigint"))
         .groupBy("k", "bucket").agg(F.min("us").alias("min_us"), F.max("us").alias("max_us"),
                                     F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
                                     F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")))
    order = Window.partitionBy("k").orderBy("bucket")
    before = F.lag("max_us").over(order)
    linked = b.withColumn("starts", F.coalesce(F.col("min_us") - before >= F.lit(g_us), F.lit(True)).cast("int"))
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = linked.withColumn("session_no", F.sum("starts").over(w))
    out = s.groupBy("k", "session_no").agg(F.min("min_ts").alias("session_start"), F.max("max_ts").alias("last_event"),
                                           F.sum("n").alias("n_events"), F.sum("v").alias("total_value"))
    return out.select(F.col("k").alias(key), "session_start",
                      (F.col("last_event") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds))).alias("session_end"),
                      F.col("n_events").cast("bigint"), F.round("total_value", 6).alias("total_value"))


def streaming_sessions(events: DataFrame, gap_seconds: int = DEFAULT_GAP_SECONDS, watermark: str = "1 day",
                       key: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """T3 on a stream: Spark's ``session_window`` behind a watermark (rows later
    than the watermark are dropped). Works on batch DataFrames as well.

    ``session_window`` keeps two events exactly ``gap`` apart in one session;
    our rule splits there. A window gap one microsecond shorter (and the end
    moved back by that microsecond) gives the same sessions as ``call_sessions``."""
    events, et, back = _event_time(events, ts)
    src = events.withWatermark(et, watermark) if events.isStreaming else events
    g = src.groupBy(F.col(key), F.session_window(F.col(et), f"{gap_seconds * 1_000_000 - 1} microseconds").alias("s")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total_value"))
    one_us = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001).cast("decimal(18,6)"))
    start, end = F.col("s.start"), F.col("s.end") + one_us
    if back:
        start, end = instant_to_ntz(start), instant_to_ntz(end)
    return g.select(key, start.alias("session_start"), end.alias("session_end"),
                    F.col("n_events").cast("bigint"), F.round("total_value", 6).alias("total_value"))


def outcome_windows(call_outcomes: DataFrame, window: str = "1 hour", ts: str = "started_at",
                    watermark: str | None = None) -> DataFrame:
    """T4: calls per outcome per tumbling window of call start (batch or stream;
    a stream needs a watermark to write a window and drop its state). Rows with a
    ``page_no`` are pages of calls: a call has the outcome of its last page with a
    closing phrase, and its state stays until its window is written."""
    call_outcomes, et, back = _event_time(call_outcomes, ts)
    src = call_outcomes.withWatermark(et, watermark) if (watermark and call_outcomes.isStreaming) else call_outcomes
    src = src.withColumn("w", F.window(F.col(et), window))
    if "page_no" in src.columns:
        closed = F.when(F.col("outcome") != OPEN_OUTCOME, F.col("page_no"))
        src = src.groupBy("w", "call_id").agg(F.max_by("outcome", closed).alias("outcome")).withColumn(
            "outcome", F.coalesce("outcome", F.lit(OPEN_OUTCOME)))
    g = src.groupBy("w", "outcome").agg(F.count(F.lit(1)).alias("n_calls"))
    start, end = F.col("w.start"), F.col("w.end")
    if back:
        start, end = instant_to_ntz(start), instant_to_ntz(end)
    return g.select(start.alias("window_start"), end.alias("window_end"), "outcome", "n_calls")
