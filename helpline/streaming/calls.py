"""Incremental forms of the call jobs (T1-T4). Each reuses the batch
transformation; only the source, watermark and trigger differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpline.operators.calls import format_items
from helpline.operators.outcomes import outcome_of_items
from helpline.operators.sessions import _event_time, outcome_windows, streaming_sessions
from helpline.schemas import TRANSCRIPT, TRANSCRIPT_LINE
from helpline.sources.files import TRANSCRIPT_NAME


def stream_transcripts(spark: SparkSession, path: str, max_files_per_trigger: int | None = 1000,
                       multi_line: bool = True) -> DataFrame:
    """New transcript files -> one row per transcript with the formatted
    text and its outcome (row-local higher-order functions; no state, no shuffle;
    a call of several pages has an outcome for each). Layouts as
    in ``scan_transcripts``: one transcript per file, or the sink's JSON lines.
    ``max_files_per_trigger=None`` takes all files that are there in one batch: with
    a watermark behind it, needed where the files do not come in order of time."""
    schema = TRANSCRIPT if multi_line else TRANSCRIPT_LINE
    df = (spark.readStream.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record"))
    if max_files_per_trigger is not None:
        df = df.option("maxFilesPerTrigger", max_files_per_trigger)
    df = df.json(path)
    name = F.col("_metadata.file_name") if multi_line else F.col("file_name")
    stamp = F.regexp_extract(name, TRANSCRIPT_NAME, 1)
    cid = F.when(F.regexp_extract(name, TRANSCRIPT_NAME, 2) != "", F.regexp_extract(name, TRANSCRIPT_NAME, 2).cast("bigint"))
    page_no = F.lit(0).cast("bigint") if multi_line else F.coalesce(F.col("page_no"), F.lit(0).cast("bigint"))
    items = F.coalesce(F.col("items"), F.array())
    return df.select((cid if multi_line else F.coalesce(F.col("call_id"), cid)).alias("call_id"), page_no.alias("page_no"),
                     name.alias("file_name"),
                     F.when(stamp != "", F.to_timestamp_ntz(stamp, F.lit("yyyy-MM-dd_HH-mm-ss"))).alias("started_at"),
                     F.size(items).cast("bigint").alias("n_items"), format_items(items).alias("transcript"),
                     outcome_of_items(items).alias("outcome"))


def register_calls(calls: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Rooms told apart within a watermark only, for sinks that can't be merged into; the
    register of calls (T2) is ``merge.register_sink``, which keeps a room once for good."""
    if not calls.isStreaming:  # batch: keep the earliest delivery of each room
        cols = calls.columns
        first = calls.groupBy("room_name").agg(F.min_by(F.struct(*cols), F.struct("started_at", "call_id")).alias("r"))
        return first.select(*[F.col("r")[c].alias(c) for c in cols])
    df, et, back = _event_time(calls, "started_at")
    out = df.withWatermark(et, watermark).dropDuplicatesWithinWatermark(["room_name"])
    return out.drop("_event_ts") if back else out


def sessions(events: DataFrame, gap_seconds: int, watermark: str = "1 day") -> DataFrame:
    """T3 on a stream (session windows behind a watermark)."""
    return streaming_sessions(events, gap_seconds, watermark)


def outcomes(call_outcomes: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """T4: outcome counts per tumbling window of call start; the pages of a call
    (rows with ``page_no``) count as one call. In append mode a
    window is written once, when the watermark has passed its end; later rows of
    it are dropped and its state goes."""
    return outcome_windows(call_outcomes, window, watermark=watermark)


def run_available_now(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                      output_mode: str = "append") -> None:
    """Process everything available, then stop (``foreachBatch`` sink with a
    checkpoint in the shared folder, so a restart resumes where it left)."""
    q = (df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()


def run_to_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything available into a file sink, then stop. The file sink
    is exactly-once: readers of ``path`` list only the files committed in its
    ``_spark_metadata`` log, so a batch retried after an executor loss or a
    restart is never seen twice. Append mode only."""
    q = (df.writeStream.format(fmt).outputMode("append").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
