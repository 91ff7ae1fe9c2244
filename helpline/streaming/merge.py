"""Streams whose results are merged into stored tables batch by batch.

Every micro-batch writes one folder ``stream=<name>/batch=<id>``; the batch id is the
transaction key. A batch that is run again after a failure overwrites its own folder and
never reads it, so a restart in the middle of a batch leaves no row twice and loses none.
Two streams over one table need two names.

* ``register_sink`` (T2): each room is registered once, for good: however late a room is
  delivered again, and however old a new room's call is. No watermark and no state: the
  register itself is the memory, dealt by a hash of the room into buckets, so a batch reads only
  the room names of the buckets that it touches.
* ``outcome_changes`` / ``outcome_sink`` / ``outcome_counts`` (T4): running counts of
  outcomes by window of call start. A call's pages may come in any order and any batch:
  the state holds the last closing phrase so far, and a page that changes the outcome
  takes the call out of the old count and into the new one. Counts are current after
  each batch. A call's state goes when the watermark has passed its start by
  ``retention``; pages later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from helpline.operators.outcomes import OPEN_OUTCOME
from helpline.operators.sessions import _event_time, instant_to_ntz
from helpline.operators.calls import first_of_rooms
from helpline.sinks.writers import _read_if_there

BUCKETS = 256


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """What all batches wrote, with ``stream`` and ``batch`` (None before the first)."""
    full = StructType(list(schema.fields)).add("stream", StringType()).add("batch", LongType())
    return _read_if_there(spark, path, full)


def register_sink(path: str, stream: str = "calls", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: rows of rooms that no other batch has registered; of one
    batch's rows of a room the earliest. The register keeps the batch's columns."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = first_of_rooms(batch).withColumn("bucket", F.pmod(F.xxhash64("room_name"), F.lit(buckets)).cast("int"))
        old = read_batches(spark, path, new.schema)
        if old is not None:
            # an earlier attempt at this batch is no registration
            old = old.where(~((F.col("stream") == stream) & (F.col("batch") >= batch_id))).select("bucket", "room_name")
            new = new.join(old, ["bucket", "room_name"], "left_anti")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/stream={stream}/batch={batch_id}")
    return merge


def read_register(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The registered rows (columns of ``schema``)."""
    rows = read_batches(spark, path, StructType(list(schema.fields)).add("bucket", LongType()))
    return None if rows is None else rows.select(*schema.fieldNames())


CHANGES = "started timestamp, outcome string, change bigint"
STATE = "page bigint, outcome string, started timestamp"


def _step(key, pages: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One call: its pages of this batch against the outcome counted so far."""
    if state.hasTimedOut:
        state.remove()
        return
    page, outcome, started = state.get if state.exists else (-1, None, None)
    told = outcome
    for p in pages:
        for no, at, o in zip(p["page_no"], p["started"], p["outcome"]):
            started = at if started is None else min(started, at)
            if o != OPEN_OUTCOME and no > page:
                page, outcome = int(no), o
    outcome = outcome or OPEN_OUTCOME
    first = state.get[2] if state.exists else started
    state.update((page, outcome, first))
    state.setTimeoutTimestamp(max(int(first.timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
    if outcome != told:
        rows = [(first, outcome, 1)] + ([(first, told, -1)] if told else [])
        yield pd.DataFrame(rows, columns=["started", "outcome", "change"])


def outcome_changes(pages: DataFrame, retention: str = "30 days") -> DataFrame:
    """``(started, outcome, change)`` per change of a call's outcome, from a stream of
    ``(call_id, page_no, started_at, outcome)``. Rows without a call id or start are none."""
    df, et, _ = _event_time(pages, "started_at")
    df = df.where(F.col("call_id").isNotNull() & F.col(et).isNotNull()).withWatermark(et, retention)
    return df.select("call_id", "page_no", F.col(et).alias("started"), "outcome").groupBy("call_id").applyInPandasWithState(
        _step, CHANGES, STATE, "append", "EventTimeTimeout")


def outcome_sink(path: str, window: str = "1 hour", stream: str = "outcomes") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: the batch's changes, added up by window and outcome."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        w = batch.groupBy(F.window("started", window).alias("w"), "outcome").agg(F.sum("change").alias("change"))
        w.select("w.start", "w.end", "outcome", "change").write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={batch_id}")
    return merge


def outcome_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """``(window_start, window_end, outcome, n_calls)`` as of the last batch."""
    schema = StructType().add("start", "timestamp").add("end", "timestamp").add("outcome", "string").add("change", "long")
    rows = read_batches(spark, path, schema)
    if rows is None:
        return None
    g = rows.groupBy("start", "end", "outcome").agg(F.sum("change").alias("n_calls")).where("n_calls > 0")
    return g.select(instant_to_ntz(F.col("start")).alias("window_start"), instant_to_ntz(F.col("end")).alias("window_end"), "outcome", "n_calls")
