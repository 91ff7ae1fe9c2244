"""Transcripts and calls: items <-> turns (W2), non-empty filter (P6),
formatting (X7), reply pairs (W3), per-call metrics (A10).

Two shapes: ``transcripts(call_id, items ARRAY<ITEM>)`` as stored, and flat
``turns(call_id, pos, role, text | content)``. Formatting the nested shape is
row-local (no shuffle, works in streaming); the flat shape is grouped per
(call, page) so a very long call is split into pages of PAGE_SPAN turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helpline.functions.columns import PAGE_SPAN, page_of, role_label, word_count


def turns_to_items(turns: DataFrame) -> DataFrame:
    """Flat turns -> item struct per row: content is ``[text]`` (empty when NULL)."""
    interrupted = F.coalesce("interrupted", F.lit(False)) if "interrupted" in turns.columns else F.lit(False)
    content = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("text")))
    return turns.select("call_id", "pos", F.struct(
        F.concat(F.lit("item_"), F.col("call_id").cast("string"), F.lit("_"), F.col("pos").cast("string")).alias("id"),
        F.lit("message").alias("type"), F.col("role"), content.alias("content"),
        interrupted.alias("interrupted")).alias("item"))


def build_transcripts(turns: DataFrame, page_span: int = PAGE_SPAN) -> DataFrame:
    """Flat turns -> one transcript row per (call, page), items in position order."""
    it = turns_to_items(turns)
    g = (it.groupBy("call_id", page_of("pos", page_span).alias("page_no"))
         .agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("ps")))
    return g.select("call_id", "page_no", F.transform("ps", lambda x: x["item"]).alias("items"))


def transcript_file_name(call_id: Column | str, started_at: Column | str) -> Column:
    """K4 file name: ``transcript_<yyyy-MM-dd_HH-mm-ss>_<call id>.json``."""
    cid = F.col(call_id) if isinstance(call_id, str) else call_id
    ts = F.col(started_at) if isinstance(started_at, str) else started_at
    return F.concat(F.lit("transcript_"), F.date_format(ts, "yyyy-MM-dd_HH-mm-ss"), F.lit("_"),
                    cid.cast("string"), F.lit(".json"))


def turn_sequence(transcripts: DataFrame, page_span: int = PAGE_SPAN) -> DataFrame:
    """Nested items -> one row per item with its position (posexplode keeps
    list order; pages continue the numbering)."""
    base = transcripts if "page_no" in transcripts.columns else transcripts.withColumn("page_no", F.lit(0).cast("bigint"))
    e = base.select("call_id", "page_no", F.posexplode(F.coalesce(F.col("items"), F.array())).alias("p", "item"))
    return e.select("call_id", (F.col("page_no") * F.lit(page_span) + F.col("p")).cast("bigint").alias("pos"),
                    F.col("item.id").alias("item_id"), F.col("item.type").alias("item_type"),
                    F.col("item.role").alias("role"), F.col("item.content").alias("content"),
                    F.col("item.interrupted").alias("interrupted"))


def nonempty(content: Column) -> Column:
    """``content`` present and non-empty (``[""]`` counts as non-empty)."""
    return F.coalesce(F.size(content) > 0, F.lit(False))


def format_items(items: Column, keep_system: bool = True) -> Column:
    """X7 on the nested shape: ``Role: content[0]`` lines joined by newline.
    Row-local higher-order functions: no shuffle, no Python. By default every
    role but ``assistant`` prints as ``User`` (system turns included, as the
    source does); ``keep_system=False`` leaves system turns out."""
    if keep_system:
        kept = F.filter(F.coalesce(items, F.array()), lambda i: nonempty(i["content"]))
    else:
        kept = F.filter(F.coalesce(items, F.array()),
                        lambda i: nonempty(i["content"]) & F.coalesce(i["role"] != F.lit("system"), F.lit(True)))
    return F.array_join(F.transform(kept, lambda i: F.concat(role_label(i["role"]), F.lit(": "),
                                                               F.coalesce(F.get(i["content"], 0), F.lit("")))), "\n")


def format_transcripts(turns: DataFrame, page_span: int = PAGE_SPAN, keep_system: bool = True) -> DataFrame:
    """X7 over flat turns: non-empty turns, ``Role: text`` per line, ordered by
    position, one text per (call, page). ``keep_system=False`` drops system turns."""
    if not keep_system:
        turns = turns.filter(F.coalesce(F.col("role") != F.lit("system"), F.lit(True)))
    lines = (turns.filter(F.col("text").isNotNull())
             .select("call_id", "pos", F.concat(role_label("role"), F.lit(": "), F.col("text")).alias("line")))
    g = (lines.groupBy("call_id", page_of("pos", page_span).alias("page_no"))
         .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls")))
    return g.select("call_id", "page_no", F.size("ls").cast("bigint").alias("n_lines"),
                    F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("transcript"))


def reply_pairs(turns: DataFrame) -> DataFrame:
    """A user turn and the assistant turn right after it, also where
    positions have gaps. One call's turns are sorted together (with spill)."""
    w = Window.partitionBy("call_id").orderBy("pos")
    x = turns.select("call_id", "role", F.col("pos").alias("user_pos"), F.col("text").alias("user_text"),
                     F.lead(F.struct("pos", "role", "text")).over(w).alias("n"))
    return x.filter((F.col("role") == "user") & (F.col("n.role") == "assistant")).select(
        "call_id", "user_pos", F.col("n.pos").alias("reply_pos"), "user_text", F.col("n.text").alias("reply_text"))


def call_metrics(turns: DataFrame) -> DataFrame:
    """A10: per call counts by role, words, first/last role. Partial aggregates
    only (map-side combine), so one huge call costs one row per task."""
    r = F.col("role")
    has_int = "interrupted" in turns.columns
    return turns.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(r == "user").alias("n_user"),
        F.count_if(r == "assistant").alias("n_assistant"),
        F.count_if(~r.isin("user", "assistant")).alias("n_other"),
        F.count_if(F.col("interrupted")).alias("n_interrupted") if has_int else F.lit(0).cast("bigint").alias("n_interrupted"),
        F.coalesce(F.sum(word_count("text")), F.lit(0)).cast("bigint").alias("n_words"),
        F.coalesce(F.sum(F.when(r == "assistant", word_count("text"))), F.lit(0)).cast("bigint").alias("n_assistant_words"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.min_by("role", "pos").alias("first_role"), F.max_by("role", "pos").alias("last_role"))


def first_of_rooms(calls: DataFrame) -> DataFrame:
    """One row a room: the earliest call, then the one of least id."""
    cols = calls.columns
    order = F.struct(*[c for c in ("started_at", "call_id") if c in cols], *cols)
    return calls.groupBy("room_name").agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*")


def lookup_call(calls: DataFrame, call_id: int) -> DataFrame:
    """Point lookup of a call's transcript path (pushed to the scan)."""
    return calls.filter(F.col("call_id") == F.lit(call_id)).select("call_id", "transcript_path")
