"""Schemas of the stored shapes."""

from pyspark.sql import types as T

ITEM = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("content", T.ArrayType(T.StringType())),
    T.StructField("interrupted", T.BooleanType()),
])

TRANSCRIPT = T.StructType([
    T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("_corrupt_record", T.StringType()),
])

# JSON-lines layout of the transcript sink: one (call, page) per line
TRANSCRIPT_LINE = T.StructType([
    T.StructField("call_id", T.LongType()), T.StructField("page_no", T.LongType()),
    T.StructField("file_name", T.StringType()), T.StructField("transcript_path", T.StringType()),
    T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("_corrupt_record", T.StringType()),
])

CALLS = T.StructType([
    T.StructField("call_id", T.LongType()), T.StructField("room_name", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()), T.StructField("ended_at", T.TimestampNTZType()),
    T.StructField("transcript_path", T.StringType()),
])

EVAL_REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("call_id", T.LongType()), T.StructField("evaluation_prompt", T.StringType()),
])

NODES = T.StructType([
    T.StructField("node_id", T.StringType()), T.StructField("ref_doc_id", T.StringType()),
    T.StructField("chunk_no", T.IntegerType()), T.StructField("start_char", T.IntegerType()),
    T.StructField("end_char", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("embed_text", T.StringType()), T.StructField("node_hash", T.StringType()),
])
