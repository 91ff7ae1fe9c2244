"""Chat formatting by schema fingerprints. DataFrame functions only.

A record is one JSON text in any of several layouts. Its nested field paths
(objects, arrays and leaf kinds) are read with the variant functions and hashed
to a fingerprint; the fingerprint selects a declared mapping that turns the
record into canonical turns ``array<struct<role, text>>``. A layout is declared
by one sample record per shape it may take, so its fingerprints come from the
same function as the data's. The paths are read from a skeleton of the record: every
string value is cut to one letter and equal items that follow each other in a list are
kept once, so the texts never pass through a variant (whose size is bounded).

The template writes every turn as ``<turn>role<text>text</turn>`` and a newline.
Inside roles and texts a backslash becomes two and ``<`` becomes ``\\l``, so no
text can hold a mark; ``read_back`` splits on the marks and undoes the escapes.
The loss mask is a list of code-point ranges of the formatted string that cover
the assistant texts.

Edge cases: null and empty texts are empty turns and a null role is an empty
role, both kept; a record whose fingerprint no layout declares (or that is not
JSON) gives null turns and is reported by its fingerprint, never dropped; rows
with one conversation and turn number twice are both kept, ordered by role and
text; a null turn number comes first; rows of a null conversation form one
conversation; an empty table gives no rows; extra columns are ignored. A record and
what is made of it are one row each, so a conversation is bounded by a row's size (2 GB
in bytes, some ten times its text in memory); tested with one text of 70 MB.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = f"map('maxStringLen', '{(1 << 31) - 1}')"  # the parser's own bound on a string is 20 million
TURNS = "array<struct<role:string,text:string>>"
MARK_TURN, MARK_TEXT, MARK_END = "<turn>", "<text>", "</turn>\n"


@dataclass(frozen=True)
class Layout:
    """``samples``: records that show the field paths; ``schema``: how to read
    them; ``turns``: SQL over the parsed record ``r``, giving canonical turns."""
    name: str
    samples: tuple[str, ...]
    schema: str
    turns: str


LAYOUTS = (
    Layout("messages", ('{"messages":[{"role":"a","content":"b"}]}', '{"messages":[]}'),
           "messages array<struct<role:string,content:string>>",
           "transform(r.messages, m -> named_struct('role', coalesce(m.role, ''), 'text', coalesce(m.content, '')))"),
    Layout("shared", ('{"conversations":[{"from":"a","value":"b"}]}',),
           "conversations array<struct<from:string,value:string>>",
           "transform(r.conversations, m -> named_struct('role', case m.from when 'human' then 'user' when 'gpt' then "
           "'assistant' else coalesce(m.from, '') end, 'text', coalesce(m.value, '')))"),
    Layout("prompt", ('{"prompt":"a","completion":"b"}',), "prompt string, completion string",
           "array(named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.completion))"),
    Layout("instruction", ('{"instruction":"a","input":"b","output":"c"}',), "instruction string, input string, output string",
           "array(named_struct('role', 'system', 'text', r.instruction), named_struct('role', 'user', 'text', r.input), "
           "named_struct('role', 'assistant', 'text', r.output))"),
)


# A JSON string (loops without backtracking, so long texts take linear time and no stack).
STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"'


def skeleton(record: Column) -> Column:
    """The record with ``"x"`` for every string that is no key, and flat objects that
    equal the one before them in a list left out."""
    short = F.regexp_replace(record, rf'\G((?:[^"]++|{STRING}\s*+:)*+){STRING}', '$1"x"')
    return F.regexp_replace(short, r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++", "$1")


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON text (null if it is not JSON)."""
    return F.md5(F.schema_of_variant(F.try_parse_json(skeleton(record))))


def canonical_turns(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout_hash`` and ``turns`` (null for an undeclared layout)."""
    prints = df.sparkSession.range(1).select(*[
        fingerprint(F.lit(s)).alias(f"p{i}_{j}") for i, x in enumerate(layouts) for j, s in enumerate(x.samples)]).first()
    turns = F.lit(None).cast(TURNS)
    for i, x in enumerate(layouts):
        own = [prints[f"p{i}_{j}"] for j in range(len(x.samples))]
        parsed = F.expr(f"transform(array(from_json(`{record}`, '{x.schema}', {WHOLE})), r -> {x.turns})")[0]
        turns = F.when(F.col("layout_hash").isin(own), parsed.cast(TURNS)).otherwise(turns)
    return df.withColumn("layout_hash", fingerprint(F.col(record))).withColumn("turns", turns)


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    """Doubled backslashes pair up from the left, so what lies between the pairs
    holds a backslash only in ``\\l``."""
    parts = F.transform(F.split(c, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\l"), F.lit("<")))
    return F.array_join(parts, "\\")


def template(turns: Column) -> Column:
    """Struct of the formatted string and the loss mask (start from 0, length)."""
    blocks = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(MARK_TURN), escape(t["role"]), F.lit(MARK_TEXT)).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("loss")))
    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask"))

    def step(acc, b):
        start, size = acc["pos"] + F.length(b["head"]), F.length(b["body"]).cast("bigint")
        return F.struct((start + size + len(MARK_END)).alias("pos"), F.when(
            b["loss"], F.concat(acc["mask"], F.array(F.struct(start.alias("start"), size.alias("length"))))
        ).otherwise(acc["mask"]).alias("mask"))
    text = F.array_join(F.transform(blocks, lambda b: F.concat(b["head"], b["body"], F.lit(MARK_END))), "")
    return F.struct(text.alias("formatted"), F.aggregate(blocks, zero, step)["mask"].alias("loss_mask"))


def format_records(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, strict: bool = False) -> DataFrame:
    """Adds ``layout_hash``, ``turns``, ``formatted`` and ``loss_mask``. ``strict``: a
    record of an undeclared layout fails the job."""
    x = canonical_turns(df, record, layouts)
    if strict:
        x = x.withColumn("turns", F.when(F.col("turns").isNotNull(), F.col("turns")).otherwise(
            F.raise_error(F.concat(F.lit("undeclared layout: "), F.coalesce("layout_hash", F.lit("not JSON")))).cast(TURNS)))
    x = x.withColumn("_t", template(F.col("turns")))
    return x.withColumn("formatted", F.col("_t.formatted")).withColumn("loss_mask", F.col("_t.loss_mask")).drop("_t")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string."""
    blocks = F.filter(F.split(formatted, MARK_END, -1), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(
        unescape(F.substring_index(F.substr(b, F.lit(len(MARK_TURN) + 1)), MARK_TEXT, 1)).alias("role"),
        unescape(F.substring_index(b, MARK_TEXT, -1)).alias("text")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """Unescaped text under the loss mask, ranges joined with nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(
        F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def records_of(rows: DataFrame) -> DataFrame:
    """Rows by turn -> ``(conv_id, record)``: one JSON record per conversation.
    The grouping holds one conversation per row, which is the unit of output.
    The record's layout follows the roles, as mixed sources would have them."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    g = rows.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    known = F.forall("t", lambda t: t["role"].isin("user", "assistant", "system"))
    said = lambda i: F.col("t")[i]["text"]
    shared = F.struct(F.transform("t", lambda t: F.struct(
        F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"),
        t["text"].alias("value"))).alias("conversations"))
    messages = F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))
    record = (F.when(roles == F.array(F.lit("user"), F.lit("assistant")),
                     F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("completion"))))
              .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
                    F.to_json(F.struct(said(0).alias("instruction"), said(1).alias("input"), said(2).alias("output"))))
              .when(known & (F.size("t") % 2 == 1), F.to_json(shared)).otherwise(F.to_json(messages)))
    return g.select("conv_id", record.alias("record"))
