"""Thin queries over the operators, in production settings, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from helpline.llm import (
    alignment, bagminhash, bpe, chat, collisions, fingerprint, lengths, lm, mixing, pii, repeats, spelling, toxicity,
)
from helpline.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def coder(spark: SparkSession) -> bpe.Bpe:
    return bpe.Bpe(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    x = chat.format_records(chat.records_of(rows.unionByName(extra)), strict=True)
    back = chat.read_back(F.col("formatted"))
    loss = chat.under_mask(F.col("formatted"), F.col("loss_mask"))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.withColumn("back", back).withColumn("loss", loss).select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, 20 + 2 * length(role) - length(replace(replace(role, '\', ''), '<', ''))
    + 2 * length(text) - length(replace(replace(text, '\', ''), '<', '')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_texts(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coder(spark)
    x = c.decode(c.encode(table(spark, sf_dir, "documents")))
    return x.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                    F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_table(lengths.token_lengths(coder(spark).encode(table(spark, sf_dir, "documents"))))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = pii.find_spans(docs, pii.fit(docs))
    return x.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
    (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w
  FROM d GROUP BY source),
step AS (
  SELECT 0 AS i, source, source_size, w, false AS full_up FROM s
  UNION ALL
  SELECT i + 1, source, source_size, w, full_up OR
    w * (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (WHERE full_up) OVER (), 0))
      / sum(w) FILTER (WHERE NOT full_up) OVER () > 2 * source_size
  FROM step WHERE i < (SELECT count(*) FROM s)),
last AS (SELECT * FROM step WHERE i = (SELECT count(*) FROM s)),
t AS (SELECT source, source_size, CASE WHEN full_up THEN 2 * source_size ELSE
    w * (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (WHERE full_up) OVER (), 0))
      / sum(w) FILTER (WHERE NOT full_up) OVER () END AS target FROM last),
x AS (SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fingerprint.with_next(table(spark, sf_dir, "documents"), parts=int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    x = x.select("doc_id", n.cast("bigint").alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(
        F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)).alias("edited"))
    x = x.withColumn("edited_fingerprint", fingerprint.fingerprint(F.col("edited")))
    return x.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                    fingerprint.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    fingerprint.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                    F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS k, doc_id, encode(coalesce(text, '')) AS x
  FROM documents),
w AS (SELECT k, p, md5_number_lower(array_slice(x, p + 1, p + 100)) AS m
  FROM (SELECT k, x, unnest(range(0, octet_length(x) - 99)) AS p FROM d)),
r AS (SELECT k, p FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY k, p) > 1),
e AS (SELECT k, p, CASE WHEN p <= lag(p) OVER (PARTITION BY k ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM r),
g AS (SELECT k, p, sum(opens) OVER (PARTITION BY k ORDER BY p) AS span FROM e),
s AS (SELECT k, min(p) AS lo, max(p) + 100 AS hi FROM g GROUP BY k, span),
c AS (SELECT k, lo, hi, coalesce(lag(hi) OVER (PARTITION BY k ORDER BY lo), 0) AS since FROM s),
o AS (SELECT k, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
    string_agg(CASE WHEN lo > since THEN hex(array_slice(x, since + 1, lo)) ELSE '' END, '' ORDER BY lo) AS kept
  FROM c JOIN d USING (k) GROUP BY k),
z AS (SELECT *, CASE WHEN coalesce(last, 0) < octet_length(x) THEN hex(array_slice(x, coalesce(last, 0) + 1, octet_length(x))) ELSE '' END AS rest
  FROM d LEFT JOIN o USING (k))
SELECT doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || rest)) AS kept_sha256
FROM z
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alignment.Aligner(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                          public_tokenizers.path("piece_bpe_32k.model"))
    return a.align(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {"op1_lm": op1_lm, "op2_chat": op2_chat, "op3_toxicity": op3_toxicity, "op4_bpe": op4_bpe, "op5_token_counts": op5_token_counts, "op6_pii": op6_pii,
           "op7_collisions": op7_collisions, "op8_mixing": op8_mixing, "op9_bagminhash": op9_bagminhash,
           "op10_fingerprint": op10_fingerprint, "op11_spelling": op11_spelling, "op12_repeats": op12_repeats,
           "op13_alignment": op13_alignment}
ORACLE_SQL = {"op2_chat": OP2_SQL, "op8_mixing": OP8_SQL, "op12_repeats": OP12_SQL}
