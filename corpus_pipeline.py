"""The corpus pipeline: documents that toxicity rejects go, one document of each
near-duplicate class stays, personal data is blanked, sources are mixed to their
target weights, and texts are encoded to token ids.

``run`` applies the stages one after the other; each result is written as Parquet
to the shared checkpoint folder and read again as the next stage's documents. All
but the last stage keep the columns of ``documents``.

A null text stays null and counts as empty; repeated rows are copies of each
other, so one stays; an empty table passes every stage; without labels of both
classes nothing is rejected; columns beyond those of ``documents`` pass through
to the stage before the last; a text of any length passes. The fold of held-out labels is
not used to train.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpline.llm import bagminhash, mixing, pii, toxicity
from helpline.llm.common import table
from helpline.llm.queries import coder
from helpline.session import materialize


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches 0.5 go."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, "text", model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays: the one of the least id."""
    return bagminhash.deduplicate(docs)


def blank_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes its kind in brackets; ``n_chars`` follows."""
    model = pii.fit(docs.select("doc_id", "text"))
    return pii.redact(docs, "text", model).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it (not at all, once or twice)."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)``: packed little-endian unsigned 32-bit ids."""
    x = coder(spark).encode(docs)
    return x.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


STAGES = [("toxicity", remove_toxic), ("near duplicates", deduplicate), ("personal data", blank_personal_data),
          ("mixing", mix_sources), ("encoding", encode)]

# A trained classifier, MinHash classes and byte-pair merges have no SQL form; the tests
# replay every stage on its own input by brute force (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
