"""Helpers shared by the operators: document input, folds, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helpline.session import materialize

# Characters that separate words: space and 0x09 to 0x0D (fixed by the contracts).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), so extra columns of any name
    cannot clash with the operator's own."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5 (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from every vertex: rows ``(id, component)``.

    ``edges``: ``(a, b)`` with a link between different ids. Alternating
    large-star and small-star steps: every step is one grouping by vertex with
    partial aggregation for the minimum and a join, never a collected group, so
    a vertex with very many links stays spread. Each round is written to the
    shared folder (lineage cut); it ends when a round changes nothing, after a
    number of rounds logarithmic in the component size. Empty input: no rows.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    cur = materialize(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
                      .where("a <> b").distinct(), f"{name}-edges")
    for _ in range(max_rounds):
        # large star: neighbours above a vertex move to the least id near it
        sym = both(cur)
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, f"{name}-large")
        # small star: a vertex and its smaller neighbours move to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        nxt = materialize(small, f"{name}-small")
        same = _fingerprint(nxt) == _fingerprint(cur)
        cur = nxt
        if same:
            break
    else:
        raise RuntimeError("connected components did not settle")
    star = cur.groupBy(F.greatest("a", "b").alias("id")).agg(F.min(F.least("a", "b")).alias("component"))
    return star.union(star.select(F.col("component").alias("id"), "component").distinct())


def _fingerprint(e: DataFrame) -> tuple:
    r = e.select(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).alias("h")).agg(
        F.count("*").alias("n"), F.expr("bit_xor(h)").alias("x"), F.sum(F.col("h") % 1000003).alias("s")).first()
    return tuple(r)
