"""Token counts from an exact length histogram.

Documents are aggregated by encoded length (one row per distinct length, with
map-side combining); suffix sums over the histogram then answer, for every
context limit, how many documents and tokens lie below or reach it, what is
left after truncation, and every quantile. The histogram has at most as many
rows as the longest text has tokens, whatever the number of documents; suffix
sums run per band of lengths, and only one row per band meets in one window.

Edge cases: null and empty texts have length 0 and are counted; repeated rows
count as often as they occur; an empty table gives an empty histogram; columns beyond
those named are ignored; a text of any length is one more length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAND = 1_024  # lengths per band of the two-level suffix sums


def token_lengths(encoded: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens)`` of ``Bpe.encode`` output (packed 4-byte ids)."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"))


def length_table(lengths: DataFrame) -> DataFrame:
    """One row per distinct length ``L``, exact:

    ``docs``; ``docs_ge`` / ``tokens_ge`` (length at least L, suffix sums);
    ``tokens_below`` (tokens of shorter documents); ``prev_length`` (the next
    smaller length, -1 if none); ``truncated_total`` (tokens left when every
    document is cut at L); ``share_le`` (share of documents of length <= L).
    """
    hist = (lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("docs"))
            .withColumn("band", F.floor(F.col("length") / BAND)))
    bands = hist.groupBy("band").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("length")).alias("t"),
                                     F.max("length").alias("top"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bands = bands.select("band", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
                         F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
                         F.coalesce(F.max("top").over(below), F.lit(-1)).alias("top_below"),
                         F.sum("d").over(every).alias("n"), F.sum("t").over(every).alias("total"))
    inside = Window.partitionBy("band").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("band").orderBy("length")
    x = (hist.withColumn("d_in", F.sum("docs").over(inside))
         .withColumn("t_in", F.sum(F.col("docs") * F.col("length")).over(inside))
         .withColumn("prev_in", F.lag("length").over(before)).join(bands, "band"))
    docs_ge, tokens_ge = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    return x.select(
        "length", "docs", F.coalesce("prev_in", "top_below").alias("prev_length"),
        docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"), (F.col("total") - tokens_ge).alias("tokens_below"),
        (F.col("total") - tokens_ge + F.col("length") * docs_ge).alias("truncated_total"),
        ((F.col("n") - docs_ge + F.col("docs")) / F.col("n")).alias("share_le"))


def at_limits(lengths_table: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any limits, also between lengths: ``(context_limit, docs_ge,
    truncated_total)``; a limit above every length leaves all tokens."""
    spark = lengths_table.sparkSession
    want = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context_limit bigint"))  # the caller's list
    t = lengths_table
    hit = t.join(want, (F.col("prev_length") < F.col("context_limit")) & (F.col("context_limit") <= F.col("length")))
    inside = hit.select("context_limit", "docs_ge", (F.col("tokens_below") + F.col("context_limit") * F.col("docs_ge"))
                        .alias("truncated_total"))
    end = t.agg(F.max("length").alias("top"), F.sum(F.col("length") * F.col("docs")).alias("total"))
    over = want.join(end, F.col("context_limit") > F.col("top")).select(
        "context_limit", F.lit(0).cast("bigint").alias("docs_ge"), F.col("total").alias("truncated_total"))
    return inside.union(over)


def quantiles(lengths_table: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, length)``: the least length that a share of documents does not exceed."""
    spark = lengths_table.sparkSession
    want = F.broadcast(spark.createDataFrame([(float(x),) for x in shares], "share double"))
    return (lengths_table.join(want, F.col("share_le") >= F.col("share"))
            .groupBy("share").agg(F.min("length").alias("length")))
