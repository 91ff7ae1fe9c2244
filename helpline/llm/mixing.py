"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Every source has a weight; all sources together receive ``budget`` times the
words there are, in proportion to the weights; a source is clamped at
``max_epochs`` times its own words and the excess is shared again by weight
until none is above. With the sources sorted by cap per weight that fixed point
has a closed form: clamp the first k, spread the rest; prefix sums find k.

Repetitions: a source with target r times its size takes every document
floor(r) times; the fractional rest is a seeded sample: documents are ordered
by a keyed md5 and the first ones up to the rest are taken, so a source's words
miss its target by at most half a document. The order is resolved by hash
bucket: buckets before or after the one that holds the cut are decided whole, and
only that one bucket per source is sorted.

Edge cases: a null text has size 0; null sources are one source, ordered last;
a source of size 0 has target 0; repeated rows are separate documents (equal
rows are interchangeable); an empty table gives no rows; extra columns ignored; a text
of any length is counted in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helpline.llm.common import WORD_PATTERN
from helpline.session import materialize

BUCKET_HEX = 3  # hash buckets per source: 16 ** 3


def word_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def order_key(seed: str) -> Column:
    """Keyed md5 of the id and the text: the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                             F.md5(F.coalesce(F.col("text"), F.lit("")))))


def fill(sources: DataFrame, weights: tuple[int, ...], budget: float, max_epochs: float) -> DataFrame:
    """``(source, source_size)`` -> ``(source, source_size, target)``. One row per
    source, so the windows see the distinct sources, never the documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", F.row_number().over(order) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                       (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", "rank")
    every = Window.partitionBy()
    s = (s.withColumn("cap_before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("w_left", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", (F.sum("source_size").over(every) * F.lit(float(budget)) - F.col("cap_before")) / F.col("w_left")))
    # the first source that its level does not lift above its cap sets the water level
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def copies(rows: DataFrame, sizes: DataFrame, weights: tuple[int, ...], budget: float, max_epochs: float) -> DataFrame:
    """Adds ``_source_size``, ``_target`` and ``_copies`` to ``rows``, which have
    ``source``, ``_size`` and ``_key``; ``sizes``: the same rows' ``(source,
    size, key)``. The plan joined to the rows has one row per source."""
    buckets = materialize(sizes.groupBy("source", F.substring("key", 1, BUCKET_HEX).alias("bucket")).agg(F.sum("size").alias("words")),
                          "mix-buckets")
    targets = fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_epochs)
    run = Window.partitionBy("source").orderBy("bucket")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    ends = (buckets.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
            .withColumn("end", F.sum("words").over(run)))
    # the bucket that holds the cut: the first to end beyond the rest (none if there are no words)
    plan = ends.groupBy(F.col("source").alias("_s")).agg(
        F.first("source_size").alias("_source_size"), F.first("target").alias("_target"), F.first("whole").alias("_whole"),
        F.first("rest").alias("_rest"), F.coalesce(F.min(F.when(F.col("end") > F.col("rest"), F.struct(
            "bucket", (F.col("end") - F.col("words")).alias("begin")))), F.struct(F.lit("~").alias("bucket"), F.lit(0).cast("bigint")
                                                                                  .alias("begin"))).alias("_cut"))
    plan = materialize(plan, "mix-plan")
    x = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_bucket", F.substring("_key", 1, BUCKET_HEX))
    # without a rest nothing is taken once more, not even what has no words
    some = F.col("_rest") > 0
    sure = x.where("_bucket <> _cut.bucket").withColumn("_extra", (some & (F.col("_bucket") < F.col("_cut.bucket"))).cast("bigint"))
    upto = F.sum("_size").over(Window.partitionBy("_s").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, 0))
    cut = x.where("_bucket = _cut.bucket").withColumn(  # taken if the middle of the document lies before the cut
        "_extra", (some & (F.col("_cut.begin") + upto - F.col("_size") / 2 <= F.col("_rest"))).cast("bigint"))
    return sure.unionByName(cut).withColumn("_copies", F.col("_whole") + F.col("_extra")).drop(
        "_s", "_whole", "_rest", "_cut", "_bucket", "_extra")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0,
        seed: str = "mix") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` per row of ``docs``:
    ``taken`` counts the words that the mix takes, repeats included."""
    rows = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_size(F.col("text")).alias("_size"),
                                   order_key(seed).alias("_key")), "mix-sizes")
    x = copies(rows, rows.select("source", F.col("_size").alias("size"), F.col("_key").alias("key")), weights, budget, max_epochs)
    return x.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                    F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0,
              seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    rows = docs.withColumn("_size", word_size(F.col("text"))).withColumn("_key", order_key(seed))
    x = copies(rows, rows.select("source", F.col("_size").alias("size"), F.col("_key").alias("key")), weights, budget, max_epochs)
    return x.where("_copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(*docs.columns)
