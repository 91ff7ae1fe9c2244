"""Document fingerprints by one-permutation MinHash. DataFrame functions only.

Every shingle of five words is hashed once; the top bits of the hash choose one
of ``BINS`` bins and the least hash of a bin is its value. Sorting a document's
hashes puts the bins one after the other, so a value is the first hash of its
bin. An empty bin draws bins at random, by hash of its number and the draw, until
it meets a filled one and takes its value (optimal densification: every empty bin
draws independently, with the same draws in all documents); should DRAWS draws
all miss, the filled bin of the least hash with it ends the search. Of each bin's
value, hashed once more with the bin's number (so that bins that borrow the same
value stay independent), the low ``BITS`` bits are stored as one printable character;
characters that are equal by chance (1 in 64) are taken out of the likeness.

All of it is row-local: no shuffle, and work linear in the text but for the sort.

Edge cases: words are what lies between the characters 0x20 and 0x09 to 0x0D,
lower-cased; a text of one to four words is one shingle; a null
text or one without words has the empty fingerprint, like another empty one to
1 and any other to 0; equal texts have equal fingerprints; rows that repeat give
one output row each; an empty table gives no rows; extra columns are ignored; a text of
any length is hashed whole in its row (its hashes, 8 bytes a word, must fit one). In
``with_next`` all rows of one id (or without id) are ordered in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helpline.llm.common import id_and_text

BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 6          # stored bits per bin, as one printable character
FIRST_CHAR = 48
SHINGLE = 5
DRAWS = 8


def words_of(text: Column) -> Column:
    """Lower-cased words. The other separators become spaces first, since a split
    at one literal character needs no regular expression."""
    t = F.lower(text)
    for c in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(t, " ", -1), "")


def bin_of(h: Column) -> Column:
    """Top bits, numbered in the order in which hashes sort."""
    return F.shiftright(h, 64 - BIN_BITS) + BINS // 2


def fingerprint(text: Column) -> Column:
    """A string of one character per bin, empty for a text without words."""
    def hashes(w):
        n = F.size(w)
        return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(
            *[F.get(w, i + k) for k in range(SHINGLE)]))).when(n > 0, F.array(F.xxhash64(F.array_join(w, " "))))

    def firsts(h):
        return F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1))))

    def dense(filled):
        """All bins in order, null where empty."""
        gap = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n.cast("int"))

        def run(x, i):
            empty = bin_of(x) - 1 - F.when(i == 0, -1).otherwise(bin_of(F.get(filled, i - 1)))
            return F.when(empty == 0, F.array(x)).otherwise(F.concat(gap(empty), F.array(x)))
        return F.when(F.size(filled) == BINS, filled).otherwise(
            F.concat(F.flatten(F.transform(filled, run)), gap(BINS - 1 - bin_of(F.element_at(filled, -1)))))

    def characters(bins):
        def value(x, b):
            draws = [F.get(bins, F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(DRAWS)]
            last = F.array_min(F.transform(F.filter(bins, lambda y: y.isNotNull()),
                                           lambda y: F.struct(F.xxhash64(b, bin_of(y)).alias("o"), y.alias("y"))))["y"]
            return F.coalesce(x, *draws, last)
        return F.array_join(F.transform(bins, lambda x, b: F.char(
            F.xxhash64(value(x, b), b).bitwiseAND(F.lit((1 << BITS) - 1)) + FIRST_CHAR)), "")
    x = F.array(words_of(text))
    for step in (lambda w: F.sort_array(hashes(w)), firsts, dense, characters):
        x = F.transform(x, step)
    return F.coalesce(x[0], F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, 0 to 1."""
    same = F.aggregate(F.zip_with(F.split(a, "", BINS), F.split(b, "", BINS), lambda x, y: (x == y).cast("int")),
                       F.lit(0), lambda s, x: s + x)
    by_chance = 1.0 / (1 << BITS)
    raw = (same / F.lit(float(BINS)) - by_chance) / (1 - by_chance)
    return (F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0)
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``(doc_id, text, fingerprint, next_text, next_fingerprint)``: every row
    with the next one in descending ``doc_id`` (ties by text; null ids last;
    after the last row the first). Rows are cut into id ranges by approximate
    quantiles (fewer than ``parts`` numbers on the driver); ``lead`` runs inside
    a range and the last row of a range looks at the first row of the next
    non-empty one."""
    docs = id_and_text(docs)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 1000 * parts).alias("q")).first()["q"]
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    band = (F.when(F.col("doc_id").isNull(), -1)
            .otherwise(F.size(F.filter(cuts, lambda c: c < F.col("doc_id"))))).alias("band")
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    pair = F.struct("text", "fingerprint")
    inside = docs.withColumn("band", band).withColumn("fingerprint", fingerprint(F.col("text"))).withColumn(
        "next", F.lead(pair).over(Window.partitionBy("band").orderBy(*order)))
    top = docs.withColumn("band", band).groupBy("band").agg(F.max(F.struct("doc_id", "text")).alias("m"))
    ring = Window.orderBy(F.desc("band"))  # one row per range
    after = F.coalesce(F.lead("m").over(ring), F.first("m").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    top = top.select(F.col("band").alias("b"), after["text"].alias("text")).withColumn("fingerprint", fingerprint(F.col("text")))
    out = inside.join(top.select("b", pair.alias("after")), F.col("band") == F.col("b")).withColumn("next", F.coalesce("next", "after"))
    return out.select("doc_id", "text", "fingerprint", F.col("next.text").alias("next_text"),
                      F.col("next.fingerprint").alias("next_fingerprint"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, fingerprint)`` of every row."""
    return id_and_text(docs).withColumn("fingerprint", fingerprint(F.col("text")))
