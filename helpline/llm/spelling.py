"""Grouping of spelling variants by blocked Gram matrices of letter counts.

Words are counted with partial aggregation. A word is a vector of letter counts; one
inserted or deleted letter moves it by a squared distance of 1, a replaced one by 2.
Words are blocked by length and by their numbers of letters in two classes (lowest and
second bit of the code point clear): one edit changes the length and either number by at
most one, so only adjacent blocks meet. A block is dealt out by hash in tiles of bounded
size; for each pair of adjacent tiles one NumPy product gives all squared distances
|x|^2 + |y|^2 - 2 x.y (the norms are columns of the factors), pairs at most 2 apart are
kept, and the edit itself is verified. Only verified pairs leave a task.

The work is quadratic in the distinct frequent words of a block, as the method is, not in
occurrences: a very frequent word is one row.

Edge cases: a null text holds no words; a null id is the empty text in the hash; repeated
rows count each; equal counts go to the smaller word in code-point order; a word without
near words is its own root; an empty table gives no rows; extra columns are ignored; a
text of any length is read as a stream of runs, and tiles shrink as words grow.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpline.llm.common import id_and_text
from helpline.session import materialize

MODULUS = 97          # a word whose hash this divides loses one letter (fixed by the contract)
MIN_CHARS = 5
MIN_COUNT = 3
TILE = 8_192          # words of a tile, fewer where they are long
TILE_CHARS = 1 << 20
ROWS = 64             # rows of a tile multiplied at a time: their products stay in the cache
PAIRS = 8 << 26       # pairs of words a task compares, about
FLUSH = 200_000       # distinct words counted before a task passes them on


def reader(modulus: int, least: int):
    """Function from ``(doc_id, text)`` to counts of its words."""
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").finditer

    def words(doc_id, text: str) -> Counter:
        text = text.encode().translate(lower).decode()
        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        out = Counter(m.group() for m in find(text))
        for run in list(out):
            h = zlib.crc32(run.encode(), start)
            if h % modulus == 0:
                at, n = h % len(run), out.pop(run)
                cut = run[:at] + run[at + 1:]
                if len(cut) >= least:
                    out[cut, None] += n  # kept apart: a run of the same letters has its own hash
        for key in [k for k in out if isinstance(k, tuple)]:
            out[key[0]] += out.pop(key)
        return out
    return words


def count_words(docs: DataFrame, modulus: int = MODULUS, least: int = MIN_CHARS) -> DataFrame:
    """``(word, n)`` over all documents."""
    words = reader(modulus, least)

    def run(batches):
        held = Counter()
        for b in batches:
            for i, t in zip(b["doc_id"].astype("Int64"), b["text"]):
                held.update(words(None if pd.isna(i) else i, t))
                if len(held) > FLUSH:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})
    return id_and_text(docs).mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length (a byte a letter) as rows of letters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def letter_counts(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    place = np.full(256, -1)
    place[kinds] = np.arange(len(kinds))
    at = place[rows] + np.arange(len(rows))[:, None] * len(kinds)
    return np.bincount(at.ravel(), minlength=len(rows) * len(kinds)).reshape(len(rows), -1).astype(np.float32)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in exactly one letter, or rows of ``b``, one
    letter longer, become those of ``a`` by one deletion."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def near_in_tiles(left: list[bytes], right: list[bytes], same: bool):
    """Index arrays of the near pairs of two tiles (of one tile with itself: each once)."""
    a, b = letters(left), letters(right)
    kinds = np.union1d(np.unique(a), np.unique(b))
    x, y = letter_counts(a, kinds), letter_counts(b, kinds)
    xx, yy = (x * x).sum(axis=1, keepdims=True), (y * y).sum(axis=1, keepdims=True)
    x = np.hstack([2 * x, -xx, -np.ones_like(xx)])
    y = np.ascontiguousarray(np.hstack([y, np.ones_like(yy), yy]).T)
    for lo in range(0, len(a), ROWS):
        less = (x[lo:lo + ROWS] @ y).ravel()  # squared distances, negative
        i, j = np.divmod(np.flatnonzero(less > -2.5), y.shape[1])
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            ok = one_edit(a[p], b[q])
            yield p[ok], q[ok]


def near_pairs(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``(a, b)``: every unordered pair of ``words.word`` one edit apart, once. The words
    are distinct and of letters below 256."""
    block, tile_id = ["chars", "even", "low"], ["chars", "even", "low", "tile"]
    odd, high = (bytes(c for c in range(256) if c >> bit & 1) for bit in (0, 1))

    def shape(batches):
        for b in batches:
            raw = [w.encode("latin-1") for w in b["word"]]
            yield pd.DataFrame({"word": b["word"], "chars": [len(w) for w in raw], "even": [len(w.translate(None, odd)) for w in raw],
                                "low": [len(w.translate(None, high)) for w in raw]})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in tile_id}, "words": ["".join(sorted(rows["word"])).encode("latin-1")]})

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        cut = lambda w, n: [w[k:k + n] for k in range(0, len(w), n)]
        left, right = cut(r["words"], r["chars"]), cut(r["words_2"], r["chars_2"])
        same = all(r[c] == r[f"{c}_2"] for c in tile_id)
        out = [(left[i].decode("latin-1"), right[j].decode("latin-1")) for p, q in near_in_tiles(left, right, same) for i, j in zip(p, q)]
        return pd.DataFrame(out, columns=["a", "b"])

    w = materialize(words.select("word").mapInPandas(shape, "word string, chars int, even int, low int"), "spelling-words")
    blocks = w.groupBy(*block).agg(F.count("*").alias("n")).withColumn(
        "tiles", F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(TILE_CHARS) / F.col("chars"))))).cast("int"))
    blocks = materialize(blocks, "spelling-blocks")
    tiles = w.join(blocks.drop("n"), block).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")) \
        .groupBy(*tile_id).applyInPandas(pack, "chars int, even int, low int, tile int, words binary")
    tiles = materialize(tiles, "spelling-tiles")
    # a block meets itself, and the neighbours that one replaced or added letter leads to
    steps = [(0, 0, 0), (0, 0, 1), (0, 1, -1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]
    step = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(block, s)]) for s in steps]))
    second = lambda df: df.select(*[F.col(c).alias(f"{c}_2") for c in df.columns])
    met = blocks.withColumn("step", step).select(
        "*", *[(F.col(c) + F.col("step")[c]).alias(f"{c}_2") for c in block]).drop("step").join(second(blocks), [f"{c}_2" for c in block])
    work = met.agg(F.sum(F.col("n").cast("double") * F.col("n_2"))).first()[0] or 0
    pairs = met.drop("n", "n_2").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))) \
        .withColumn("tile_2", F.explode(F.sequence(F.lit(0), F.col("tiles_2") - 1))) \
        .where("chars <> chars_2 or even <> even_2 or low <> low_2 or tile <= tile_2").drop("tiles", "tiles_2")
    keys = [*tile_id, *[f"{c}_2" for c in tile_id]]
    # so many tasks as the comparisons need: the packed words are few bytes for much work
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / PAIRS))
    return pairs.join(tiles, tile_id).join(second(tiles), [f"{c}_2" for c in tile_id]).repartition(parts, *keys) \
        .groupBy(*keys).applyInPandas(near, "a string, b string")


def spelling_groups(docs: DataFrame, modulus: int = MODULUS, least: int = MIN_CHARS, count: int = MIN_COUNT,
                    tile: int = TILE) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of all frequent words."""
    words = materialize(count_words(docs, modulus, least).where(F.col("n") >= count), "spelling-counts")
    pairs = materialize(near_pairs(words, tile), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near") \
        .groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    kept = F.col("best").isNotNull() & (-F.col("best.rank") >= 2 * F.col("n"))
    out = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(kept, F.col("best.near")).alias("form"), F.when(kept, -F.col("best.rank")).alias("form_n")), "spelling-forms")
    # a form is at least twice as frequent, so a chain has at most log2(n) steps; each round doubles the steps taken
    roots = out.select("word", F.coalesce("form", "word").alias("root"))
    most = out.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(1 + math.log2(most)))):
        roots = materialize(roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("further")), "root")
                            .select("word", F.col("further").alias("root")), "spelling-roots")
    return out.join(roots, "word")
