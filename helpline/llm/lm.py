"""Language-model scores by a weighted backoff automaton over word trigrams.

Model: states are the histories of two words, of one word, and the root without history.
An arc from a state to the next word exists for every trigram (bigram) of the training
texts that continues it, weighted by its smoothed probability (absolute discounting,
interpolated with the state's failure target); the failure arc of a pair leads to its
last word's state, that of a word to the root, and carries what the discounts left. The
root's arcs are word probabilities with add-one-half smoothing, one share kept for an
unknown word, so every state's outgoing mass is one. A text is one left-to-right walk
that carries the state and adds log10 weights: the arc if there is one, else the failure
arc, and so on down to the root's arc.

Scale: no table of the model is ever in one place. Texts are packed into blocks of about
a million tokens, written once. Level by level, from trigrams down to words, blocks ask
hash buckets for the training counts of their n-grams and get them back in order; each
distinct n-gram is owned by one block, which counts it for its history in the next
round. Then every block has just the part of the automaton that its texts can reach.
What moves are packed arrays of 48-bit keys and counts, in proportion to the distinct
n-grams of the blocks; a frequent n-gram is one entry per block, so its bucket grows by an
entry per million tokens. Keys are 64-bit hashes; with a bucket of a million keys two of
them share bucket and 48 bits with probability of about 1 in 500.

Shuffle files of a level are of no use once its answers are written; Spark removes them
when the driver's garbage is collected, which ``_release`` asks for. Without it the job gives the
same rows and holds the files of all levels until it ends.

Edge cases: a null text is empty and scores its end alone; a text longer than a block is
cut, each part but the first led in by two words of context; repeated rows and null ids
give one row each; an empty table gives no rows; without training texts every word is
unknown; extra columns are ignored; equal counts need no order.
"""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpline.llm.common import fold, id_and_text
from helpline.session import materialize

BLOCK = 1_000_000   # tokens per block
BUCKET = 1_000_000  # keys per hash bucket, about
END = b"\n"         # no word holds a line feed
TOTAL = "<u8"       # counts over all blocks

BLOCK_SCHEMA = ("block bigint, row array<bigint>, doc_id array<bigint>, held array<boolean>, size array<int>, "
                "lead array<int>, codes binary, keys binary, n_tokens bigint")
ASK_SCHEMA = "bucket bigint, block bigint, keys binary, count binary, owned binary"
ANSWER_SCHEMA = ("level int, block bigint, bucket bigint, total binary, successors binary, owner binary, "
                 "n bigint, types bigint, once bigint, twice bigint")


def pack(a: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as compressed byte planes: of 32 bits within a block, of 64 (``TOTAL``)
    where they add up over blocks."""
    import zstandard
    planes = np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, kind: str = "<u4") -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def low48(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def wide48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of a pair of keys."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def make_blocks(batches):
    """Rows ``(doc_id, text, held)`` -> packed blocks."""
    part, seq, row = TaskContext.get().partitionId() << 32, 0, 0
    pieces, tokens = [], []

    def flush():
        code: dict[bytes, int] = {}
        codes = np.fromiter((code.setdefault(w, len(code)) for w in tokens), dtype=np.uint32, count=len(tokens))
        keys = pd.util.hash_array(np.array(list(code), dtype=object), categorize=False)
        cols = list(zip(*pieces))
        return pd.DataFrame({"block": [part + seq], **{k: [list(v)] for k, v in zip(("row", "doc_id", "held", "size", "lead"), cols)},
                             "codes": [pack(codes)], "keys": [keys.astype("<u8").tobytes()], "n_tokens": [len(tokens)]})
    for b in batches:
        for doc_id, text, held in zip(b["doc_id"].astype("object"), b["text"], b["held"]):
            words = text.encode("utf-8").lower().split()
            words.append(END)
            for at in range(0, len(words), BLOCK):
                piece = words[max(0, at - 2):at + BLOCK]
                pieces.append((part + row, None if pd.isna(doc_id) else int(doc_id), bool(held), len(piece), min(at, 2)))
                tokens += piece
                if len(tokens) >= BLOCK:
                    yield flush()
                    seq, pieces, tokens = seq + 1, [], []
            row += 1
    if tokens:
        yield flush()


def distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each among them."""
    return np.unique(pairs, return_inverse=True)


class Block:
    """A block unpacked: tokens, which of them count, and its distinct n-grams. A bigram
    is (left, right) of word codes, a trigram (pair, last) of a bigram and a word; ``pair_at``
    and ``triple_at`` tell the bigram and trigram that end at a token (-1: none)."""

    def __init__(self, r, trigrams: bool = True):
        self.codes = unpack(r["codes"]).astype(np.int64)
        self.keys = np.frombuffer(r["keys"], dtype="<u8")
        self.size = np.asarray(r["size"], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.lead = np.asarray(r["lead"], np.int64)
        place = np.arange(len(self.codes)) - np.repeat(self.begin, self.size)
        self.own = place >= np.repeat(self.lead, self.size)  # leading words are context only
        train = self.own & ~np.repeat(np.asarray(r["held"], bool), self.size)
        self.word_counts = np.bincount(self.codes[train], minlength=len(self.keys))
        at = np.flatnonzero(place >= 1)
        pairs, inverse = distinct((self.codes[at - 1] << 32) | self.codes[at])
        self.left, self.right = pairs >> 32, pairs & 0xFFFFFFFF
        self.pair_counts = np.bincount(inverse[train[at]], minlength=len(pairs))
        self.pair_at = np.full(len(self.codes), -1)
        self.pair_at[at] = inverse
        if not trigrams:
            return
        at = np.flatnonzero(place >= 2)
        triples, inverse = distinct((self.pair_at[at - 1] << 32) | self.codes[at])
        self.pair, self.last = triples >> 32, triples & 0xFFFFFFFF
        self.triple_counts = np.bincount(inverse[train[at]], minlength=len(triples))
        self.triple_at = np.full(len(self.codes), -1)
        self.triple_at[at] = inverse
        self.tail = np.zeros(len(triples), np.int64)  # the bigram that ends the trigram
        self.tail[inverse] = self.pair_at[at]

    def pair_keys(self) -> np.ndarray:
        return mix(self.keys[self.left], self.keys[self.right])

    def triple_keys(self) -> np.ndarray:
        last = self.keys ^ np.uint64(0x5851F42D4C957F2D)  # not the key of a word that follows a word
        return mix(self.pair_keys()[self.pair], last[self.last])


def ask(block: int, keys: np.ndarray, counts: np.ndarray, owned: np.ndarray | None, buckets: int):
    """One row per bucket that the keys fall into, in the keys' order."""
    to = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(np.diff(cut)):
        own = order[cut[k]:cut[k + 1]]
        rows.append((int(k), block, low48(keys[own]), pack(counts[own]), pack(owned[own]) if owned is not None else b""))
    return pd.DataFrame(rows, columns=["bucket", "block", "keys", "count", "owned"])


def gather(answers: pd.DataFrame, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals, successors and ownership from all buckets, back in the order of the keys."""
    to = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    out = [np.zeros(len(keys), np.int64) for _ in range(3)]
    if len(keys):
        a = answers.sort_values("bucket")
        for x, (c, kind) in zip(out, (("total", TOTAL), ("successors", TOTAL), ("owner", "<u4"))):
            if a[c].notna().all():
                x[order] = np.concatenate([unpack(v, kind) for v in a[c]])
    return tuple(out)


def answer(level: int):
    """Sums a bucket's counts over all blocks. Successors: the distinct n-grams that
    continue the key (not for trigrams). Owner: 1 where the block is the first with
    training counts of the key (not for words)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        keys = [wide48(x) for x in pdf["keys"]]
        size = [len(k) for k in keys]
        types, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.concatenate([unpack(x) for x in pdf["count"]]).astype(np.int64)
        total = np.zeros(len(types), np.int64)
        np.add.at(total, inverse, count)
        cut = np.cumsum(size)[:-1]
        owner, after = [None] * len(size), [None] * len(size)
        if level > 1:
            own = np.zeros(len(count), np.int64)
            seen = np.flatnonzero(count)
            own[seen[np.unique(inverse[seen], return_index=True)[1]]] = 1
            owner = [pack(x) for x in np.split(own, cut)]
        if level < 3:
            owned = np.concatenate([unpack(x) for x in pdf["owned"]]).astype(np.int64)
            sums = np.zeros(len(types), np.int64)
            np.add.at(sums, inverse, owned)
            after = [pack(x, TOTAL) for x in np.split(sums[inverse], cut)]
        rows = [(level, b, k, pack(t, TOTAL), s, o, 0, 0, 0, 0) for b, k, t, s, o in zip(
            pdf["block"], pdf["bucket"], np.split(total[inverse], cut), after, owner)]
        rows.append((level, None, None, None, None, None, int(total.sum()), int((total > 0).sum()),
                     int((total == 1).sum()), int((total == 2).sum())))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER_SCHEMA.split(", ")])
        return out.astype({"block": "Int64", "bucket": "Int64"})
    return run


def left_over(history: np.ndarray, successors: np.ndarray, discount: float) -> np.ndarray:
    """Of states: the mass that the discounts leave to the failure arc (1 for a state
    without arcs: it passes on)."""
    left = np.ones(len(history))
    seen = successors > 0
    left[seen] = discount * successors[seen] / history[seen]
    return left


class Automaton:
    """The part of the model that a block can reach; weights are log10. ``pair_fail`` and
    ``word_fail`` are failure arcs, ``triple`` and ``pair`` arcs (nan: there is none)."""

    def __init__(self, block: Block, words: np.ndarray, word_successors: np.ndarray, pairs: np.ndarray, pair_successors: np.ndarray,
                 triples: np.ndarray, n_tokens: int, n_types: int, discounts: tuple[float, float]):
        d2, d3 = discounts
        self.root = np.log10((words + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
        word_left = left_over(words, word_successors, d2)
        pair_left = left_over(pairs, pair_successors, d3)
        self.word_fail, self.pair_fail = np.log10(word_left), np.log10(pair_left)
        # probability of a word after one word, by arc or by failure
        low = word_left[block.left] * 10.0 ** self.root[block.right]
        has = pairs > 0
        low[has] += (pairs[has] - d2) / words[block.left[has]]
        self.pair = np.where(has, np.log10(low), np.nan)
        self.triple = np.full(len(triples), np.nan)
        has = triples > 0
        # the bigram that ends a seen trigram is seen too: its arc holds the lower probability
        self.triple[has] = np.log10((triples[has] - d3) / pairs[block.pair[has]]
                                    + pair_left[block.pair[has]] * low[block.tail[has]])

    def walk(self, block: Block) -> np.ndarray:
        """Weight of every token, read from left to right: the state after a token is the
        pair that ends there (or the word, at the start of a text)."""
        codes, pair_at, triple_at = block.codes, block.pair_at, block.triple_at
        before = np.concatenate([[0], codes[:-1]])
        score = self.root[codes]                                     # from the root
        second = pair_at >= 0
        arc = np.where(second, self.pair[pair_at], np.nan) if len(self.pair) else np.full(len(codes), np.nan)
        score = np.where(second, np.where(np.isnan(arc), self.word_fail[before] + score, arc), score)
        third = triple_at >= 0
        if third.any():
            arc = np.where(third, self.triple[triple_at], np.nan)
            state = np.concatenate([[0], pair_at[:-1]])
            score = np.where(third, np.where(np.isnan(arc), self.pair_fail[state] + score, arc), score)
        return score


def _release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps whose results are
    written; it learns of them only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, held_out=None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``
    per row; ``held_out``: Column of the rows not to learn from (default: fold 1)."""
    spark = docs.sparkSession
    held = (fold() == 1) if held_out is None else held_out
    texts = id_and_text(docs).select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    blocks = materialize(texts.mapInPandas(make_blocks, BLOCK_SCHEMA), "lm-blocks")
    n = blocks.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    buckets = max(1, -(-n // BUCKET))

    def ask_triples(batches):
        for b in batches:
            for _, r in b.iterrows():
                x = Block(r)
                yield ask(r["block"], x.triple_keys(), x.triple_counts, None, buckets)

    def ask_pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = Block(left.iloc[0])
        owner = gather(right, x.triple_keys(), buckets)[2]
        owned = np.bincount(x.pair[owner > 0], minlength=len(x.left))
        return ask(left["block"].iloc[0], x.pair_keys(), x.pair_counts, owned, buckets)

    def ask_words(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = Block(left.iloc[0], trigrams=False)
        owner = gather(right, x.pair_keys(), buckets)[2]
        owned = np.bincount(x.left[owner > 0], minlength=len(x.keys))
        return ask(left["block"].iloc[0], x.keys, x.word_counts, owned, buckets)

    def answered(asked: DataFrame, level: int, name: str) -> DataFrame:
        out = materialize(asked.groupBy("bucket").applyInPandas(answer(level), ANSWER_SCHEMA), name)
        _release(spark)
        return out

    def down(told: DataFrame, asking) -> DataFrame:
        told = told.where("block is not null").select("block", "bucket", "total", "successors", "owner")
        return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(asking, ASK_SCHEMA)

    triple_answers = answered(blocks.mapInPandas(ask_triples, ASK_SCHEMA), 3, "lm-triples")
    pair_answers = answered(down(triple_answers, ask_pairs), 2, "lm-pairs")
    word_answers = answered(down(pair_answers, ask_words), 1, "lm-words")
    every = triple_answers.union(pair_answers).union(word_answers)
    stats = {r["level"]: r for r in every.where("block is null").groupBy("level").agg(
        *[F.sum(c).alias(c) for c in ("n", "types", "once", "twice")]).collect()}
    n_tokens, n_types = (int(stats[1]["n"]), int(stats[1]["types"])) if 1 in stats else (0, 0)

    def discount(level: int) -> float:
        once, twice = (int(stats[level]["once"]), int(stats[level]["twice"])) if level in stats else (0, 0)
        return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
    discounts = discount(2), discount(3)

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = left.iloc[0]
        x = Block(r)
        of = lambda level, keys: gather(right[right["level"] == level], keys, buckets)
        triples, (pairs, pair_successors, _), (words, successors, _) = of(3, x.triple_keys())[0], of(2, x.pair_keys()), of(1, x.keys)
        a = Automaton(x, words, successors, pairs, pair_successors, triples, n_tokens, n_types, discounts)
        weight, base, known = a.walk(x), a.root[x.codes], words[x.codes] > 0
        rows = []
        for row, doc_id, h, size, lead, begin in zip(r["row"], r["doc_id"], r["held"], x.size, x.lead, x.begin):
            own = slice(begin + int(lead), begin + size)
            rows.append((row, doc_id, h, size - int(lead), int(known[own].sum()), float(base[own].sum()), float(weight[own].sum())))
        out = pd.DataFrame(rows, columns=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        return out.astype({"doc_id": "Int64"})

    answers = every.where("block is not null").select("level", "block", "bucket", "total", "successors", "owner")
    parts = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        walk, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[
        F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"),
                       "base_score", "score")
