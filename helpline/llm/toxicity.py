"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

Kernel of two words: the gap-weighted number of common subsequences of three
characters that span at most five (every position a subsequence skips costs a
factor), over the words' norms: the root of the summed squares of a word's occurrence
weights (its own kernel value if no subsequence occurs twice, less than that if one
does; repeated letters thus weigh more). An insult with a letter inserted or skipped
keeps most of its subsequences. Landmarks are words of the training sentences;
the Nyström map turns the kernel values to the landmarks into coordinates, in
which a linear machine (squared hinge) is trained on labelled sentences as bags
of words: a sentence scores as its worst word, and a sentence of a toxic document
takes part through its witness word, chosen anew in every round.

Subsequences of three characters over 64 character classes have an explicit
table of 64**3 weights, so landmarks, Nyström map and machine fold into one
table: scoring a word is a sum of table look-ups, the same value as the kernel
expansion. A document scores as its worst word; a logistic curve fitted to
document scores gives the result between 0 and 1.

The fit reads a bounded sample of labelled documents (``TRAIN_DOCS`` ids per class, one
text of each, ``TRAIN_SENTENCES`` of that); scores cover every text in full. Characters
beyond the basic plane are skipped.

Edge cases: a null text is empty; a text without words scores as the smallest
possible; repeated rows and null ids give one row each; a document with several
labels counts as toxic if one says so, null labels are ignored; without both
classes in the labels every score is 0; an empty table gives no rows; extra
columns are ignored; words of equal lift or score go by code points; a text of any
length is scored as one bag of words in its row, long words in windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpline.llm.common import fold, id_and_text

TRAIN_DOCS = 3_000       # labelled documents per class, expected
TRAIN_SENTENCES = 40     # sentences of each
SENTENCE_CHARS = 400     # a longer sentence is read in parts
LANDMARKS_TOXIC, LANDMARKS_OTHER = 160, 64
ROUNDS = 3
VARIED = 60              # most frequent witnesses that also train as misspelt
DECAY, SPAN = 0.6, 5     # weight per position spanned; longest span
OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
LONG, STEP = 24, 12      # a longer word is read in windows
FLOOR = -4.0             # score of a text without words

# Character classes. Letters, look-alikes of letters, digits; other
# letters share what is left of 64 classes; the rest is skipped.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s"}
BEGIN, END = 0, 1


def _classes() -> np.ndarray:
    t = np.full(0x10000, -1, dtype=np.int16)
    for i in range(0x80, 0x10000):
        if not 0xD800 <= i < 0xE000 and chr(i).isalnum():
            t[i] = 38 + i % 26
    for i in range(26):
        t[ord("a") + i] = 2 + i
    for i in range(10):
        t[ord("0") + i] = 28 + i
    for c, like in LOOK_ALIKE.items():
        t[ord(c)] = t[ord(like)]
    return t


CLASSES = _classes()
SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")


def words_of(text: str) -> list[str]:
    """Lower-cased words; runs of single characters are also joined to one word,
    and long words are cut into overlapping windows."""
    low = text.lower()
    words = low.split()
    if max(map(len, words), default=0) > LONG:
        words = list(chain.from_iterable(
            [w] if len(w) <= LONG else [w[i:i + LONG] for i in range(0, len(w) - LONG + STEP, STEP)] for w in words))
    return words + [m[0].replace(" ", "") for m in SPACED.finditer(low)]


def sentences_of(text: str) -> list[str]:
    parts = (p for p in re.split(r"[.!?\n]+", text) if p.strip())
    return [p[i:i + SENTENCE_CHARS] for p in parts for i in range(0, len(p), SENTENCE_CHARS)]


def _subsequences(words: list[str]):
    """``(word number, subsequence, weight)`` arrays and each word's norm."""
    n = len(words)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    cls = CLASSES[np.minimum(flat, 0xFFFF)]
    wid = np.repeat(np.arange(n), [len(w) for w in words])
    keep = cls >= 0
    # every word between two marks
    size = np.bincount(wid[keep], minlength=n) + 2
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    c = np.full(int(size.sum()), END, dtype=np.int64)
    c[start] = BEGIN
    own = np.repeat(np.arange(n), size)
    inner = np.ones(len(c), bool)
    inner[start] = False
    inner[start + size - 1] = False
    c[inner] = cls[keep]
    ids, subs, weights, norm = [], [], [], np.zeros(n)
    for a, b in OFFSETS:
        if len(c) <= a + b:
            continue
        ok = np.flatnonzero(own[:-(a + b)] == own[a + b:])
        ids.append(own[ok])
        subs.append((c[ok] << 12) | (c[ok + a] << 6) | c[ok + a + b])
        weights.append(DECAY ** (a + b))
        norm += np.bincount(own[ok], minlength=n) * DECAY ** (2 * (a + b))
    return ids, subs, weights, np.sqrt(np.maximum(norm, 1e-12))


def kernel_sum(words: list[str], table: np.ndarray) -> np.ndarray:
    """Per word the sum of its subsequences' table weights, over its norm."""
    if not words:
        return np.zeros(0)
    ids, subs, weights, norm = _subsequences(words)
    out = np.zeros(len(words))
    for i, s, w in zip(ids, subs, weights):
        out += np.bincount(i, weights=table[s], minlength=len(words)) * w
    return out / norm


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel matrix of two short word lists (through each word of ``b``'s own table)."""
    out = np.zeros((len(a), len(b)))
    for j, w in enumerate(b):
        out[:, j] = kernel_sum(a, word_table([w], np.ones(1)))
    return out


def word_table(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Table of the weighted sum of the words' subsequence vectors."""
    ids, subs, decay, norm = _subsequences(words)
    t = np.zeros(1 << 18)
    for i, s, d in zip(ids, subs, decay):
        np.add.at(t, s, d * weights[i] / norm[i])
    return t


@dataclass
class Model:
    """Folded machine: margin of a word is ``bias + kernel_sum``; ``slope`` and
    ``offset`` of the logistic curve over document margins."""
    table: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def parts(self) -> tuple:
        """Plain array and numbers to broadcast: a worker need not know this class."""
        return self.table, self.bias, self.slope, self.offset

    def margins(self, words: list[str]) -> np.ndarray:
        return self.bias + kernel_sum(words, self.table)

    def documents(self, texts) -> np.ndarray:
        """Worst word's margin per text; words are scored once per call."""
        bags = [words_of(t) for t in texts]
        words = list(set(chain.from_iterable(bags)))
        score = dict(zip(words, self.margins(words).tolist()))
        return np.array([max([score[w] for w in bag], default=FLOOR) for bag in bags])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def _machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge, Newton steps in the primal."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-6
    for _ in range(30):
        act = y * (x @ w) < 1
        xa, ca = x[act], cost[act]
        hess = (xa * ca[:, None]).T @ xa + np.diag(ridge)
        new = np.linalg.solve(hess, xa.T @ (ca * y[act]))
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def variants(word: str) -> list[str]:
    """The word with a letter doubled or an x inserted in two places, for training."""
    if not 4 <= len(word) <= LONG:
        return []
    return [word[:i] + c + word[i:] for i in (len(word) // 3, 2 * len(word) // 3) for c in (word[i], "x")]


def diverse(lists: list[list[str]], words: set[str]) -> set[str]:
    """Those of the words whose commonest neighbour, on either side, stands at
    no more than half of their occurrences."""
    beside: list[dict[str, dict[str, int]]] = [{}, {}]
    for line in lists:
        for i, w in enumerate(line):
            if w in words:
                for side, n in ((0, line[i - 1] if i else ""), (1, line[i + 1] if i + 1 < len(line) else "")):
                    seen = beside[side].setdefault(w, {})
                    seen[n] = seen.get(n, 0) + 1
    return {w for w in words if all(2 * max(b[w].values()) <= sum(b[w].values()) for b in beside)}


def train(sentences: list[tuple[int, str]]) -> Model:
    """``(label, sentence)`` -> folded machine (without the logistic curve).

    A toxic document with many copies would lend all its rare words the counts of
    an insult. So equal sentences train once, and only a word that stands among
    changing neighbours can be a landmark or a first witness."""
    clean = {s for y, s in sentences if not y}
    lists = [(y, [w for w in (re.sub(r"[^\w@$]+", "", w) for w in words_of(s)) if w])
             for y, part in ((0, clean), (1, {s for y, s in sentences if y} - clean)) for s in sorted(part)]
    bags = [(y, sorted(set(words))) for y, words in lists]
    pos: dict[str, int] = {}
    neg: dict[str, int] = {}
    for y, bag in bags:
        seen = pos if y else neg
        for w in bag:
            seen[w] = seen.get(w, 0) + 1
    n_pos, n_neg = sum(y for y, _ in bags) + 1, sum(1 - y for y, _ in bags) + 1
    lift = {w: np.log((c + 0.1) / n_pos) - np.log((neg.get(w, 0) + 0.5) / n_neg) for w, c in pos.items()}
    share = n_pos / (n_pos + n_neg)

    def surprise(w):
        """Nats by which a word's share of toxic sentences exceeds chance."""
        a, b = pos[w], neg.get(w, 0)
        return a * np.log(a / (a + b) / share) + (b * np.log(b / (a + b) / (1 - share)) if b else 0.0)
    free = diverse([words for y, words in lists if y], {w for w in pos if lift[w] > 1 and surprise(w) > np.log(len(pos))})
    ranked = sorted(free, key=lambda w: (-pos[w] * lift[w], w))
    others = sorted(set(neg) - free, key=lambda w: (-neg[w], w))
    marks = ranked[:LANDMARKS_TOXIC] + others[:LANDMARKS_OTHER]
    kmm = kernel(marks, marks)
    val, vec = np.linalg.eigh(kmm)
    root = (vec / np.sqrt(np.maximum(val, 1e-6))) @ vec.T

    def coordinates(words):
        return np.vstack([kernel(words[i:i + 5000], marks) @ root for i in range(0, len(words), 5000)])
    # witnesses: the word of a toxic sentence that its documents have most above the others
    witness = [max(bag, key=lambda w: (w in free, lift[w], w)) for y, bag in bags if y and bag]
    witness = [w for w in witness if w in free]
    hard = others[:4000]
    table, bias = np.zeros(1 << 18), -1.0
    every = others
    for _ in range(ROUNDS):
        p, counts = np.unique(np.array(witness, dtype=object).astype(str), return_counts=True)
        often = p[np.argsort(-counts, kind="stable")][:VARIED]
        varied = sorted({v for w in often for v in variants(w)} - set(others) - set(p))
        words = list(p) + varied + hard
        y = np.array([1.0] * (len(p) + len(varied)) + [-1.0] * len(hard))
        cost = np.concatenate([20.0 * np.minimum(counts, 50) / 50 + 2, np.full(len(varied), 4.0), np.full(len(hard), 10.0)])
        w, bias = _machine(coordinates(words), y, cost)
        table = word_table(marks, root @ w)
        margin = bias + kernel_sum(every, table)
        worst = [every[i] for i in np.argsort(-margin, kind="stable")[:4000]]
        hard = sorted(set(hard) | set(worst))
        score = {}
        for yb, bag in bags:
            if yb:
                score.update(dict.fromkeys(bag, 0.0))
        names = list(score)
        score = dict(zip(names, bias + kernel_sum(names, table)))
        best = [max(bag, key=lambda x: (score[x], x)) for yb, bag in bags if yb and bag]
        witness = [x for x in best if x in free or score[x] > 0.5 and x not in neg] or witness
    return Model(table, bias)


def training_labels(labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``(id, toxic)``: a keyed-hash sample of the training folds' labels with
    about ``train_docs`` documents per class."""
    lab = (labels.where("doc_id is not null and toxic is not null").where(fold("doc_id") != 0)
           .groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")))
    count = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, train_docs / max(1, count.get(y, 0))) for y in (0, 1)}
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20))
    limit = F.when(F.col("toxic") == 1, int(share[1] * (1 << 20))).otherwise(int(share[0] * (1 << 20)))
    return lab.where(draw < limit)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Trains on the sample; None without both classes."""
    def take(batches):
        for b in batches:
            rows = []
            for y, t in zip(b["toxic"], b["text"]):
                s = sentences_of(t)
                if len(s) > TRAIN_SENTENCES:  # evenly over the document
                    s = [s[i * len(s) // TRAIN_SENTENCES] for i in range(TRAIN_SENTENCES)]
                rows += [(y, x) for x in s]
            yield pd.DataFrame(rows, columns=["toxic", "sentence"])
    sample = F.broadcast(training_labels(labels))  # about 2 * TRAIN_DOCS rows of two numbers
    # one text of an id, so that the sample is bounded by ids however often one repeats
    known = id_and_text(docs).join(sample, F.col("doc_id") == F.col("id")).groupBy("id", "toxic").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("toxic", "text")
    rows = [(r["toxic"], r["sentence"]) for r in known.mapInPandas(take, "toxic int, sentence string").distinct().collect()]
    if len({y for y, _ in rows}) < 2:
        return None
    model = train(sorted(rows))
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    def score(batches):
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "margin": Model(*sent.value).documents(b["text"])})
    pairs = known.mapInPandas(score, "toxic int, margin double").toPandas()
    y, x = pairs["toxic"].to_numpy(float), np.vstack([pairs["margin"], np.ones(len(pairs))]).T
    w = np.array([1.0, 0.0])
    for _ in range(50):  # logistic curve, Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (y - p) - 0.1 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.offset = float(w[0]), float(w[1])
    return model


def score_texts(docs: DataFrame, model: Model | None, batch: int = 500) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    docs = id_and_text(docs).select("doc_id", (fold() == 0).alias("held_out"), "text")
    if model is None:
        return docs.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches):
        model = Model(*sent.value)
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at:at + batch]
                p = model.probability(model.documents(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "held_out": part["held_out"].to_numpy(),
                                    "score": p, "predicted": (p >= 0.5).astype("int32")})
    return docs.mapInPandas(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, text: str, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        model = Model(*sent.value)
        parts = [texts.iloc[i:i + 500].fillna("") for i in range(0, len(texts), 500)]
        return pd.Series(np.concatenate([model.probability(model.documents(x)) >= 0.5 for x in parts])
                         if parts else np.zeros(0, bool))
    return docs.where(~toxic(F.col(text)))
