"""Near-duplicate documents by BagMinHash over weighted shingles.

A document is the multiset of its five-word shingles. Every shingle carries
Poisson processes over its weight axis, one per dyadic range of weights (0, 1],
(1, 2], (2, 4], ...; a point has a time, a weight level and a register. A shingle
of weight w takes part with the points up to level w, so the first point of a
register is the same in two documents with probability equal to their weighted
Jaccard similarity, without bias. Points are made in order of time and only up to
the time by which all registers are filled, so the work is the number of shingles
plus about m log m, whatever the weights.

Equal texts are put together first. Registers are banded (``BANDS`` of ``ROWS``:
a pair at 0.8 is missed with probability 0.002, less above); documents that share
a band are linked to its least member, and connected candidates are compared
inside their component: signatures first, then exact multiset overlap for every
pair whose signatures come within four standard errors of the threshold and that
is not yet connected. Only verified spanning links leave a task, so a group of
many copies gives as many rows as members. A component above ``GROUP`` members is
dealt out as pairs of blocks. Verified links give the classes.

Edge cases: words are what lies between the characters 0x20 and 0x09 to 0x0D,
ASCII letters lower-cased; one to four words are one shingle; texts without words
(null ones too) are copies only of texts equal to them; repeated rows are copies;
a class of null ids has a null id; an empty table gives no rows; extra columns
are ignored (``deduplicate`` keeps them); of rows with the least id one stays; a text of
any length is one multiset, signed and packed whole in its row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from helpline.llm.common import connected_components, id_and_text
from helpline.session import materialize

SHINGLE = 5
REGISTERS, BANDS, ROWS = 128, 21, 6
THRESHOLD = 0.8
CUT = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
GROUP, SPLIT = 2_000, 1_000   # members compared in one task; members per block beyond
BATCH = 256                   # documents signed together


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _step(seed: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(seed + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64)))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, 48-bit key, count)`` of every distinct shingle, sorted."""
    bags = [t.encode("utf-8").lower().split() for t in texts]
    size = np.array([len(b) for b in bags], dtype=np.int64)
    code: dict[bytes, int] = {}
    flat = np.fromiter((code.setdefault(w, len(code)) for b in bags for w in b), dtype=np.int64, count=int(size.sum()))
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = pd.util.hash_array(np.array(list(code), dtype=object), categorize=False)[flat]
    own = np.repeat(np.arange(len(bags)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left = size[own] - at                       # words from here to the end of the text
    start = np.flatnonzero((left >= SHINGLE) | ((at == 0) & (size[own] < SHINGLE)))
    key = np.zeros(len(start), dtype=np.uint64)
    for k in range(SHINGLE):
        has = left[start] > k
        key[has] = _mix(key[has] ^ _step(word[start[has] + k], k + 1))
    own, key = own[start], key & np.uint64((1 << 48) - 1)
    order = np.lexsort((key, own))
    own, key = own[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])]))
    return own[first], key[first], np.diff(np.append(first, len(own)))


def signatures(own: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of registers: 16 bits of the first point of each."""
    out = np.zeros((n, REGISTERS), dtype=np.uint16)
    total = np.bincount(own, weights=weight, minlength=n)
    todo, reach = np.flatnonzero(total > 0), np.log(REGISTERS) + 4
    while len(todo):
        pick = np.zeros(n, bool)
        pick[todo] = True
        e = pick[own]
        horizon = REGISTERS * reach / np.maximum(total, 1)
        filled = _points(own[e], key[e], weight[e], horizon, out)
        todo, reach = todo[~filled[todo]], reach * 2
    return out


def _points(own, key, weight, horizon, out) -> np.ndarray:
    """All points up to the horizon of their document; True where all registers are filled."""
    found = []
    low, j = 0, 0
    while len(own):  # dyadic ranges of weight: (low, high]
        high = 1 if j == 0 else 2 * low
        rate = float(high - low)
        o, seed, w, t = own, _step(key, 1000 + j), weight, np.zeros(len(own))
        k = 0
        while len(o):
            u = (_step(seed, 2 * k + 1) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            t = t - np.log1p(-u) / rate
            on = t < horizon[o]
            o, seed, w, t = o[on], seed[on], w[on], t[on]
            h = _step(seed, 2 * k + 2)
            register = (h & np.uint64(REGISTERS - 1)).astype(np.int64)
            level = low + rate * ((h >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0 ** -32
            valid = level < w
            found.append((t[valid], o[valid] * REGISTERS + register[valid], (h[valid] >> np.uint64(48)).astype(np.uint16)))
            k += 1
        low, j = high, j + 1
        more = weight > low
        own, key, weight = own[more], key[more], weight[more]
    t, slot, mark = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-t, kind="stable")       # the earliest point is written last
    out.reshape(-1)[slot[order]] = mark[order]
    has = np.zeros(out.size, bool)
    has[slot] = True
    return has.reshape(out.shape).all(axis=1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[:, :BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        h = _mix(h ^ _step(rows[:, :, k], k + 1))
    return h.view(np.int64)


def pack(key: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted keys as compressed differences in byte planes, then the counts."""
    import zstandard
    diff = np.diff(key, prepend=np.uint64(0)).astype("<u8")
    raw = np.ascontiguousarray(diff.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes() + count.astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    n = len(raw) // 10
    diff = np.zeros((n, 8), dtype=np.uint8)
    diff[:, :6] = raw[:6 * n].reshape(6, n).T
    return np.cumsum(diff.view("<u8").ravel(), dtype=np.uint64), raw[6 * n:].view("<u4").astype(np.int64)


def similarity(a, b) -> float:
    """Exact weighted Jaccard similarity of two packed multisets."""
    (ka, ca), (kb, cb) = a, b
    if len(ka) > len(kb):
        ka, ca, kb, cb = kb, cb, ka, ca
    at = np.searchsorted(kb, ka)
    hit = at < len(kb)
    hit[hit] = kb[at[hit]] == ka[hit]
    both = np.minimum(ca[hit], cb[at[hit]]).sum()
    return both / (ca.sum() + cb.sum() - both)


def sign(docs: DataFrame) -> DataFrame:
    """``(uid, doc_id, key, bands, sig)`` per row; ``key`` tells equal texts.
    ``uid`` numbers the rows of this result; write it before using it twice."""
    def run(batches):
        part, n = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for at in range(0, len(b), BATCH):
                x = b.iloc[at:at + BATCH]
                own, key, count = shingles(list(x["text"]))
                sig = signatures(own, key, count, len(x))
                some = np.bincount(own, minlength=len(x)) > 0
                bands = band_keys(sig)
                yield pd.DataFrame({
                    "uid": part + n + np.arange(len(x)), "doc_id": x["doc_id"].astype("Int64").array, "key": x["key"].to_numpy(),
                    "bands": [list(r) if s else [] for r, s in zip(bands, some)], "sig": [r.tobytes() for r in sig]})
                n += len(x)
    texts = id_and_text(docs).select("doc_id", F.md5("text").alias("key"), "text")
    return texts.mapInPandas(run, "uid bigint, doc_id bigint, key string, bands array<bigint>, sig binary")


def bags(texts: DataFrame) -> DataFrame:
    """The ``text`` of every row replaced by its packed multiset ``bag``."""
    def run(batches):
        for b in batches:
            for at in range(0, len(b), BATCH):
                x = b.iloc[at:at + BATCH]
                own, key, count = shingles(list(x["text"]))
                cut = np.searchsorted(own, np.arange(len(x) + 1))
                yield x.drop(columns="text").assign(
                    bag=[pack(key[i:j], count[i:j]) for i, j in zip(cut[:-1], cut[1:])])
    rest = [f for f in texts.schema.fields if f.name != "text"]
    return texts.select(*(f.name for f in rest), "text").mapInPandas(
        run, StructType(rest + [StructField("bag", BinaryType())]))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Verified spanning links of one group: inside it, or across its two sides."""
    pdf = pdf.sort_values("uid").reset_index(drop=True)
    sig = np.vstack([np.frombuffer(x, dtype=np.uint16) for x in pdf["sig"]])
    side = pdf["side"].to_numpy()
    across = len(set(side)) > 1
    bags: dict[int, tuple] = {}

    def bag(i):
        if i not in bags:
            bags[i] = unpack(pdf["bag"][i])
        return bags[i]
    label, links = np.arange(len(pdf)), []
    uid = pdf["uid"].to_numpy()
    for i in range(1, len(pdf)):
        near = (sig[:i] == sig[i]).mean(axis=1)
        open_ = (near >= CUT) & (label[:i] != label[i])
        if across:
            open_ &= side[:i] != side[i]
        for j in np.argsort(-near, kind="stable"):
            if near[j] < CUT:
                break
            if open_[j] and label[j] != label[i] and similarity(bag(i), bag(j)) >= THRESHOLD:
                links.append((uid[j], uid[i]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(links, columns=["a", "b"])


def classes(docs: DataFrame) -> DataFrame:
    """``(uid, doc_id, key, class_id, kept)`` per row: ``class_id`` is the least
    id of the class, ``kept`` marks its one row that stays."""
    rows = materialize(sign(docs), "bag-rows")
    same = rows.groupBy("key").agg(F.min("uid").alias("rep"))
    reps = rows.join(same, F.col("uid") == F.col("rep"), "left_semi")
    bands = reps.select("uid", F.explode("bands").alias("band"))
    lead = bands.groupBy("band").agg(F.min("uid").alias("lead"), F.count("*").alias("n")).where("n > 1")
    pairs = bands.join(lead, "band").where("uid <> lead").select(F.col("uid").alias("a"), F.col("lead").alias("b"))
    near = connected_components(pairs, "bag-candidates")
    sized = near.join(near.groupBy("component").agg(F.count("*").alias("members")), "component")
    blocks = F.greatest(F.lit(1), F.when(F.col("members") > GROUP, F.ceil(F.col("members") / SPLIT)).otherwise(1)).cast("int")
    x = rows.select("uid", "key", "sig").join(sized.withColumn("blocks", blocks), F.col("uid") == F.col("id"))
    # only candidates need a multiset: made from their texts, of which copies are combined before they move
    whole = id_and_text(docs).select(F.md5("text").alias("key"), "text").dropDuplicates(["key"])
    x = bags(x.select("uid", "key", "sig", "component", "blocks").join(whole, "key"))
    x = x.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    links = x.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.col("own").alias("side"), "uid", "sig", "bag").groupBy("component", "i", "j").applyInPandas(
        _compare, "a bigint, b bigint")
    found = connected_components(links, "bag-classes")
    member = rows.select("uid", "doc_id", "key").join(same, "key")
    member = member.join(found, F.col("rep") == F.col("id"), "left").select(
        "uid", "doc_id", "key", F.coalesce("component", "rep").alias("root"))
    first = member.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))["uid"].alias("stays"))
    return member.join(first, "root").select("uid", "doc_id", "key", "class_id", (F.col("uid") == F.col("stays")).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per class, with all their columns."""
    keep = classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).where("kept")

    def row(id_, key):
        return F.md5(F.concat_ws(":", id_.cast("bigint"), key)).alias("_keep_row")
    keep = materialize(keep.select(row(F.col("doc_id"), F.col("key"))), "bag-kept")
    # texts move once: repeated rows meet by the same key as the rows that stay
    own = docs.select("*", row(F.col(doc_id), F.md5(F.coalesce(F.col(text), F.lit(""))))).dropDuplicates(["_keep_row"])
    return own.join(keep, "_keep_row", "left_semi").drop("_keep_row")
