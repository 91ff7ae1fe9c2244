"""Removal of byte strings that repeat earlier text, by longest-previous-factor arrays.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier:
in a document of smaller id, or earlier in the same document. Strings are judged on the
input, overlaps count, matches never cross documents.

Method. A suffix array of the whole corpus is built in buckets that never split a
match. Every window of ``length`` bytes names an anchor, its least hashed ``gram``
(leftmost of equals), so equal windows name equal anchors at equal offsets; windows in a row
with one anchor are a run, and the bytes of a run are its segment.

1. Blocks of documents tell each distinct (anchor, segment) once, as packed hashes dealt
   by the anchor. An anchor met once can't hold a repeat. Of equal segments all but the
   earliest repeat entirely. The earliest of an anchor with several segments goes on.
2. Those segments meet by anchor. Their suffixes are sorted (prefix doubling, to
   ``length`` bytes, equal ones by position). There the previous smaller position of a
   suffix that equals its left neighbour is that neighbour, and no next smaller position
   shares ``length`` bytes, so the longest previous factor reaches ``length`` exactly
   where a suffix has the rank of its left neighbour.
3. Each block cuts the bytes that its repeated windows cover.

The texts are shuffled once (the three uses share the exchange). A passage in very many
documents is one entry of each block; an anchor with more than ``HOT`` different segments
is dealt by window instead, so its segments spread over all buckets. Equal segments are
told by 64-bit hashes of the anchor and of the segment: m different segments of one
anchor mix two up with odds of m * m / 2^65. All steps are pure functions of rows, so
lost tasks are simply run again.

Edge cases: a null text is empty; texts shorter than ``length`` stay whole; a null id
comes before all others; rows with one id are ordered by a hash of their text; identical
rows are copies, of which one is the first and the others go entirely (if they are long
enough); an empty table gives no rows; extra columns are ignored. A text must fit a row
of the engine (2 GB); it is scanned in pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpline.llm.common import id_and_text

LENGTH = 100          # bytes a repeated string has at least
GRAM = 32             # bytes of an anchor
BLOCK = 8 << 20       # bytes of text in a block
BUCKET = 4 << 20      # bytes of text for each bucket of segments
HOT = 20_000          # different segments of an anchor, beyond which windows are dealt singly
PIECE = 1 << 20       # windows scanned at a time
LOW = np.uint64((1 << 22) - 1)  # low bits of an anchor's sort key: its place in a piece
ALONE, REPEAT, COMPARE, SINGLY = range(4)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Roller:
    """Hashes of any substring of a piece: polynomials modulo 2^64 over random byte values."""

    def __init__(self, size: int):
        base = 0x5851F42D4C957F2D
        one = np.ones(1, np.uint64)
        self.up = np.cumprod(np.concatenate([one, np.full(size, base, np.uint64)]))
        self.down = np.cumprod(np.concatenate([one, np.full(size, pow(base, -1, 1 << 64), np.uint64)]))
        self.value = mixed(np.arange(1, 257, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (prefix[hi] - prefix[lo]) * self.down[lo]


def sliding_minimum(a: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` values in a row, from block-wise running minima."""
    full = np.full(-(-len(a) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:len(a)] = a
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:len(a) - width + 1], ahead[width - 1:len(a)])


def pieces(texts: list[bytes], length: int, size: int):
    """Lists of ``(text number, offset, bytes)`` of about ``size`` bytes; the pieces of a
    long text overlap, so that each of its windows lies in exactly one."""
    got, held = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, size):
            part = t[at:at + size + length - 1]
            if got and held + len(part) > size:
                yield got
                got, held = [], 0
            got.append((i, at, part))
            held += len(part)
    if got:
        yield got


def runs(texts: list[bytes], length: int, gram: int, piece: int = PIECE) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, in text order: number of the text, first window,
    number of windows, hash of the anchor, hash of the segment with the anchor's place."""
    out = {k: [np.zeros(0, t)] for k, t in
           (("text", np.int64), ("lo", np.int64), ("n", np.int64), ("anchor", np.uint64), ("segment", np.uint64))}
    roller = Roller(piece + length) if texts else None
    for group in pieces(texts, length, piece):
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        prefix = roller.prefix(data)
        at = np.arange(len(data) - gram + 1)
        grams = roller.of(prefix, at, at + gram)
        place = (sliding_minimum((mixed(grams) & ~LOW) | at.astype(np.uint64), length - gram + 1) & LOW).astype(np.int64)
        size = np.array([len(p) for _, _, p in group])
        begin = np.cumsum(size) - size
        count = size - length + 1
        owner = np.repeat(np.arange(len(group)), count)
        window = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
        new = np.ones(len(window), bool)
        new[1:] = (place[window[1:]] != place[window[:-1]]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(window)))
        lo, who = window[first], owner[first]
        anchor = place[lo]
        out["text"].append(np.array([i for i, _, _ in group])[who])
        out["lo"].append(lo - begin[who] + np.array([o for _, o, _ in group])[who])
        out["n"].append(n)
        out["anchor"].append(grams[anchor])
        shape = ((anchor - lo).astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
        out["segment"].append(mixed(mixed(roller.of(prefix, lo, lo + n - 1 + length)) ^ shape))
    return {k: np.concatenate(v) for k, v in out.items()}


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether a row is the first of those with its keys."""
    order = np.lexsort(keys)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.ones(len(order), bool)
    out[order[1:][same]] = False
    return out


def verdicts(rows: pd.DataFrame, hot: int) -> list[bytes]:
    """One byte for every told segment of a bucket, in the order told."""
    cols = [[np.frombuffer(x, t) for x in rows[c]] for c, t in (("anchors", "<u8"), ("segments", "<u8"), ("ids", "<i8"))]
    size = [len(x) for x in cols[0]]
    anchor, segment, ids = (np.concatenate(c) for c in cols)
    block = np.repeat(rows["block"].to_numpy(), size)
    out = np.full(len(anchor), ALONE, np.uint8)
    order = np.argsort(anchor, kind="stable")
    same = anchor[order][1:] == anchor[order][:-1]
    met = np.zeros(len(order), bool)
    met[1:] |= same
    met[:-1] |= same
    i = order[met]
    i = i[np.lexsort((i, block[i], ids[i], segment[i], anchor[i]))]
    new_anchor, new_segment = np.ones(len(i), bool), np.ones(len(i), bool)
    new_anchor[1:] = anchor[i][1:] != anchor[i][:-1]
    new_segment[1:] = new_anchor[1:] | (segment[i][1:] != segment[i][:-1])
    group = np.cumsum(new_anchor) - 1
    kinds = np.bincount(group, new_segment, minlength=0).astype(np.int64)[group] if len(i) else np.zeros(0, np.int64)
    out[i] = np.where(~new_segment, REPEAT, np.where(kinds > hot, SINGLY, np.where(kinds > 1, COMPARE, ALONE)))
    return [x.tobytes() for x in np.split(out, np.cumsum(size)[:-1])]


def ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the ``length`` bytes from each place ``at`` in byte order, by prefix
    doubling from 8-byte words (equal strings share a rank)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    width = 1
    rank = padded[:n + length].astype(np.uint64)
    while width < 8 and 2 * width <= length:  # words: bytes side by side need no sort
        rank = (rank[:len(rank) - width] << np.uint64(8 * width)) | rank[width:]
        width *= 2
    while True:
        step = min(width, length - width)
        values = np.unique(rank)
        rank = np.searchsorted(values, rank).astype(np.uint64) if len(values) < len(rank) // 64 else \
            np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        if step == 0:
            return rank[at].astype(np.int64)
        if width + step == length:  # the last step, only where it is asked for
            pair = (rank[at] << np.uint64(32)) | rank[at + step]
            return np.unique(pair, return_inverse=True)[1].astype(np.int64)
        rank = (rank[:len(rank) - step] << np.uint64(32)) | rank[step:]
        width += step


def earlier_matches(segments: list[bytes], n: np.ndarray, length: int) -> np.ndarray:
    """Of the windows of segments in corpus order, one after the other: whether their
    longest previous factor reaches ``length``."""
    size = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    owner = np.repeat(np.arange(len(size)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + (np.cumsum(size) - size)[owner]
    # windows whose hash is alone have no equal; a segment of such windows needs no sorting
    told = np.zeros(len(at), np.uint64)
    roller, step = Roller(PIECE + length), PIECE
    for lo in range(0, len(data), step):
        here = slice(*np.searchsorted(at, (lo, lo + step)))
        prefix = roller.prefix(data[lo:lo + step + length])
        told[here] = roller.of(prefix, at[here] - lo, at[here] - lo + length)
    order = np.argsort(told)
    same = told[order][1:] == told[order][:-1]
    met = np.zeros(len(at), bool)
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    keep = np.zeros(len(size), bool)
    keep[owner[met]] = True
    out = np.zeros(len(at), bool)
    if not keep.any():
        return out
    kept = np.repeat(keep, size)
    data, at = data[kept], at - (np.cumsum(~kept) - ~kept)[at]
    ask = np.flatnonzero(met)
    rank = ranks(data, at[ask], length)
    suffixes = np.argsort(rank, kind="stable")  # suffix order, equal ones by position
    reach = rank[suffixes][1:] == rank[suffixes][:-1]  # common prefix with the left neighbour
    out[ask[suffixes[1:][reach]]] = True
    return out


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


class Block:
    """The documents of a block in corpus order, and what they tell of their runs."""

    def __init__(self, rows: pd.DataFrame, length: int, gram: int):
        none = rows["doc_id"].isna()
        ids = [np.iinfo(np.int64).min if x else int(i) for x, i in zip(none, rows["doc_id"])]
        order = sorted(range(len(ids)), key=lambda i: (not none.iloc[i], ids[i], rows["text"].iloc[i]))
        self.rows = rows.iloc[order]
        self.ids = np.array(ids, np.int64)[order]
        self.texts = [bytes(t) for t in self.rows["text"]]
        self.length = length
        self.runs = runs(self.texts, length, gram)
        self.told = first_of(self.runs["segment"], self.runs["anchor"])

    def tell(self, buckets: int):
        """Number of bucket and the runs told there."""
        own = np.flatnonzero(self.told)
        bucket = (mixed(self.runs["anchor"][own]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(own[order], cut) if len(own) else ():
            yield int(mixed(self.runs["anchor"][part[:1]])[0] % np.uint64(buckets)), part

    def hear(self, answers: pd.DataFrame, buckets: int) -> np.ndarray:
        """Verdict on every run; one that the block met before repeats."""
        said = dict(zip(answers["bucket"], answers["verdicts"]))
        out = np.full(len(self.told), REPEAT, np.uint8)
        for bucket, part in self.tell(buckets):
            out[part] = np.frombuffer(said[bucket], np.uint8)
        return out

    def segment(self, i: int) -> bytes:
        lo = int(self.runs["lo"][i])
        return self.texts[self.runs["text"][i]][lo:lo + int(self.runs["n"][i]) - 1 + self.length]

    def singles(self, heard: np.ndarray):
        """``(text, window, bytes, met before in the block)`` of the runs dealt by window."""
        seen = set()
        for i in np.flatnonzero(heard == SINGLY):
            text, lo = int(self.runs["text"][i]), int(self.runs["lo"][i])
            for at in range(lo, lo + int(self.runs["n"][i])):
                window = self.texts[text][at:at + self.length]
                yield text, at, window, window in seen
                seen.add(window)


def unique_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, copies)``. Texts are grouped only if some id repeats."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if ids.limit(1).count():
        return docs.groupBy("doc_id", "text").agg(F.count("*").cast("int").alias("copies"))
    return docs.withColumn("copies", F.lit(1))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK,
                   bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, kept, spans)``: the bytes that stay, and the removed stretches
    as ``(start, stop)`` in bytes of the input."""
    if not 8 < gram < length:
        raise ValueError("an anchor has more than 8 bytes and fewer than the length")
    docs = unique_rows(id_and_text(docs)).withColumn("text", F.col("text").cast("binary"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = (max(1, -(-total // x)) for x in (block, bucket))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        b, out = Block(rows, length, gram), []
        for number, part in b.tell(buckets):
            out.append((number, rows["block"].iloc[0], b.runs["anchor"][part].tobytes(), b.runs["segment"][part].tobytes(),
                        b.ids[b.runs["text"][part]].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "block", "anchors", "segments", "ids"])

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "verdicts": verdicts(rows, hot)})

    def send(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["bucket", "block", "doc_id", "doc", "lo", "n", "segment"])
        b, number = Block(rows, length, gram), rows["block"].iloc[0]
        heard = b.hear(answers, buckets)
        own = np.flatnonzero(heard == COMPARE)
        r = {k: v[own] for k, v in b.runs.items()}
        out = pd.DataFrame({"bucket": (mixed(r["anchor"]) % np.uint64(buckets)).astype(np.int64), "block": number,
                            "doc_id": b.ids[r["text"]], "doc": r["text"], "lo": r["lo"], "n": r["n"],
                            "segment": [b.segment(i) for i in own]})
        alone = [(zlib.crc32(w) % buckets, number, b.ids[t], t, at, 1, w) for t, at, w, met in b.singles(heard) if not met]
        return pd.concat([out, pd.DataFrame(alone, columns=out.columns)]) if alone else out

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "block", "doc", "lo"])
        n = rows["n"].to_numpy()
        flags = earlier_matches(list(rows["segment"]), n, length)
        begin = np.cumsum(n) - n
        edges = np.zeros(len(flags) + 1, bool)
        edges[begin] = True  # a stretch of windows ends with its segment
        start = flags & np.concatenate([[True], ~flags[:-1] | edges[1:-1]])
        stop = flags & np.concatenate([~flags[1:] | edges[1:-1], [True]])
        lo, hi = np.flatnonzero(start), np.flatnonzero(stop)
        owner = np.searchsorted(begin, lo, side="right") - 1
        first = rows["lo"].to_numpy()[owner] + lo - begin[owner]
        return pd.DataFrame({"block": rows["block"].to_numpy()[owner], "doc": rows["doc"].to_numpy()[owner],
                             "lo": first, "n": hi - lo + 1})

    def cut(rows: pd.DataFrame, answers: pd.DataFrame, matches: pd.DataFrame) -> pd.DataFrame:
        b = Block(rows, length, gram)
        heard = b.hear(answers, buckets)
        own = np.flatnonzero(heard == REPEAT)
        met = [(t, at, 1) for t, at, _, again in b.singles(heard) if again]
        doc, lo, n = (np.concatenate([b.runs[c][own], matches[m].to_numpy(np.int64), np.array([x[j] for x in met], np.int64)])
                      for j, (c, m) in enumerate((("text", "doc"), ("lo", "lo"), ("n", "n"))))
        order = np.lexsort((lo, doc))
        doc, lo, stop = doc[order], lo[order], (lo + n - 1 + length)[order]
        at = np.searchsorted(doc, np.arange(len(b.texts) + 1))
        out = []
        for i, (text, copies) in enumerate(zip(b.texts, b.rows["copies"])):
            a, z = lo[at[i]:at[i + 1]], np.maximum.accumulate(stop[at[i]:at[i + 1]])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]])) if len(a) else np.zeros(0, np.int64)
            a, z = a[new], z[np.append(new[1:] - 1, len(z) - 1)] if len(new) else z
            ends = np.concatenate([[0], z]), np.concatenate([a, [len(text)]])
            kept = b"".join(text[x:y] for x, y in zip(*ends))
            row = b.rows["doc_id"].iloc[i]
            out.append((row, len(text), kept, [{"start": int(x), "stop": int(y)} for x, y in zip(a, z)]))
            again = (row, len(text), b"", [{"start": 0, "stop": len(text)}]) if len(text) >= length else out[-1]
            out += [again] * (copies - 1)
        x = pd.DataFrame(out, columns=["doc_id", "n_bytes", "kept", "spans"])
        return x.assign(doc_id=x["doc_id"].astype("Int64"))

    by_block = docs.groupBy("block")
    answers = by_block.applyInPandas(tell, "bucket bigint, block bigint, anchors binary, segments binary, ids binary") \
        .groupBy("bucket").applyInPandas(judge, "block bigint, bucket bigint, verdicts binary")
    sent = by_block.cogroup(answers.groupBy("block")).applyInPandas(
        send, "bucket bigint, block bigint, doc_id bigint, doc bigint, lo bigint, n bigint, segment binary")
    matches = sent.groupBy("bucket").applyInPandas(match, "block bigint, doc bigint, lo bigint, n bigint")
    # verdicts and matches of a block come as rows of one table
    both = answers.select("block", "bucket", "verdicts", *[F.lit(None).cast("bigint").alias(c) for c in ("doc", "lo", "n")]).unionByName(
        matches.select("block", F.lit(None).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("verdicts"), "doc", "lo", "n"))

    def finish(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["doc_id", "n_bytes", "kept", "spans"])
        verdict = told["verdicts"].notna()
        return cut(rows, told[verdict], told[~verdict])

    return by_block.cogroup(both.groupBy("block")).applyInPandas(
        finish, "doc_id bigint, n_bytes bigint, kept binary, spans array<struct<start:bigint,stop:bigint>>")
