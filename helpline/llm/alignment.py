"""Alignment of the tokens of two tokenizers over one text, with corpus-wide pair counts.

Texts are deduplicated exactly: they are shuffled by the full text, and each distinct
text is tokenised and aligned once, in blocks of bounded size. A (byte-level BPE) reads a
space and the text, B (pieces with byte fallback) the text, to which it adds the space.
Both cut the same bytes, so the union of their cuts gives one link for every pair of
tokens that overlap, and their common cuts the groups.

A block tells each of its distinct id pairs once, with the number of documents (copies
included) that hold it; a grouping with partial aggregation adds them up, so a frequent
pair is one row per block. Totals go back to the blocks by a join, where each text adds
up its links from packed pair lists; the measures are joined to the ids of all documents
by a hash of the text. The highest count of an A id is a table as small as A's
vocabulary, the only one broadcast.

Edge cases: null and empty texts, and those whose joined B bytes differ from the space
and the text (B turns U+2581 into a space), have no tokens, zeros and '' as groups; A
cuts bytes without change, so its joined bytes never differ. Strings of special tokens
are plain text. Repeated rows and null ids give one row each; ties for an A id's highest
count all count; an empty table gives no rows; extra columns are ignored. A text is
tokenised in one task; long runs without a word boundary are met by ``bpe.Coder``.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpline.llm import bpe
from helpline.llm.common import id_and_text
from helpline.session import materialize

BLOCK = 8 << 20       # bytes of text in a block
PART = 1 << 20        # bytes of text aligned at a time
B_BITS = 16           # low bits of a pair's code hold B's id


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters are their own byte, the
    other bytes are numbered from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE tokenizer file. Merges must make ids in rising order, so
    that an id is a rank; added tokens, which come after them, are not plain text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ids = [vocab[a + b] for a, b in pairs]
    if ids != sorted(ids):
        raise ValueError("the merges of this file do not make ids in rising order")
    alphabet = byte_alphabet()
    return {bytes(alphabet[c] for c in k): v for k, v in vocab.items()}


class Tokenizers:
    """Both encoders of one worker, and the bytes and lengths of their tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        import sentencepiece
        self.a = bpe.Coder(ranks, pattern)
        self.a_size = np.zeros(1 + max(ranks.values()), np.int64)
        self.a_size[list(ranks.values())] = [len(t) for t in ranks]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else
                                b"" if self.b.is_control(i) else piece.replace("▁", " ").encode())
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        # ids as text with what follows them: , inside a group, | or ; at its end
        self.text = np.array([f"{i}{end}" for n, last in ((len(self.a_size), "|"), (len(self.b_bytes), ";"))
                              for end in (",", last) for i in range(n)], "S7")
        self.chars = np.char.str_len(self.text)

    def encode(self, texts: list[str]):
        """Ids of both (no tokens where B's bytes differ), and their numbers by text."""
        a, b = [], []
        for text, ids in zip(texts, self.b.encode(texts, num_threads=1)):
            same = text != "" and b"".join(map(self.b_bytes.__getitem__, ids)) == b" " + text.encode()
            a.append(np.frombuffer(self.a.encode(" " + text), "<u4").astype(np.int64) if same else np.zeros(0, np.int64))
            b.append(np.array(ids if same else [], np.int64))
        return np.concatenate(a), np.concatenate(b), np.array([len(x) for x in a]), np.array([len(x) for x in b])

    def align(self, texts: list[str]) -> dict:
        """Per text: numbers, groups as text; over all: links as (text number, pair code)."""
        a, b, n_a, n_b = self.encode(texts)
        text_a, text_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        b_at, a_at = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
        last_a = end_b[b_at] == end_a if len(a) else np.zeros(0, bool)
        last_b = end_a[a_at] == end_b if len(b) else np.zeros(0, bool)
        # a link ends at each cut of either: those of B with the A token there, and those of A alone
        alone = np.flatnonzero(~last_a)
        links = np.concatenate([text_b, text_a[alone]]), np.concatenate([(a[a_at] << B_BITS) | b, (a[alone] << B_BITS) | b[b_at[alone]]])
        # ids of a group of A come before those of B: shift each by the other side's ids before it
        out = np.empty(len(a) + len(b), np.int64)
        groups_a, groups_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        b_before, a_before = np.append(0, np.flatnonzero(last_b) + 1), np.append(0, np.flatnonzero(last_a) + 1)
        n = len(self.a_size)
        out[np.arange(len(a)) + b_before[groups_a]] = a + n * last_a
        out[np.arange(len(b)) + a_before[groups_b + 1]] = b + 2 * n + len(self.b_bytes) * last_b
        told = self.text[out].tobytes().translate(None, b"\0")
        stop = np.concatenate([[0], np.cumsum(self.chars[out])])[np.cumsum(n_a + n_b)] if len(texts) else []
        groups, at = [], 0
        for z in stop:
            groups.append(told[at:max(at, z - 1)])  # without the last ;
            at = z
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(text_b[last_b], minlength=len(texts)),
                "n_links": np.bincount(links[0], minlength=len(texts)), "groups": groups, "links": links}


def packed(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte plane by byte plane (most are small)."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


BLOCK_SCHEMA = ("texts array<struct<key:string,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups:string>>, "
                "codes binary, copies binary, sizes binary, gaps binary, times binary")


class Aligner:
    """Two tokenizers: a byte-level BPE file, its split pattern, and a piece model. Both
    files have a fixed size (about 1 MB each) and are broadcast once."""

    def __init__(self, spark: SparkSession, a_path: str, pattern: str, b_path: str, block: int = BLOCK):
        with open(b_path, "rb") as f:
            model = f.read()
        self.files = spark.sparkContext.broadcast((read_ranks(a_path), pattern, model))
        self.block = block

    def blocks(self, texts: DataFrame, digest: bool = True) -> DataFrame:
        """Aligned blocks of distinct ``(text, n)``: measures by text, each distinct pair
        code with its documents, and by text the places of its pairs among those codes."""
        files, size = self.files, self.block

        def finish(tools: Tokenizers, texts: list[str], copies: list[int]) -> dict:
            rows, found, at, held, part = [], [], 0, 0, []
            for i, t in enumerate(texts):
                part.append(t)
                held += len(t)
                if held < PART and i + 1 < len(texts):
                    continue
                x = tools.align(part)
                sha = lambda s: hashlib.sha256(s).hexdigest() if s and digest else s.decode()
                rows += [{"key": hashlib.sha256(t.encode()).hexdigest(), **{c: int(x[c][k]) for c in ("n_a", "n_b", "n_groups", "n_links")},
                          "groups": sha(x["groups"][k])} for k, t in enumerate(part)]
                key, times = np.unique((x["links"][0] << 32) | x["links"][1], return_counts=True)
                found.append((at + (key >> 32), key & 0xFFFFFFFF, times))
                at, held, part = at + len(part), 0, []
            text, code, times = (np.concatenate(c) for c in zip(*found))
            codes, place = np.unique(code, return_inverse=True)
            first = np.ones(len(text), bool)
            first[1:] = text[1:] != text[:-1]
            gaps = np.where(first, place, np.diff(place, prepend=0))
            return {"texts": rows, "codes": packed(codes), "sizes": packed(np.bincount(text, minlength=len(texts))),
                    "copies": np.bincount(place, np.array(copies, np.float64)[text], len(codes)).astype("<i8").tobytes(),
                    "gaps": packed(gaps), "times": packed(times)}

        def run(batches):
            tools, texts, copies, held = Tokenizers(*files.value), [], [], 0
            for b in batches:
                for t, n in zip(b["text"], b["n"]):
                    texts.append(t)
                    copies.append(n)
                    held += len(t)
                    if held >= size:
                        yield pd.DataFrame([finish(tools, texts, copies)])
                        texts, copies, held = [], [], 0
            if texts:
                yield pd.DataFrame([finish(tools, texts, copies)])
        return texts.mapInPandas(run, BLOCK_SCHEMA)

    def align(self, docs: DataFrame, digest: bool = True) -> DataFrame:
        """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``; ``digest``
        turns the groups into their sha256."""
        docs = id_and_text(docs)
        texts = docs.groupBy("text").agg(F.count("*").alias("n"))
        blocks = materialize(self.blocks(texts, digest).withColumn("block", F.monotonically_increasing_id()), "alignment")

        def tell(batches):
            for b in batches:
                for number, codes, copies in zip(b["block"], b["codes"], b["copies"]):
                    yield pd.DataFrame({"block": number, "code": unpacked(codes), "n": np.frombuffer(copies, "<i8")})

        def measure(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
            r, totals = rows.iloc[0], totals.sort_values("code")
            count, best = totals["n"].to_numpy(), totals["best"].to_numpy()
            sizes, gaps, times = (unpacked(r[c]) for c in ("sizes", "gaps", "times"))
            text, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            run = np.cumsum(gaps)
            place = run - (run - gaps)[begin[text]] if len(gaps) else gaps  # gaps start anew with each text
            out = pd.DataFrame(list(r["texts"]))
            add = lambda v: np.diff(np.concatenate([[0], np.cumsum(v * times)])[np.append(begin, len(times))])
            return out.assign(count_sum=add(count[place]), n_best=add(best[place].astype(np.int64)))

        told = blocks.select("block", "codes", "copies").mapInPandas(tell, "block bigint, code bigint, n bigint")
        totals = told.groupBy("code").agg(F.sum("n").alias("n"))
        totals = materialize(totals.withColumn("a", F.shiftright("code", B_BITS)), "alignment-pairs")
        top = totals.groupBy("a").agg(F.max("n").alias("most"))  # at most A's vocabulary
        totals = totals.join(F.broadcast(top), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
        back = told.select("block", "code").join(totals, "code")
        names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        measures = blocks.drop("codes", "copies").groupBy("block").cogroup(back.groupBy("block")).applyInPandas(
            measure, "key string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")
        return docs.select("doc_id", F.sha2("text", 256).alias("key")).join(measures.select(*names), "key").drop("key")
