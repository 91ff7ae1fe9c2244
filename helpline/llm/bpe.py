"""Byte-level BPE encoding and decoding by a public rank file.

Method: overlapping chunk encoding. A text longer than one chunk is cut into
overlapping chunks that are pre-tokenised in parallel; neighbouring chunks are
stitched at a pre-token boundary both report inside their overlap (the split
pattern looks only to the right, so from a common boundary on both agree); the
pieces between the stitches are encoded in parallel and their ids concatenated.
Where an overlap holds no common boundary (one pre-token longer than the
overlap) the chunks are joined and scanned as one piece. A text of one chunk is
encoded where it is read, without a shuffle. Decoding concatenates raw bytes.

Edge cases: a null or empty text has no ids and decodes to no bytes; repeated
rows and null ids give one output row each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpline.llm.common import id_and_text
from helpline.session import materialize

CHUNK = 32_768      # code points a chunk starts after the one before
OVERLAP = 1_024     # code points two neighbouring chunks share
BLANKS = 10_000     # white space in a row from which a text is split here


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a ``.tiktoken`` file (base64 and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Coder:
    """Split pattern and encoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken
        self.find, self.blanks = regex.compile(pattern), regex.compile(rf"\s{{{BLANKS},}}+")
        self.piece = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids of a piece that begins and ends at pre-token boundaries. The encoder's own
        split recurses over white space and fails at about a million; texts with long runs
        of it are split here and encoded match by match."""
        if len(text) > BLANKS and self.blanks.search(text):
            ids = [i for m in self.find.finditer(text) for i in self.piece._encode_single_piece(m[0])]
        else:
            ids = self.piece.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()

    def ends(self, text: str) -> list[int]:
        return [m.end() for m in self.find.finditer(text)]


class LazyCoder:
    """Builds its coder once per task, not once per group."""

    def __init__(self, ranks, pattern: str):
        self.ranks, self.pattern, self.coder = ranks, pattern, None

    def get(self) -> Coder:
        if self.coder is None:
            self.coder = Coder(self.ranks.value, self.pattern)
        return self.coder


class Bpe:
    """Encoder and decoder for one rank file. The ranks (a file of fixed size,
    about 1 MB) are broadcast once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap <= chunk:
            raise ValueError("the overlap must be positive and at most one chunk")
        self.pattern, self.chunk, self.overlap = pattern, chunk, overlap
        self.ranks = spark.sparkContext.broadcast(read_ranks(path))

    def encode(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, ids)``: ids as packed little-endian unsigned 32-bit integers."""
        docs = id_and_text(docs)
        return self._short(docs.where(F.length("text") <= self.chunk)).unionByName(
            self._long(docs.where(F.length("text") > self.chunk)))

    def _short(self, docs: DataFrame) -> DataFrame:
        lazy = LazyCoder(self.ranks, self.pattern)

        def run(batches):
            coder = lazy.get()
            for b in batches:
                for at in range(0, len(b), 512):
                    part = b.iloc[at:at + 512]
                    yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"),
                                        "ids": [coder.encode(t) for t in part["text"]]})
        return docs.mapInPandas(run, "doc_id bigint, ids binary")

    def _long(self, docs: DataFrame) -> DataFrame:
        step, overlap, lazy = self.chunk, self.overlap, LazyCoder(self.ranks, self.pattern)

        def cut(batches):
            for b in batches:
                for uid, text in zip(b["uid"], b["text"]):
                    for k, start in enumerate(range(0, max(1, len(text)), step)):
                        yield pd.DataFrame({"uid": [uid], "k": [k], "start": [start], "chars": [len(text)],
                                            "chunk": [text[start:start + step + overlap]]})

        def bounds(batches):
            """Boundaries in the overlap with the chunk before and the chunk
            after. Those near a cut end of the chunk are not told: a pre-token
            that reaches the cut could go on, so only ends before the last two
            pre-tokens are sure."""
            coder = lazy.get()
            for b in batches:
                heads, tails = [], []
                for k, start, chars, t in zip(b["k"], b["start"], b["chars"], b["chunk"]):
                    ends = coder.ends(t)
                    sure = ends if start + len(t) >= chars else ends[:-2]
                    heads.append([start + e for e in sure if e <= overlap] if k else [])
                    tails.append([start + e for e in sure if step <= e <= step + overlap])
                yield b.assign(head=heads, tail=tails)

        def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("k")
            rows, lead = [], 0
            begin = 0
            for i in range(len(pdf)):
                r = pdf.iloc[i]
                stop = int(r["chars"])
                meet = None
                if i + 1 < len(pdf):
                    nxt = pdf.iloc[i + 1]
                    common = set(r["tail"]) & set(nxt["head"])
                    common = {c for c in common if c > begin}
                    meet = min(common) if common else None
                    stop = meet if meet is not None else int(nxt["start"])
                rows.append((r["uid"], r["k"], lead, begin, stop))
                begin = stop
                if meet is not None:
                    lead = int(r["k"]) + 1
            return pd.DataFrame(rows, columns=["uid", "k", "lead", "lo", "hi"])

        def encode_piece(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("k")
            text = "".join(c[lo - s:hi - s] for c, s, lo, hi in zip(pdf["chunk"], pdf["start"], pdf["lo"], pdf["hi"]))
            return pd.DataFrame({"uid": [pdf["uid"].iloc[0]], "lead": [pdf["lead"].iloc[0]],
                                 "ids": [lazy.get().encode(text)]})

        def concat(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"uid": [pdf["uid"].iloc[0]], "ids": [b"".join(pdf.sort_values("lead")["ids"])]})

        docs = materialize(docs.withColumn("uid", F.monotonically_increasing_id()), "bpe-long")
        chunks = docs.select("uid", "text").mapInPandas(cut, "uid bigint, k int, start bigint, chars bigint, chunk string")
        chunks = chunks.repartition("uid", "k").mapInPandas(
            bounds, "uid bigint, k int, start bigint, chars bigint, chunk string, head array<bigint>, tail array<bigint>")
        chunks = materialize(chunks, "bpe-chunks")
        cuts = chunks.drop("chunk").groupBy("uid").applyInPandas(stitch, "uid bigint, k int, lead int, lo bigint, hi bigint")
        pieces = chunks.select("uid", "k", "start", "chunk").join(cuts, ["uid", "k"]).groupBy("uid", "lead").applyInPandas(
            encode_piece, "uid bigint, lead int, ids binary")
        ids = pieces.groupBy("uid").applyInPandas(concat, "uid bigint, ids binary")
        return docs.select("uid", "doc_id").join(ids, "uid").select("doc_id", "ids")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """``(doc_id, ids, decoded)``: the tokens' raw bytes, concatenated."""
        ranks = self.ranks

        def run(batches):
            table = [b""] * (1 + max(ranks.value.values()))
            for token, rank in ranks.value.items():
                table[rank] = token
            for b in batches:
                for at in range(0, len(b), 512):
                    part = b.iloc[at:at + 512]
                    yield part.assign(doc_id=part["doc_id"].astype("Int64"), decoded=[
                        b"".join([table[i] for i in array("I", x)]) for x in part["ids"]])
        return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, ids binary, decoded binary")
