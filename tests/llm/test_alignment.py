"""Token alignment against the two libraries and all pairs of overlapping tokens."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from helpline.llm import alignment
from tests.conftest import SF

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = ["a rose is a rose", "a rose is a rose", None, "", "Straße naïve <|endoftext|> ▁ odd", "x <|endoftext|> <s> </s> <0x41>",
         "  two  spaces\n\ttab  ", "日本語 \U0001f600 ok", "a" * 33, "null\x00char", "ﬁ ligature é é", " ", "\n", "don't we'll 12345 3.14"]


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet, out = alignment.byte_alphabet(), []
    for i, text in rows:
        full, text = (" " + (text or "")).encode(), text or ""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text)
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if b"".join(bytes_a) != full or b"".join(bytes_b) != full:
            out.append((i, 0, 0, [], ""))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
        links = [(x, y) for x, e, s in zip(ids_a, ends_a, [0, *ends_a]) for y, f, t in zip(ids_b, ends_b, [0, *ends_b]) if max(s, t) < min(e, f)]
        groups, start = [], 0
        for stop in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, ends) if start < e <= stop) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
            start = stop
        out.append((i, len(ids_a), len(ids_b), links, ";".join(groups)))
    held = Counter(p for r in out for p in set(r[3]))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(i, n, m, len(g.split(";")) if g else 0, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "", g) for i, n, m, links, g in out]


def found(df, digest=True, **kw):
    al = alignment.Aligner(df.sparkSession, A, public_tokenizers.PATTERN, B, **kw)
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)
                   for r in al.align(df, digest=digest).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.fixture(scope="module")
def rows(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()
    return list(enumerate(TEXTS)) + [(None, "a rose is red"), (5, "x"), (5, "x")] + [(100 + r.doc_id, r.text[:600]) for r in some]


@pytest.mark.parametrize("block", [1 << 24, 3000])
def test_equals_brute_force(spark, rows, block):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(3)).withColumn("block", F.lit("b"))
    want = sorted((r[:8] for r in brute(rows)), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    assert found(df, block=block) == want


def test_groups_as_text_copies_and_empty(spark):
    rows = [(1, "a rose"), (2, "a rose"), (3, "a nose"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r[7] for r in found(df, digest=False)] == [r[8] for r in brute(rows)]
    assert found(df.limit(0)) == [] and found(df.where("doc_id = 4")) == [(4, 0, 0, 0, 0, 0, 0, "")]


def test_long_text_and_long_run(spark):
    rows = [(1, "word " * 20_000 + " " * 5_000 + "end"), (2, "x" * 20_000)]
    assert sorted(r[1:4] + r[7:8] for r in found(spark.createDataFrame(rows, "doc_id bigint, text string"))) == sorted(
        r[1:4] + r[7:8] for r in quick(rows))


def quick(rows):
    """Groups by sets of cuts only (for texts too long for all pairs)."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    for i, text in rows:
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ends = lambda ids, piece: np.cumsum([len(piece(k)) for k in ids])
        p, q = ends(x, a.id_to_token), ends(y, lambda k: b.id_to_piece(k))  # ASCII: a character a byte
        cuts = np.intersect1d(p, q)
        told = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in zip(
            np.split(x, np.searchsorted(p, cuts, "right")), np.split(y, np.searchsorted(q, cuts, "right"))) if len(g))
        yield i, len(x), len(y), len(cuts), None, None, None, hashlib.sha256(told.encode()).hexdigest()


def test_packed_numbers_and_vocabulary():
    for values in ([], [0, 1, 255, 256, 1 << 20, (1 << 32) - 1]):
        assert alignment.unpacked(alignment.packed(np.array(values, np.int64))).tolist() == values
    ranks = alignment.read_ranks(A)
    assert len(ranks) == 50_256 and sorted(ranks.values()) == list(range(50_256))
