"""Repeated byte strings: against a set of all windows seen before, and the longest previous factors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpline.llm import queries, repeats
from tests.conftest import SF


def rows_of(seed=5):
    """Shared passages, exact copies, a null id, null, empty and short texts, runs, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(100):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))))
            p = rng.choice(passages)
            parts.append(p[rng.randint(0, 60):len(p) - rng.randint(0, 60)])
        rows.append((i, " ".join(parts)))
    return rows + [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, " " * 700), (505, "ab" * 400),
                   (None, rows[4][1]), (506, "x" * 99), (507, "x" * 100), (508, "x" * 101), (509, "Ä\U0001f600" * 90)]


def brute(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            gone[p:p + length] |= w in seen
            seen.add(w)
        lo, hi = repeats.spans_of(gone)
        out.append((i, len(data), bytes(np.frombuffer(data, np.uint8)[~gone]), list(zip(lo.tolist(), hi.tolist()))))
    return out


def found(df, **kw):
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans]) for r in repeats.remove_repeats(df, **kw).collect()]
    return sorted(got, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("kw", [{}, {"block": 3000, "bucket": 2000}, {"block": 3000, "bucket": 2000, "hot": 1},
                                {"length": 40, "gram": 12, "block": 9000, "bucket": 500, "hot": 3}])
def test_equals_brute_force(spark, kw):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("block", F.lit("x")).withColumn("n", F.lit(1))
    assert found(df, **kw) == brute(rows, kw.get("length", 100))


def test_repeated_rows_and_empty_table(spark):
    a, b = "the first of these texts " * 3 + "ends", "z" + "0123456789" * 12
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (1, b), (2, b[5:])] * 2, "doc_id bigint, text string")
    got = found(df)
    assert [g[2] for g in got if g[1] == len(a)] == [a.encode()] * 4  # shorter than 100 bytes: all stay
    assert sorted(g[2] for g in got if g[1] == len(b)) == [b""] * 3 + [brute([(1, b)], 100)[0][2]]
    assert [g[2] for g in got if g[0] == 2] == [b""] * 2
    assert found(df.limit(0)) == []


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, text), (2, text[7_000:9_000] + "!" + text[20_000:]), (3, text[:99] + "?" + text[:150])]
    want = brute(rows, 100)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df) == want
    whole = repeats.runs([r[1].encode() for r in rows], 100, 32)
    parts = repeats.runs([r[1].encode() for r in rows], 100, 32, piece=1000)
    assert whole["n"].sum() == parts["n"].sum() == sum(len(t) - 99 for _, t in rows)
    assert set(whole["anchor"]) == set(parts["anchor"])


def test_windows_are_those_with_a_long_previous_factor():
    """Sorted suffixes, previous and next smaller positions, longest common prefixes: by definition."""
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(300))
    length = 9
    order = sorted(range(len(data)), key=lambda p: data[p:])
    common = lambda p, q: next((k for k in range(len(data)) if p + k >= len(data) or q + k >= len(data) or data[p + k] != data[q + k]), 0)
    lpf = {}
    for at, p in enumerate(order):
        before = next((q for q in reversed(order[:at]) if q < p), None)
        after = next((q for q in order[at + 1:] if q < p), None)
        lpf[p] = max([common(p, q) for q in (before, after) if q is not None], default=0)
    flags = repeats.earlier_matches([data], np.array([len(data) - length + 1]), length)
    assert flags.tolist() == [lpf[p] >= length for p in range(len(data) - length + 1)]


def test_ranks_order_strings():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 500).astype(np.uint8)
    for length in (9, 16, 33, 100):
        at = np.arange(len(data) - length)
        rank = repeats.ranks(data, at, length)
        strings = [bytes(data[p:p + length]) for p in at]
        place = {s: k for k, s in enumerate(sorted(set(strings)))}
        assert rank.tolist() == [place[s] for s in strings]


def test_query_on_the_smallest_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, sum(z - a for a, z in s), len(s)) for i, n, _, s in brute(docs, 100)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in queries.op12_repeats(spark, SF).collect()} == want
