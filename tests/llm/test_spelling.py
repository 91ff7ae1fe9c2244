"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpline.llm import queries, spelling
from tests.conftest import SF


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    by_cut = {}
    for w in words:  # words one edit apart share the word or a word less one letter
        for v in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            by_cut.setdefault(v, set()).add(w)
    around = {w: sorted({u for v in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))} for u in by_cut[v] if near(w, u)}) for w in words}
    form = {}
    for w in words:
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(around[w]), words.get(form[w])))
    return sorted(out)


def found(df, **kw):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(df, **kw).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdéèÉöABX") for _ in range(rng.randint(4, 9))) for _ in range(60)]

    def vary(w):
        k, x = rng.randrange(len(w)), rng.random()
        return w if x < .85 else w[:k] + (w[k + 1:] if x < .9 else rng.choice("abcd") + w[k + (x > .95):])
    out = [(i if i % 17 else None, rng.choice([" ", ", ", "-"]).join(vary(rng.choice(base)) for _ in range(150))) for i in range(150)]
    return out + [(999, None), (998, ""), *[(997, "abcdeabcde" * 3000)] * 3, (996, "abcdeabcde" * 3000 + "x"), (995, "ties ties")]


@pytest.mark.parametrize("tile", [8192, 60])
def test_equals_all_pairs(spark, rows, tile):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(3)).withColumn("word", F.lit("x"))
    assert found(df, tile=tile) == brute(rows)


def test_ties_chains_and_empty(spark):
    text = "aaaaa " * 12 + "aaaab " * 6 + "aaabb " * 3 + "baaab " * 3 + "ccccc " * 4 + "ccccd " * 4 + "cccce " * 4
    got = {r[0]: r for r in found(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), modulus=1 << 40)}
    assert got["aaabb"][1:3] == ("aaaab", "aaaaa") and got["aaaab"][1:3] == ("aaaaa", "aaaaa") and got["aaaaa"][1:3] == (None, "aaaaa")
    assert got["ccccc"][1:3] == (None, "ccccc") and got["ccccc"][4] == 2  # equal counts are no form
    tie = "aaaaa " * 3 + "aaaac " * 9 + "aaaab " * 9
    assert found(spark.createDataFrame([(1, tie)], "doc_id bigint, text string"), modulus=1 << 40)[0][1] == "aaaab"
    assert found(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_query_on_the_smallest_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling(spark, SF).collect())
    assert got == brute(docs)
