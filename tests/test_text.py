import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpline.operators import chunk as CH
from helpline.operators import lexical as L
from helpline.operators import match as M

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def _bm25(queries, docs, k):
    tok = {d: [t for t in re.split(r"[^\w]+", x.lower()) if t] for d, x in docs.items()}
    n = len(docs)
    avgdl = sum(len(t) for t in tok.values()) / n
    df = Counter(t for ts in tok.values() for t in set(ts))
    out = {}
    for qid, qt in queries.items():
        terms = set(t for t in re.split(r"[^\w]+", qt.lower()) if t)
        sc = []
        for d, ts in tok.items():
            tf = Counter(ts)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (L.K1 + 1)
                    / (tf[t] + L.K1 * ((1 - L.B) + L.B * len(ts) / avgdl)) for t in terms if tf[t])
            if s > 0:
                sc.append((-round(s, 9), d))
        out[qid] = [d for _, d in sorted(sc)[:k]]
    return out


@pytest.mark.parametrize("way", ["blocks of all documents", "small blocks", "large query table"])
def test_lexical_join_equals_brute_force(spark, monkeypatch, way):
    rng = np.random.default_rng(3)
    docs = {i: " ".join(rng.choice(WORDS, size=rng.integers(1, 30))) for i in range(80)}
    docs[80] = ""
    queries = {i: " ".join(rng.choice(WORDS, size=3)) for i in range(15)}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    if way == "small blocks":  # many thresholds, and a task with several blocks
        monkeypatch.setattr(L.index_blocks, "__defaults__", (40,))
        d = d.coalesce(2)
    if way == "large query table":
        monkeypatch.setattr(L.blocked_lexical_join, "__defaults__", (4, 9))
    got = L.lexical_join(q, d, k=4, max_query_terms=0 if way == "large query table" else 1000).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["hit_rank"])):
        res.setdefault(r["query_id"], []).append(r["item_id"])
    exp = {k: v for k, v in _bm25(queries, docs, 4).items() if v}
    assert res == exp


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_fuzzy_match_equals_exhaustive(spark):
    rng = np.random.default_rng(5)
    letters = list("abcdemnor")
    names = ["".join(rng.choice(letters, size=rng.integers(2, 7))) + " " + "".join(rng.choice(letters, size=3)) for _ in range(60)]
    reg = [(i, n) for i, n in enumerate(names)]
    spoken = [(100 + i, re.sub(r"^([^n]*)n", r"\1m", n)) for i, n in enumerate(names[:30])] + [(500, "zzzz qqq")]
    r = spark.createDataFrame(reg, "person_id long, full_name string")
    s = spark.createDataFrame(spoken, "query_id long, spoken string")
    got = {row["query_id"]: (row["person_id"], row["distance"]) for row in M.fuzzy_entity_match(s, r, 2).collect()}
    best_ids = {}
    for name, pid in sorted((n, i) for i, n in reg):
        best_ids.setdefault(name, pid)
    exp = {}
    for qid, sp in spoken:
        c = sorted((_lev(sp, n), pid) for n, pid in best_ids.items())
        if c and c[0][0] <= 2:
            exp[qid] = (c[0][1], c[0][0])
    assert got == exp


def test_chunks_cover_whole_text(spark):
    text = "x" * 2500
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "doc_id long, text string")
    rows = {(r["ref_doc_id"], r["chunk_no"]): r for r in CH.chunk_documents(df, 1000, 200).collect()}
    assert [(k, rows[k]["start_char"], rows[k]["end_char"]) for k in sorted(rows) if k[0] == 1] == \
        [((1, 0), 0, 1000), ((1, 1), 800, 1800), ((1, 2), 1600, 2500)]
    assert rows[(2, 0)]["text"] == "short" and rows[(3, 0)]["text"] == ""


def test_validate_client_company(spark):
    clients = spark.createDataFrame([(1, "c", "José Pérez"), (2, "c", "Ana")], "Id long, CodigoCliente string, NombreCompleto string")
    comp = spark.createDataFrame([(1, "E", "Acme"), (2, "E", "Beta")], "Id long, Codigo string, Nombre string")
    cc = spark.createDataFrame([(1, 1)], "ClienteId long, EmpresaId long")
    claims = spark.createDataFrame([("a", "jose  perez", "ACME"), ("b", "Ana", "Acme"), ("c", "Nobody", "Acme"), ("d", "Ana", "Zeta")],
                                   "claim_id string, client_name string, company_name string")
    got = {r["claim_id"]: (r["valid_strict"], r["valid_relaxed"]) for r in M.validate_client_company(claims, clients, comp, cc).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (False, False), "d": (False, False)}


def test_pluggable_answerer_runs_on_prompt_rows(spark):
    import pandas as pd
    q = spark.createDataFrame([(1, "red car"), (2, "nothing here")], "query_id long, text string")
    docs = spark.createDataFrame([(10, "a red car on a road"), (11, "blue sky")], "doc_id long, text string")
    hits = L.lexical_join(q, docs, k=1)
    prompts = M.rag_prompt(q, hits, docs)

    def model(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"query_id": p["query_id"], "status": ["ok" if n else "error" for n in p["n_hits"]],
                             "answer": [s.splitlines()[-1] for s in p["prompt"]]})
    got = {r["query_id"]: (r["status"], r["answer"]) for r in M.pandas_answerer(model)(prompts).collect()}
    assert got == {1: ("ok", "[1] 10: a red car on a road"), 2: ("error", "Context:")}


def test_lexical_join_same_with_and_without_spread(spark):
    from helpline.functions.columns import spread
    from helpline.sources.tables import read_table
    from tests.conftest import SF
    docs = read_table(spark, SF, "documents", ["doc_id", "text"])
    q = read_table(spark, SF, "benchmark", ["item_id", "text"]).withColumnRenamed("item_id", "query_id")
    a = {tuple(r) for r in L.lexical_join(q, docs, k=3).select("query_id", "item_id", "hit_rank").collect()}
    b = {tuple(r) for r in L.lexical_join(q, spread(docs, "doc_id").repartition(5), k=3)
         .select("query_id", "item_id", "hit_rank").collect()}
    assert a == b and len(a) > 0


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    docs = [(i, "rare common" if i == 0 else "common filler words") for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(1, "rare common"), (2, None), (3, "!"), (None, "common")], "query_id long, text string")
    monkeypatch.setattr(L.index_blocks, "__defaults__", (9,))
    calls = spark.sparkContext.accumulator(0)
    plain = L.top_k_rows
    monkeypatch.setattr(L, "top_k_rows", lambda *a: calls.add(1) or plain(*a))
    got = [(r["query_id"], r["item_id"]) for r in L.lexical_join(q, d, k=1).collect()]
    assert got == [(1, 0)] and calls.value == 1 < 60 // 3  # the first block holds the best score any other could reach


def _ranked(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["hit_rank"])):
        out.setdefault(r["query_id"], []).append(r["item_id"])
    return out


def test_large_query_table_meets_the_documents_once(spark):
    """Batches of queries share the blocks: no document is copied or tokenised a second time."""
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice(WORDS, size=rng.integers(1, 30)))) for i in range(80)]
    asked = [(i // 2, " ".join(rng.choice(WORDS, size=3))) for i in range(30)]  # every id twice
    read = spark.sparkContext.accumulator(0)
    told = F.udf(lambda t: read.add(1) or t, "string").asNondeterministic()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("text", told("text"))
    q = spark.createDataFrame([*asked, (None, "alpha"), (99, None), (98, "?")], "query_id long, text string")
    large = L.lexical_join(q, d, k=3, max_query_terms=40)  # three batches
    got = _ranked(large)
    assert read.value == len(docs)
    assert "CoGroup" not in large._jdf.queryExecution().toString()
    assert got == _ranked(L.lexical_join(q, d, k=3)) and set(got) == set(range(15))


@pytest.mark.parametrize("dense", [1, 10 ** 9])
def test_equal_documents_are_scored_once_in_bounded_tiles(spark, monkeypatch, dense):
    """Terms by matrix product or by postings; a block keeps the k smallest ids of documents
    that no query tells apart and counts all of them, and a task scores few at once."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(WORDS, size=rng.integers(1, 6))) for _ in range(12)]
    docs = {int(i): texts[j % 12] + f" other{i}" for j, i in enumerate(rng.permutation(240))}
    queries = {i: " ".join(rng.choice(WORDS, size=4)) for i in range(25)}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    monkeypatch.setattr(L, "DENSE", dense)
    monkeypatch.setattr(L.score_blocks, "__defaults__", (*L.score_blocks.__defaults__[:-1], 200))
    cells = spark.sparkContext.accumulator(0)
    wide = spark.sparkContext.accumulator(0)
    plain = L.top_k_rows
    monkeypatch.setattr(L, "top_k_rows", lambda s, *a: (cells.add(s.size), wide.add(int(s.size > 200))) and plain(s, *a))
    assert _ranked(L.lexical_join(q, d, k=4)) == {k: v for k, v in _bm25(queries, docs, 4).items() if v}
    assert wide.value == 0 and cells.value <= 25 * 4 * 12 < 25 * 240
    terms = spark.sparkContext.broadcast({w: i for i, w in enumerate(WORDS)})
    blocks = L.index_blocks(d.withColumnRenamed("doc_id", "item_id"), terms, "bigint", 4).collect()
    held = Counter(w for t in docs.values() for w in set(t.split()) & set(WORDS))
    assert sum(b["n"] for b in blocks) == 240 and sum(len(b["ids"]) for b in blocks) <= 4 * 12
    assert {WORDS[c]: h for b in blocks for c, h in zip(b["code"], b["held"])} == held


def test_protocols_below_the_threshold_are_not_scored(spark, monkeypatch):
    issues = spark.createDataFrame([(1, "printer broken"), (2, "hello the"), (3, "")], "call_id long, text string")
    pages = spark.createDataFrame([(i, "the printer manual" if i == 7 else "the hello page") for i in range(40)], "entity_id long, body string").coalesce(1)
    tries = spark.sparkContext.accumulator(0)
    plain = L.top_k_rows
    monkeypatch.setattr(L, "top_k_rows", lambda s, *a: tries.add(len(s)) or plain(s, *a))
    got = {r["call_id"]: (r["protocol_id"], r["verdict"]) for r in M.protocol_match(issues, pages, 1.0).collect()}
    assert got == {1: (7, M.VERIFIED), 2: (None, M.NO_SOLUTION), 3: (None, M.NO_SOLUTION)}
    assert tries.value == 1


def test_embedding_time_grows_with_the_texts_not_with_their_words(spark):
    """Texts that share no words: the cost of one does not depend on the words of those before."""
    import time

    from helpline.operators.embed import bucket_of, fit_corpus, token_embedder
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), i.cast("string"))), " ")
    texts = spark.range(0, 8000, 1, 1).select("id", own.alias("text"))
    begun = time.perf_counter()
    texts_done = token_embedder(64)(texts).agg(F.sum(F.size("embedding")).alias("n")).first()["n"]
    assert texts_done == 8000 * 64 and time.perf_counter() - begun < 15
    few = spark.createDataFrame([(1, " Ana, ana y B\u00e9a! "), (2, None), (3, "?!"), (4, "")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in token_embedder(16)(few).collect()}
    want = np.zeros(16)
    for w in ("ana", "ana", "y", "b\u00e9a"):
        want[bucket_of(w, 16)] += 1
    assert np.allclose(got[1], want / np.linalg.norm(want)) and not any(got[2] + got[3] + got[4])
    model = fit_corpus(few.repartition(9), dim=16)  # some tasks without texts
    assert model.n_docs == 4 and list(model.held) == [int(x > 0) for x in want]
