import numpy as np
import pytest
from pyspark.sql import functions as F

from helpline.operators import vector as V


def _brute(q, items, k, exclude_self):
    out = {}
    for qi, qv in q.items():
        sc = []
        for ii, iv in items.items():
            if exclude_self and qi == ii:
                continue
            s = float(np.dot(qv, iv) / (np.linalg.norm(qv) * np.linalg.norm(iv)))
            sc.append((-round(s, 9), ii))
        out[qi] = [ii for _, ii in sorted(sc)[:k]]
    return out


@pytest.mark.parametrize("qb,ib", [(1024, 8192), (7, 13)])
def test_blocked_equals_brute_force_with_ties(spark, qb, ib):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(60, 8)).astype(np.float32)
    vecs[10] = vecs[3]  # exact duplicates -> tied scores, broken by id
    vecs[11] = vecs[3]
    items = {i: vecs[i].astype(np.float64) for i in range(60)}
    df = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(60)], "item_id long, vector array<float>")
    q = df.withColumnRenamed("item_id", "query_id")
    got = V.vector_join(q, df, k=4, exclude_self=True, q_block_rows=qb, i_block_rows=ib).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["hit_rank"])):
        res.setdefault(r["query_id"], []).append(r["item_id"])
    assert res == _brute(items, items, 4, True)


def test_effective_top_k(spark):
    df = spark.createDataFrame([(None,), (0,), (-1,), (3,)], "k int")
    assert [r[0] for r in df.select(V.effective_top_k("k")).collect()] == [5, 5, 5, 3]


def test_search_per_query_k_and_repartition_invariance(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(40, 6)).astype(np.float32)
    items = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(40)], "item_id long, vector array<float>")
    req = spark.createDataFrame([(i, vecs[i].tolist(), [None, 0, 2, 7][i % 4]) for i in range(40)],
                                "query_id long, vector array<float>, top_k int")
    a = sorted(tuple(r) for r in V.search(req, items).select("query_id", "item_id", "hit_rank").collect())
    b = sorted(tuple(r) for r in V.search(req.repartition(7), items.repartition(3)).select("query_id", "item_id", "hit_rank").collect())
    assert a == b
    counts = {}
    for qid, _, _ in a:
        counts[qid] = counts.get(qid, 0) + 1
    assert counts[0] == 5 and counts[1] == 5 and counts[2] == 2 and counts[3] == 7


def test_global_top_k_and_centroid(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "item_id long, vector array<float>")
    c = V.centroid(df)
    assert np.allclose(c, [2 / 3, 2 / 3])
    assert [r["item_id"] for r in V.global_top_k(df, c, 2).collect()] == [3, 1]


@pytest.mark.parametrize("qb,ib", [(1024, 8192), (3, 5)])
def test_approx_search_equals_brute_force_over_shared_buckets(spark, qb, ib):
    """Exact best-k among the items sharing a bucket, also when a bucket holds
    most rows (here: near-copies of one vector) and is cut into tiny blocks."""
    rng = np.random.default_rng(11)
    vecs = rng.normal(size=(50, 6)).astype(np.float32)
    vecs[:30] = vecs[0] + rng.normal(scale=1e-3, size=(30, 6)).astype(np.float32)  # hot bucket
    n_bands, n_bits = 3, 2
    h = V.hyperplanes(6, n_bands * n_bits, 5)
    bits = (vecs.astype(np.float64) @ h.T > 0).reshape(50, n_bands, n_bits)
    keys = (bits * (1 << np.arange(n_bits))).sum(axis=2)
    items = {i: vecs[i].astype(np.float64) for i in range(50)}
    df = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(50)], "item_id long, vector array<float>")
    q = df.withColumnRenamed("item_id", "query_id")
    got = V.approx_search(q, df, k=4, exclude_self=True, n_bands=n_bands, n_bits=n_bits, seed=5,
                          q_block_rows=qb, i_block_rows=ib).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["hit_rank"])):
        res.setdefault(r["query_id"], []).append(r["item_id"])
    for qi in range(50):
        cand = {j: items[j] for j in range(50) if (keys[j] == keys[qi]).any()}
        want = _brute({qi: items[qi]}, cand, 4, True)[qi]
        assert res.get(qi, []) == want


def test_approx_search_recall(spark):
    from helpline.sources.tables import read_table
    from tests.conftest import SF
    it = read_table(spark, SF, "embeddings", ["vec_id", "embedding"]).select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    q = it.select(F.col("item_id").alias("query_id"), "vector")
    a = V.approx_search(q, it, k=5, exclude_self=True).select("query_id", "item_id")
    x = V.vector_join(q, it, k=5, exclude_self=True).select("query_id", "item_id")
    assert a.join(x, ["query_id", "item_id"]).count() / x.count() > 0.6


def test_index_stats_single_aggregate(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in [42, 7, 19, 3, 88]], "item_id long, vector array<float>")
    r = V.index_stats(df.repartition(3)).collect()
    assert [(x["n_items"], x["sample_ids"]) for x in r] == [(5, "3, 7, 19")]


def _plain(qm, qids, im, iids, k, own):
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (qm @ im.T) / np.outer(np.linalg.norm(qm, axis=1), np.linalg.norm(im, axis=1))
    out = []
    for i, q in enumerate(qids):
        hits = [(-round(s[i, j], 9), iids[j]) for j in range(len(iids)) if np.isfinite(s[i, j]) and iids[j] != q]
        out += [(q, x) for _, x in sorted(hits)[:own[i]]]
    return out


@pytest.mark.parametrize("text", [False, True])
def test_kernel_of_many_tiles_equals_brute_force(text):
    """More rows than a tile, copies past what is scored singly, zero and NaN vectors, own k."""
    import pandas as pd

    from helpline.operators.blocks import cosine_kernel
    rng = np.random.default_rng(4)
    m = rng.normal(size=(1800, 6)).astype(np.float32)
    m[100:400] = m[7]
    m[500:503], m[600:602] = 0, np.nan
    ids = rng.permutation(1800)
    ids = [f"n{i}" for i in ids] if text else ids.tolist()
    own = [1 + i % 4 for i in range(1800)]
    q = pd.DataFrame({"query_id": ids, "vector": list(m), "k": own})
    got = cosine_kernel(True)(q, pd.DataFrame({"item_id": ids, "vector": list(m)}), 4)
    d = m.astype(np.float64)
    some = list(range(0, 1800, 9)) + [7, 100, 399, 500, 600]
    want = _plain(d[some], [ids[i] for i in some], d, ids, 4, [own[i] for i in some])
    asked = {ids[i] for i in some}
    assert sorted((a, b) for a, b in zip(got["query_id"], got["item_id"]) if a in asked) == sorted(set(want))
    none = cosine_kernel()(q.iloc[:0], pd.DataFrame({"item_id": ids[:0], "vector": []}), 4)
    assert len(none) == 0


def test_copies_grow_with_the_rows_not_with_their_square():
    from helpline.operators.blocks import block_counts
    moved = {n: sum(b * n for b in block_counts(n, n, 65_536, 48)) for n in (10_000, 100_000, 400_000)}
    assert moved[100_000] == 10 * moved[10_000] and moved[400_000] == 4 * moved[100_000]
    assert block_counts(600_000, 600_000, 65_536, 48) == (10, 10)
    assert block_counts(200, 5_000_000, 16_384, 48)[0] == 1 and block_counts(0, 0, 10, 48) == (1, 1)
