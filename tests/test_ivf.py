"""Trained cells: recall against the exact join, on the test table and on clustered vectors."""

import numpy as np
from pyspark.sql import functions as F

from helpline.operators import ivf as I
from helpline.operators import vector as V

VEC = "item_id bigint, vector array<double>"


def recall(spark, items, cells, k=5):
    q = items.select(F.col("item_id").alias("query_id"), "vector")
    exact = V.vector_join(q, items, k, exclude_self=True).select("query_id", "item_id")
    found = I.ivf_search(q, items, cells, k, exclude_self=True).select("query_id", "item_id")
    return exact.join(found, ["query_id", "item_id"]).count() / exact.count()


def search(items, k=5):
    q = items.select(F.col("item_id").alias("query_id"), "vector")
    return I.calibrate(I.train_cells(items), q, items, k, exclude_self=True)


def test_recall_on_the_test_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    cells = search(t)
    assert recall(spark, t, cells) >= 0.9 and cells.share < 0.85  # uniform vectors: most cells are needed


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((40, 32))
    x = middle[rng.integers(0, 40, 2000)] + 0.25 * rng.standard_normal((2000, 32))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    cells = search(t)
    assert cells.share < 0.1 and recall(spark, t, cells) >= 0.9


def test_null_zero_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0]), (6, [1.0, 0.0])]
    t = spark.createDataFrame(rows, VEC)
    got = I.ivf_search(t.select(F.col("item_id").alias("query_id"), "vector"), t, I.Cells(np.eye(2), 2), 2, exclude_self=True).collect()
    best = {r.query_id: r.item_id for r in got if r.hit_rank == 1}
    assert best == {1: 6, 2: 1, 5: 2, 6: 1}
    empty = spark.createDataFrame([], VEC)
    cells = search(empty)
    assert len(cells.centroids) == 0


def test_a_round_equals_plain_k_means(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC).repartition(5)
    first = [r["item_id"] for r in t.orderBy(I.id_hash("item_id"), "item_id").limit(17).collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u[first], I.DIGITS)
    for _ in range(I.ROUNDS):
        own = np.argmax(u @ c.T, axis=1)
        m = [u[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(17)]
        c = np.round(np.array([v / np.linalg.norm(v) for v in m]), I.DIGITS)
    assert np.abs(I.train_cells(t).centroids - c).max() < 1e-5


def test_pruned_search_is_exact_and_scores_few_pairs_of_clusters(spark):
    rng = np.random.default_rng(8)
    middle = rng.standard_normal((40, 16))
    x = middle[rng.integers(0, 40, 2000)] + 0.12 * rng.standard_normal((2000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, x[0].tolist()), (2001, [0.0] * 16), (2002, None)]
    t = spark.createDataFrame(rows, VEC)
    q = t.select(F.col("item_id").alias("query_id"), "vector")
    got, share = I.pruned_search(q, t, I.train_cells(t), 5, exclude_self=True)
    known = t.where("vector is not null")
    want = V.vector_join(known.select(F.col("item_id").alias("query_id"), "vector"), known, 5, exclude_self=True)
    key = lambda df: sorted((r["query_id"], r["hit_rank"], r["item_id"]) for r in df.collect())
    assert key(got) == key(want) and share < 0.3


def test_pruned_search_keeps_everything_without_clusters(spark):
    rng = np.random.default_rng(9)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 12)))], VEC)
    q = t.select(F.col("item_id").alias("query_id"), "vector")
    for k in (3, 40):  # also more than a cell holds
        got, share = I.pruned_search(q, t, I.train_cells(t), k, exclude_self=True)
        want = V.vector_join(q, t, k, exclude_self=True)
        assert sorted(map(str, got.select("query_id", "hit_rank", "item_id").collect())) == \
            sorted(map(str, want.select("query_id", "hit_rank", "item_id").collect())) and share <= 1


def test_tasks_without_vectors(spark):
    rng = np.random.default_rng(3)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((20, 8)))], VEC).repartition(60)  # most are empty
    q = t.select(F.col("item_id").alias("query_id"), "vector")
    assert recall(spark, t, search(t)) > 0
    got, _ = I.pruned_search(q, t, I.train_cells(t), 3, exclude_self=True)
    assert got.count() == 60


def test_pruned_search_has_no_row_per_query_and_cell(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(I, "materialize", lambda df, name, f=I.materialize: rows.append(f(df, name)) or rows[-1])
    rng = np.random.default_rng(11)
    x = rng.standard_normal((300, 8))
    x[:120] = x[0] + 0.01 * x[:120]  # a cell with more than a block
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    q = t.select(F.col("item_id").alias("query_id"), "vector")
    cells = I.train_cells(t)
    want = sorted(map(str, V.vector_join(q, t, 3, exclude_self=True).select("query_id", "hit_rank", "item_id").collect()))
    for sizes in ({}, {"q_block_rows": 64, "i_block_rows": 25}):
        got, share = I.pruned_search(q, t, cells, 3, exclude_self=True, **sizes)
        assert sorted(map(str, got.select("query_id", "hit_rank", "item_id").collect())) == want and 0 < share < 1
    assert max(df.count() for df in rows) <= 3 * 300 < 300 * len(cells.centroids)
    q_with_copies, with_copies = q.unionAll(q.limit(40)), t.unionAll(t.limit(40))  # ids that come twice are one pair
    got = I.pruned_search(q_with_copies, with_copies, cells, 3, exclude_self=True)[0].collect()
    assert len({(r.query_id, r.item_id) for r in got}) == len(got)


def test_cells_are_dealt_to_blocks_in_turn():
    first, count = I._deal(np.array([3, 0, 4, 25, 2, 9, 0, 1]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 5, 0, 5] and count.tolist() == [1, 0, 1, 3, 1, 1, 0, 1]
