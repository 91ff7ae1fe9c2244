"""Vector retrieval queries over ``embeddings``.
Every vector is a query against the whole table (itself excluded)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpline.operators import ivf as I
from helpline.operators import vector as V
from helpline.plans.catalog import register
from helpline.sources.tables import read_table


def _items(spark, d):
    return read_table(spark, d, "embeddings", ["vec_id", "embedding", "label"]).select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def _requests(spark, d):
    """Search requests: every vector asks for ``label - 2`` hits (label 9: no k)."""
    e = read_table(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"),
                    F.when(F.col("label") == 9, F.lit(None)).otherwise(F.col("label") - 2).cast("int").alias("top_k"))


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[])"
_PAIRS = f"""SELECT q.vec_id AS query_id, i.vec_id AS item_id, i.label AS item_label, q.label AS query_label, {_COS} AS score
    FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id"""
_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS hit_rank
    FROM ({_PAIRS}) p"""
_REQ_K = "CASE WHEN label = 9 THEN NULL ELSE label - 2 END"


@register("effective_top_k", f"""SELECT vec_id AS query_id, CAST({_REQ_K} AS INTEGER) AS requested_k,
    CAST(CASE WHEN {_REQ_K} IS NULL OR {_REQ_K} <= 0 THEN 5 ELSE {_REQ_K} END AS INTEGER) AS effective_k FROM embeddings""")
def q_p8(spark, d):
    r = _requests(spark, d)
    return r.select("query_id", F.col("top_k").alias("requested_k"), V.effective_top_k("top_k").alias("effective_k"))


@register("vector_join", f"""SELECT query_id, item_id, CAST(hit_rank AS INTEGER) AS hit_rank, round(score, 6) AS score
    FROM ({_RANKED}) r WHERE hit_rank <= 5""")
def q_j5(spark, d):
    it = _items(spark, d)
    q = it.select(F.col("item_id").alias("query_id"), "vector")
    h = V.vector_join(q, it, k=V.DEFAULT_TOP_K, exclude_self=True)
    return h.select("query_id", "item_id", F.col("hit_rank").cast("int"), F.round("score", 6).alias("score"))


@register("vector_join_pruned", f"""SELECT query_id, item_id, CAST(hit_rank AS INTEGER) AS hit_rank, round(score, 6) AS score
    FROM ({_RANKED}) r WHERE hit_rank <= 5""")
def q_j5_pruned(spark, d):
    """J5 through trained cells: the same rows, cells that cannot hold a hit left out."""
    it = _items(spark, d).select("item_id", "vector")
    q = it.select(F.col("item_id").alias("query_id"), "vector")
    h, _ = I.pruned_search(q, it, I.train_cells(it), V.DEFAULT_TOP_K, exclude_self=True)
    return h.select("query_id", "item_id", F.col("hit_rank").cast("int"), F.round("score", 6).alias("score"))


@register("topk_per_query", f"""SELECT query_id, item_id, CAST(hit_rank AS INTEGER) AS hit_rank, round(score, 6) AS score,
    item_label = query_label AS label_match FROM ({_RANKED}) r WHERE hit_rank <= 3""")
def q_w1(spark, d):
    it = _items(spark, d)
    q = it.select(F.col("item_id").alias("query_id"), "vector", F.col("label").alias("query_label"))
    h = V.vector_join(q, it, k=V.SCRIPT_TOP_K, exclude_self=True)
    lab = it.select("item_id", F.col("label").alias("item_label"))
    return (h.join(lab, "item_id").join(q.select("query_id", "query_label"), "query_id")
            .select("query_id", "item_id", F.col("hit_rank").cast("int"), F.round("score", 6).alias("score"),
                    (F.col("item_label") == F.col("query_label")).alias("label_match")))


@register("search", f"""SELECT r.query_id, r.item_id, CAST(r.hit_rank AS INTEGER) AS hit_rank, round(r.score, 6) AS score,
    r.item_label, k.k_eff FROM ({_RANKED}) r JOIN (SELECT vec_id AS query_id,
      CAST(CASE WHEN {_REQ_K} IS NULL OR {_REQ_K} <= 0 THEN 5 ELSE {_REQ_K} END AS INTEGER) AS k_eff FROM embeddings) k
    ON k.query_id = r.query_id WHERE r.hit_rank <= k.k_eff""")
def q_x3(spark, d):
    it = _items(spark, d)
    h = V.search(_requests(spark, d), it, exclude_self=True)
    return (h.join(it.select("item_id", F.col("label").alias("item_label")), "item_id")
            .select("query_id", "item_id", F.col("hit_rank").cast("int"), F.round("score", 6).alias("score"),
                    "item_label", F.col("k_eff").cast("int")))


@register("global_topk", """WITH c AS (SELECT list(m ORDER BY pos) AS v FROM (
      SELECT pos, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) u
      GROUP BY pos) a)
    SELECT item_id, CAST(hit_rank AS INTEGER) AS hit_rank, round(score, 6) AS score FROM (
      SELECT vec_id AS item_id, s AS score, row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS hit_rank
      FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], c.v) AS s FROM embeddings e, c) x) y
    WHERE hit_rank <= 5""")
def q_l1(spark, d):
    it = _items(spark, d)
    top = V.global_top_k(it, V.centroid(it), V.DEFAULT_TOP_K)
    # rank within the k rows already taken (TakeOrderedAndProject output)
    from pyspark.sql import Window
    w = Window.orderBy(F.round("score", 9).desc(), F.col("item_id"))
    return top.select("item_id", F.row_number().over(w).cast("int").alias("hit_rank"), F.round("score", 6).alias("score"))


@register("index_stats", """SELECT count(*) AS n_items,
    (SELECT string_agg(CAST(vec_id AS VARCHAR), ', ' ORDER BY vec_id) FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 3) s) AS sample_ids
    FROM embeddings""")
def q_a8(spark, d):
    return V.index_stats(_items(spark, d))


EMBED_DIM = 64  # dimension of the test table's vectors (FIXTURES.md)


def _planes_sql(dim: int = EMBED_DIM) -> str:
    """The LSH planes as a VALUES table ``(band, bit, h)``."""
    h = V.hyperplanes(dim, V.LSH_BANDS * V.LSH_BITS, V.LSH_SEED)
    rows = ", ".join(f"({j // V.LSH_BITS}, {j % V.LSH_BITS}, [{', '.join(f'{x:.3f}' for x in h[j])}])"
                     for j in range(len(h)))
    return f"SELECT * FROM (VALUES {rows}) p(band, bit, h)"


@register("lsh_search", f"""WITH planes AS ({_planes_sql()}),
    keys AS (SELECT e.vec_id, p.band,
        sum(CASE WHEN list_dot_product(e.embedding::DOUBLE[], p.h::DOUBLE[]) > 0 THEN 1 << p.bit ELSE 0 END) AS bucket
      FROM embeddings e, planes p GROUP BY 1, 2),
    cand AS (SELECT DISTINCT q.vec_id AS query_id, i.vec_id AS item_id FROM keys q JOIN keys i
      ON q.band = i.band AND q.bucket = i.bucket AND q.vec_id <> i.vec_id),
    scored AS (SELECT c.query_id, c.item_id, {_COS.replace('q.', 'a.').replace('i.', 'b.')} AS score
      FROM cand c JOIN embeddings a ON a.vec_id = c.query_id JOIN embeddings b ON b.vec_id = c.item_id)
    SELECT query_id, item_id, CAST(hit_rank AS INTEGER) AS hit_rank, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS hit_rank FROM scored) r
    WHERE hit_rank <= 5""")
def q_x4_lsh(spark, d):
    """Every vector against the whole table through LSH buckets."""
    it = _items(spark, d)
    q = it.select(F.col("item_id").alias("query_id"), "vector")
    h = V.approx_search(q, it, k=V.DEFAULT_TOP_K, exclude_self=True)
    return h.select("query_id", "item_id", F.col("hit_rank").cast("int"), F.round("score", 6).alias("score"))


def _train_sql() -> str:
    """The training rounds in SQL: ``cells(cell, c)`` after the last one."""
    unit = f"""items AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM (
        SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) a),
    size AS (SELECT least({I.MAX_CELLS}, greatest(1, CAST(round(sqrt(count(*))) AS BIGINT))) AS cells FROM items),
    ranked AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS no FROM items),
    sample AS (SELECT * FROM ranked WHERE no < (SELECT cells * {I.SAMPLE} FROM size)),
    cells0 AS (SELECT no AS cell, list_transform(u, lambda x: round(x, {I.DIGITS})) AS c FROM ranked WHERE no < (SELECT cells FROM size))"""
    for r in range(I.ROUNDS):
        unit += f""",
    own{r} AS (SELECT vec_id, u, arg_max(cell, (s, -cell)) AS cell FROM (
      SELECT i.vec_id, any_value(i.u) AS u, c.cell, any_value(list_dot_product(i.u, c.c)) AS s FROM sample i, cells{r} c GROUP BY 1, 3) x GROUP BY 1, 2),
    mean{r} AS (SELECT cell, list(x ORDER BY pos) AS m FROM (
      SELECT cell, pos, sum(x) AS x FROM (SELECT cell, unnest(u) AS x, unnest(range(len(u))) AS pos FROM own{r}) e GROUP BY 1, 2) y GROUP BY 1),
    cells{r + 1} AS (SELECT o.cell, CASE WHEN m.m IS NULL THEN o.c ELSE
      list_transform(m.m, lambda x: round(x / sqrt(list_dot_product(m.m, m.m)), {I.DIGITS})) END AS c
      FROM cells{r} o LEFT JOIN mean{r} m ON m.cell = o.cell)"""
    return unit


@register("approx_search", f"""WITH {_train_sql()},
    places AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell) - 1 AS place FROM (
      SELECT i.vec_id, c.cell, list_dot_product(i.u, c.c) AS s FROM items i, cells{I.ROUNDS} c) a),
    own AS (SELECT vec_id, cell FROM places WHERE place = 0),
    pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, {_COS} AS score FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id),
    asked AS (SELECT vec_id FROM ranked WHERE no < {I.CALIBRATION}),
    hits AS (SELECT place, count(*) AS n FROM (
        SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS hit_rank
        FROM pairs JOIN asked ON asked.vec_id = query_id) t
      JOIN own ON own.vec_id = item_id JOIN places p ON p.vec_id = query_id AND p.cell = own.cell WHERE hit_rank <= 5 GROUP BY 1),
    probes AS (SELECT min(place) + 1 AS n FROM (SELECT place, sum(n) OVER (ORDER BY place) AS seen, sum(n) OVER () AS total FROM hits) h
      WHERE seen >= {I.RECALL} * total)
    SELECT query_id, item_id, CAST(hit_rank AS INTEGER) AS hit_rank, round(score, 6) AS score FROM (
      SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS hit_rank
      FROM pairs JOIN own ON own.vec_id = item_id JOIN places p ON p.vec_id = query_id AND p.cell = own.cell
      WHERE p.place < (SELECT n FROM probes)) r WHERE hit_rank <= 5""")
def q_x4(spark, d):
    """Cells trained on the table, probes calibrated, every vector asked of it."""
    it = _items(spark, d).select("item_id", "vector")
    q = it.select(F.col("item_id").alias("query_id"), "vector")
    cells = I.calibrate(I.train_cells(it), q, it, V.DEFAULT_TOP_K, exclude_self=True)
    h = I.ivf_search(q, it, cells, V.DEFAULT_TOP_K, exclude_self=True)
    return h.select("query_id", "item_id", F.col("hit_rank").cast("int"), F.round("score", 6).alias("score"))
