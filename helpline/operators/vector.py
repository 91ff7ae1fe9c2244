"""Vector retrieval: effective k (P8), exact top-k join (J5 + W1), search with
per-query k (X3), approximate search by LSH buckets (X4), global top-k for one
query (L1), index stats (A8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpline.operators.blocks import RANK_DIGITS, blocked_top_k, bucketed_top_k, cosine_kernel, stack

DEFAULT_TOP_K = 5      # agent tool default
SCRIPT_TOP_K = 3       # smoke-script default
LSH_BANDS = 8          # approximate search: bands of sign bits
LSH_BITS = 4           # bits per band (2**bits buckets per band)
LSH_SEED = 7


def effective_top_k(k: Column | str, default: int = DEFAULT_TOP_K) -> Column:
    """K NULL or <= 0 means the default."""
    c = F.col(k) if isinstance(k, str) else k
    return F.when(c.isNull() | (c <= 0), F.lit(default)).otherwise(c).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two ARRAY<FLOAT> columns in DOUBLE (row-local, JVM-side)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return dot / (na * nb)


def vector_join(queries: DataFrame, items: DataFrame, k: int = DEFAULT_TOP_K, exclude_self: bool = False,
                q_block_rows: int | None = None, i_block_rows: int | None = None) -> DataFrame:
    """J5 + W1: best k items per query by cosine. ``queries(query_id, vector)``,
    ``items(item_id, vector)``; ids are integers or texts; a column ``k`` of the
    queries holds a lower k of their own. Exact; see ``blocks.blocked_top_k``."""
    return blocked_top_k(queries.select(*[c for c in ("query_id", "vector", "k") if c in queries.columns]), items.select("item_id", "vector"),
                         cosine_kernel(exclude_self), k, q_block_rows, i_block_rows)


def search(requests: DataFrame, items: DataFrame, exclude_self: bool = False) -> DataFrame:
    """``requests(query_id, vector, top_k)``; each request gets its own
    effective k, which the kernel keeps to as well, so one request for many
    hits does not make the blocks emit many for the others."""
    req = requests.withColumn("k_eff", effective_top_k("top_k"))
    k_max = req.agg(F.max("k_eff")).first()[0] or DEFAULT_TOP_K  # one scalar
    hits = vector_join(req.select("query_id", "vector", F.col("k_eff").alias("k")), items, int(k_max), exclude_self)
    return (hits.join(req.select("query_id", "k_eff"), "query_id")
            .filter(F.col("hit_rank") <= F.col("k_eff")))


def hyperplanes(dim: int, n_planes: int, seed: int = LSH_SEED) -> np.ndarray:
    """``n_planes x dim`` random hyperplanes from a seed, rounded to three
    decimals (the nearest double of each decimal), so SQL can replay them."""
    h = np.random.default_rng(seed).standard_normal((n_planes, dim))
    return np.array([[float(f"{x:.3f}") for x in row] for row in h])


def lsh_buckets(vectors: DataFrame, n_bands: int = LSH_BANDS, n_bits: int = LSH_BITS,
                seed: int = LSH_SEED) -> DataFrame:
    """Sign-random-projection buckets: one row per (vector, band) with
    ``bucket`` = the band's sign bits (bit i set when the vector lies on the
    positive side of plane ``band * n_bits + i``). Arrow-batched numpy, one
    matrix product per batch; the planes are rebuilt from the seed on each
    worker, nothing is shipped from the driver."""
    n_planes = n_bands * n_bits
    weights = (1 << np.arange(n_bits)).astype(np.int64)
    planes: dict[int, np.ndarray] = {}  # per worker, by dimension (travels empty, by value)

    @F.pandas_udf("array<int>")
    def keys(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        m = stack(v)
        if m.shape[1] not in planes:
            planes[m.shape[1]] = hyperplanes(m.shape[1], n_planes, seed)
        bits = (m @ planes[m.shape[1]].T > 0).reshape(len(m), n_bands, n_bits)
        return pd.Series(list((bits * weights).sum(axis=2).astype(np.int32)))

    return vectors.select("*", F.posexplode(keys(F.col("vector"))).alias("band", "bucket"))


def approx_search(queries: DataFrame, items: DataFrame, k: int = DEFAULT_TOP_K, exclude_self: bool = False,
                  n_bands: int = LSH_BANDS, n_bits: int = LSH_BITS, seed: int = LSH_SEED,
                  q_block_rows: int = 1024, i_block_rows: int = 8192) -> DataFrame:
    """Best k by cosine among the items that share at least one LSH bucket
    with the query (approximate: a true neighbour in no shared bucket is
    missed; recall is measured against the exact ``vector_join`` in tests).
    Candidates are never capped and never materialised as pairs: buckets are
    scored block by block (``blocks.bucketed_top_k``)."""
    q = lsh_buckets(queries.select("query_id", "vector"), n_bands, n_bits, seed)
    it = lsh_buckets(items.select("item_id", "vector"), n_bands, n_bits, seed)
    return bucketed_top_k(q, it, cosine_kernel(exclude_self), k, ("band", "bucket"), n_bands << n_bits,
                          q_block_rows, i_block_rows)


def global_top_k(items: DataFrame, query_vector: list[float], k: int = DEFAULT_TOP_K) -> DataFrame:
    """L1: the k items most similar to one query vector (TakeOrderedAndProject).
    The single query vector is a literal; items are scored row-locally."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    scored = items.select("item_id", cosine(F.col("vector"), q).alias("score"))
    return scored.orderBy(F.round("score", RANK_DIGITS).desc(), F.col("item_id").asc()).limit(k)


def centroid(items: DataFrame) -> list[float]:
    """Mean vector of a table: distributed per-dimension mean; only ``dim``
    numbers reach the driver."""
    per_dim = (items.select(F.posexplode("vector").alias("pos", "x"))
               .groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m")))
    rows = per_dim.collect()  # bounded by the vector dimension
    out = [0.0] * (max(r["pos"] for r in rows) + 1 if rows else 0)
    for r in rows:
        out[r["pos"]] = r["m"]
    return out


def index_stats(items: DataFrame, n_samples: int = 3) -> DataFrame:
    """Item count and the first ids (by id) as samples, one row. Samples come
    from a distributed top-n (TakeOrderedAndProject), never from a full list;
    count and samples meet in one aggregate (no join): every item adds to the
    count, only the ``n_samples`` sample rows carry an id to collect."""
    counted = items.select(F.lit(1).alias("_c"), F.lit(None).cast("long").alias("_s"))
    samples = (items.select("item_id").orderBy("item_id").limit(n_samples)
               .select(F.lit(None).cast("int").alias("_c"), F.col("item_id").cast("long").alias("_s")))
    g = counted.unionByName(samples).agg(F.count("_c").alias("n_items"), F.array_sort(F.collect_list("_s")).alias("s"))
    return g.select("n_items", F.array_join(F.transform("s", lambda x: x.cast("string")), ", ").alias("sample_ids"))
