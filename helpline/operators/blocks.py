"""Exact top-k scoring between a query table and an item table, block by block.

Items are hashed into ``n_ib`` blocks and queries into ``n_qb`` blocks, both
from row counts, so a block never holds more than about ``*_block_rows`` rows.
Each query row is copied once per item block and each item row once per query
block; the copies meet in an equi-key cogroup on ``(qb, ib)``. A vectorised
kernel scores the block pair in numpy and emits only its best ``k`` hits per
query, so at most ``k * n_ib`` rows per query reach the final ranking window
(a ``WindowGroupLimit``). No cross join, no pair rows, no driver collection;
block ids come from a hash of the id, so a recomputed task rebuilds the same
blocks after an executor loss."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_DIGITS = 9  # scores are ranked on round(score, 9), then item id


def hits_schema(queries: DataFrame, items: DataFrame) -> str:
    """``query_id, item_id, score`` with the ids' own types (text or integer)."""
    def kind(df: DataFrame, c: str) -> str:
        return "string" if df.schema[c].dataType.simpleString() == "string" else "bigint"
    return f"query_id {kind(queries, 'query_id')}, item_id {kind(items, 'item_id')}, score double"


def id_array(ids: pd.Series) -> np.ndarray:
    """Ids as integers or as text, in an array that numpy can sort (text by code
    point, as Spark does)."""
    return ids.to_numpy(np.int64) if pd.api.types.is_numeric_dtype(ids) else ids.to_numpy(dtype=str)


def _blocks(n: int, rows: int) -> int:
    return max(1, math.ceil(n / max(1, rows)))


def top_k_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``scores`` (nq x ni): indexes of the best k by
    (round(score, 9) desc, id asc) and a validity mask. ``-inf`` never wins."""
    nq, ni = scores.shape
    kk = min(k, ni)
    if kk == 0 or nq == 0:
        return np.zeros((nq, 0), dtype=np.int64), np.zeros((nq, 0), dtype=bool)
    r = np.round(scores, RANK_DIGITS)
    part = np.argpartition(-r, kk - 1, axis=1)[:, :kk]
    kth = np.take_along_axis(r, part, axis=1).min(axis=1)
    ties = (r >= kth[:, None]).sum(axis=1) > kk
    out = part.copy()
    for i in np.nonzero(ties)[0]:  # rare: equal rounded scores across the k-th place
        cand = np.nonzero(r[i] >= kth[i])[0]
        order = np.lexsort((ids[cand], -r[i, cand]))
        out[i] = cand[order[:kk]]
    # order the k winners of every row
    rs = np.take_along_axis(r, out, axis=1)
    idk = ids[out]
    order = np.lexsort((idk, -rs), axis=1)
    out = np.take_along_axis(out, order, axis=1)
    valid = np.isfinite(np.take_along_axis(r, out, axis=1))
    return out, valid


BLOCK_NUMBERS = 1 << 22  # vector components that a block holds at most
LEAST_ROWS = 1024        # smaller blocks are not worth a task


def block_counts(nq: int, ni: int, most: int, pairs: int) -> tuple[int, int]:
    """Query and item blocks of at most ``most`` rows, and about ``pairs`` pairs of them.
    The larger block is cut first: that copies the fewest rows."""
    n_qb, n_ib = _blocks(nq, most), _blocks(ni, most)
    while n_qb * n_ib < pairs and max(nq / n_qb, ni / n_ib) > LEAST_ROWS:
        if nq / n_qb > ni / n_ib:
            n_qb += 1
        else:
            n_ib += 1
    return n_qb, n_ib


def blocked_top_k(queries: DataFrame, items: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame, int], pd.DataFrame],
                  k: int, q_block_rows: int | None = None, i_block_rows: int | None = None,
                  n_queries: int | None = None, n_items: int | None = None) -> DataFrame:
    """Best ``k`` items per query. ``queries`` needs ``query_id``, ``items``
    needs ``item_id``; the kernel gets both blocks and returns rows of
    ``hits_schema`` (at most k per query, or the query's own ``k`` if it has one). Result: ``query_id, item_id, score, hit_rank``.
    Without block rows, blocks of vectors hold up to ``BLOCK_NUMBERS`` components and their
    number follows the cores (``block_counts``), so that up to that size the copies grow as the rows do."""
    nq = n_queries if n_queries is not None else queries.count()
    if q_block_rows is None and i_block_rows is None:
        ni, dim = items.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        n_qb, n_ib = block_counts(nq, ni, max(LEAST_ROWS, BLOCK_NUMBERS // max(1, dim or 1)),
                                  4 * items.sparkSession.sparkContext.defaultParallelism)
    else:
        ni = n_items if n_items is not None else items.count()
        n_qb, n_ib = _blocks(nq, q_block_rows or LEAST_ROWS), _blocks(ni, i_block_rows or 8 * LEAST_ROWS)
    # fresh attributes on both sides: a self-search (queries and items from one
    # scan) must not share expression ids across the cogroup
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    items = items.select(*[F.col(c).alias(c) for c in items.columns])
    q = (queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_qb)).cast("int"))
         .withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_ib - 1)))))
    it = (items.withColumn("ib", F.pmod(F.xxhash64("item_id"), F.lit(n_ib)).cast("int"))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1)))))

    def run(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(ipdf) == 0:
            return pd.DataFrame({"query_id": qpdf["query_id"].iloc[:0], "item_id": ipdf["item_id"].iloc[:0],
                                 "score": pd.Series([], dtype="float64")})
        return kernel(qpdf, ipdf, k)

    hits = q.groupBy("qb", "ib").cogroup(it.groupBy("qb", "ib")).applyInPandas(run, hits_schema(queries, items))
    w = Window.partitionBy("query_id").orderBy(F.round("score", RANK_DIGITS).desc(), F.col("item_id").asc())
    return hits.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank") <= k)


def stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.values]) if len(col) else np.zeros((0, 0))


MARGIN = 1e-5  # more than single precision errs in a product of unit vectors
TILE = (1024, 8192)  # queries and items that are scored at once


def _unit(m: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision; rows without a direction are NaN."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return (m / norm[:, None]).astype(np.float32)


def cosine_kernel(exclude_self: bool = False, looks: Callable | None = None):
    """Dense cosine of two blocks, tile by tile: single precision tells which items of a
    tile may come near the k-th best so far, and only these are scored in double. A query
    with many of them (copies, the first tile) has the whole tile scored. The items' column
    ``cell`` cuts tiles where the cell changes, and ``looks(queries, query vectors, cells)``
    tells which query looks into which of these cells (a boolean matrix): then every cell
    gives its best ``k``, an item counts once, and hits below the queries' ``floor`` are left out."""
    def kernel(qpdf: pd.DataFrame, ipdf: pd.DataFrame, k: int) -> pd.DataFrame:
        if looks:
            ipdf = ipdf.sort_values("cell", kind="stable")
        qids, iids = id_array(qpdf["query_id"]), id_array(ipdf["item_id"])
        qm, im = stack(qpdf["vector"]), stack(ipdf["vector"])
        qn, inn = np.linalg.norm(qm, axis=1), np.linalg.norm(im, axis=1)
        qu, iu = _unit(qm, qn), _unit(im, inn)
        cuts = [len(iids)]
        if looks:
            cells, starts = np.unique(ipdf["cell"].to_numpy(), return_index=True)
            open_to, cuts = looks(qpdf, qm, cells), [*starts[1:], len(iids)]
        ends = set(cuts)
        edges, size = [0], 512  # tiles grow as fewer items pass
        while edges[-1] < len(iids):
            edges.append(min(next(c for c in cuts if c > edges[-1]), edges[-1] + size))
            size = min(TILE[1], size * 2)
        found = [(qids[:0], iids[:0], np.zeros(0))]
        for lo in range(0, len(qids), TILE[0]):
            rows = slice(lo, lo + TILE[0])
            ids = qids[rows]
            n = len(ids)
            row, item, score = none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            least = np.round(qpdf["floor"].fillna(-np.inf).to_numpy(np.float64)[rows], RANK_DIGITS) if looks else np.full(n, -np.inf)
            kth, best = least.copy(), none  # of the cell, and of the cells before it
            for a, b in zip(edges, edges[1:]):
                own = np.arange(n) if looks is None else np.flatnonzero(open_to[rows, np.searchsorted(starts, a, "right") - 1])
                if not len(own) and (b not in ends or not len(row)):
                    continue
                s = (qu[rows] if len(own) == n else qu[rows][own]) @ iu[a:b].T
                maybe = s >= (kth[own] - MARGIN).astype(np.float32)[:, None]
                many = maybe.sum(axis=1) > 64 + 4 * k
                maybe[many] = False
                r, c = np.nonzero(maybe)
                r, c = own[r], c + a
                with np.errstate(divide="ignore", invalid="ignore"):
                    cos = np.einsum("ij,ij->i", qm[rows][r], im[c]) / (qn[rows][r] * inn[c])
                ok = np.isfinite(cos)  # zero vectors have no cosine
                if exclude_self:
                    ok &= ids[r] != iids[c]
                parts = [(row, item, score), (r[ok], c[ok], cos[ok])]
                dense = own[many]
                if len(dense):
                    full = qm[rows][dense] @ im[a:b].T
                    with np.errstate(divide="ignore", invalid="ignore"):
                        full = full / np.outer(qn[rows][dense], inn[a:b])
                    full[~np.isfinite(full)] = -np.inf
                    if exclude_self:
                        full[ids[dense][:, None] == iids[None, a:b]] = -np.inf
                    idx, valid = top_k_rows(full, iids[a:b], k)
                    at = np.repeat(np.arange(len(dense)), idx.shape[1])[valid.ravel()]
                    col = idx.ravel()[valid.ravel()]
                    parts.append((dense[at], col + a, full[at, col]))
                row, item, score = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((iids[item], -np.round(score, RANK_DIGITS), row))
                row, item, score = row[order], item[order], score[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, item, score, place = (x[place < k] for x in (row, item, score, place))
                kth[row[place == k - 1]] = np.maximum(least[row[place == k - 1]], np.round(score[place == k - 1], RANK_DIGITS))
                if looks and b in ends:
                    row, item, score = (np.concatenate(x) for x in zip(best, (row, item, score)))
                    order = np.lexsort((iids[item], -np.round(score, RANK_DIGITS), row))
                    row, item, score = row[order], item[order], score[order]
                    once = np.sort(np.unique(np.stack([row, np.unique(iids[item], return_inverse=True)[1]]), axis=1, return_index=True)[1])
                    row, item, score = row[once], item[once], score[once]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    best = row, item, score = row[place < k], item[place < k], score[place < k]
                    last = row[place[place < k] == k - 1]
                    least[last] = np.maximum(least[last], np.round(score[place[place < k] == k - 1], RANK_DIGITS))
                    (row, item, score), kth = none, least.copy()
            row, item, score = best if looks else (row, item, score)
            if "k" in qpdf:  # each query's own k
                own = place < qpdf["k"].to_numpy()[rows][row] if len(row) else np.zeros(0, bool)
                row, item, score = row[own], item[own], score[own]
            found.append((ids[row], iids[item], score))
        q, i, s = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": q, "item_id": i, "score": s})
    return kernel


def bucketed_top_k(queries: DataFrame, items: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame, int], pd.DataFrame],
                   k: int, bucket_cols: tuple[str, ...], max_buckets: int,
                   q_block_rows: int = 1024, i_block_rows: int = 8192) -> DataFrame:
    """Best ``k`` items per query among the items that share a bucket with it
    (a query may sit in several buckets, e.g. one per LSH band). Every bucket
    is cut into blocks by its own sizes, so a bucket holding a third of the
    table becomes many bounded block pairs on many tasks; each pair emits only
    its best ``k`` per query, never the pairs themselves. Bucket sizes are one
    row per bucket, at most ``max_buckets`` rows, which is what allows the
    broadcast. Result: ``query_id, item_id, score, hit_rank``."""
    keys = list(bucket_cols)
    nq = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nq"))
    ni = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ni"))
    sizes = nq.join(ni, keys).select(  # buckets present on both sides only
        *keys, F.ceil(F.col("_nq") / F.lit(max(1, q_block_rows))).cast("int").alias("_n_qb"),
        F.ceil(F.col("_ni") / F.lit(max(1, i_block_rows))).cast("int").alias("_n_ib"))
    sizes = F.broadcast(sizes) if max_buckets <= 1_000_000 else sizes
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    items = items.select(*[F.col(c).alias(c) for c in items.columns])
    q = (queries.join(sizes, keys)
         .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("_n_qb")).cast("int"))
         .withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("_n_ib") - 1))).drop("_n_qb", "_n_ib"))
    it = (items.join(sizes, keys)
          .withColumn("ib", F.pmod(F.xxhash64("item_id"), F.col("_n_ib")).cast("int"))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("_n_qb") - 1))).drop("_n_qb", "_n_ib"))

    def run(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(ipdf) == 0:
            return pd.DataFrame({"query_id": qpdf["query_id"].iloc[:0], "item_id": ipdf["item_id"].iloc[:0],
                                 "score": pd.Series([], dtype="float64")})
        return kernel(qpdf, ipdf, k)

    grp = [*keys, "qb", "ib"]
    hits = q.groupBy(*grp).cogroup(it.groupBy(*grp)).applyInPandas(run, hits_schema(queries, items))
    # a pair found in several buckets has one score; keep it once
    best = hits.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", RANK_DIGITS).desc(), F.col("item_id").asc())
    return best.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank") <= k)
