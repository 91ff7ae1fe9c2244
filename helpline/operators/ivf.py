"""Search by an inverted file of trained cells: approximate (X4), and exact with pruning.

Cells are spherical k-means centroids, as many as the root of the number of vectors.
They are trained on a bounded sample (``SAMPLE`` vectors a cell, those of least id hash)
in distributed rounds: every task adds up its vectors by cell, only cells x dimensions
numbers reach the driver. Every vector is then assigned to its nearest cell. A query
looks into its nearest cells, and how many is calibrated: the exact neighbours of a
sample of queries tell in which of their cells the neighbours lie, and the least number that
holds ``RECALL`` of them is taken. Cells are scored in bounded blocks
(``blocks.bucketed_top_k``), so a cell with a third of all vectors is many tasks.

The share of pairs that this takes depends on the vectors. Where neighbours cluster a few cells
suffice; without any structure (the test table's are uniform in 64 dimensions) no
partition can do with few, and the calibration then asks for most cells. ``share`` tells it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helpline.operators.blocks import (BLOCK_NUMBERS, LEAST_ROWS, RANK_DIGITS, block_counts, blocked_top_k, bucketed_top_k,
                                       cosine_kernel, hits_schema, stack)
from helpline.session import materialize

MAX_CELLS = 65_536      # bounds what is broadcast: cells x dimensions numbers
SAMPLE = 256            # training vectors a cell
ROUNDS = 2
CALIBRATION = 256       # queries whose exact neighbours are found
RECALL = 0.95           # share of those neighbours that the probed cells hold
DIGITS = 6              # centroids are rounded, so that SQL can replay the rounds


def id_hash(c: Column | str) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("string"))


def unit_rows(v: pd.Series) -> np.ndarray:
    m = stack(v)
    if not len(m):
        return m
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest(m: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each row, nearest first, ties by cell number."""
    return np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :n]


@dataclass
class Cells:
    """``probes``: cells a query looks into; ``share``: part of all pairs that this scores."""
    centroids: np.ndarray
    probes: int = 1
    share: float = 1.0

    def assign(self, vectors: DataFrame, n: int) -> DataFrame:
        """One row per vector and each of its ``n`` nearest cells (``place`` from 0)."""
        sent = vectors.sparkSession.sparkContext.broadcast(self.centroids)

        @F.pandas_udf("array<int>")
        def cells(v: pd.Series) -> pd.Series:
            return pd.Series(list(nearest(unit_rows(v), sent.value, n).astype(np.int32)) if len(v) else [], dtype=object)
        return vectors.select("*", F.posexplode(cells(F.col("vector"))).alias("place", "cell"))


def train_cells(items: DataFrame, cells: int | None = None, rounds: int = ROUNDS) -> Cells:
    """``items(item_id, vector)``. Null vectors are left out; a cell that loses all its
    vectors keeps its centroid."""
    items = items.where(F.col("vector").isNotNull()).select("item_id", "vector")
    n = items.count()
    cells = min(MAX_CELLS, cells or max(1, round(math.sqrt(n))))
    first = items.orderBy(id_hash("item_id"), "item_id").limit(cells).collect()
    if not first:
        return Cells(np.zeros((0, 0)))
    centroids = np.round(unit_rows(pd.Series([r["vector"] for r in first])), DIGITS)
    sample = items if n <= SAMPLE * cells else items.orderBy(id_hash("item_id"), "item_id").limit(SAMPLE * cells)
    for _ in range(rounds):
        sent = items.sparkSession.sparkContext.broadcast(centroids)

        def add_up(batches):
            total, count = np.zeros_like(sent.value), np.zeros(len(sent.value), np.int64)
            for b in batches:
                m = unit_rows(b["vector"])
                if len(m):
                    own = nearest(m, sent.value, 1)[:, 0]
                    np.add.at(total, own, m)
                    count += np.bincount(own, minlength=len(count))
            own = np.flatnonzero(count)
            if len(own):  # a task without vectors: an empty list column has no Arrow type
                yield pd.DataFrame({"cell": own, "total": list(total[own])})
        parts = sample.select("vector").mapInPandas(add_up, "cell int, total array<double>")
        sums = parts.select("cell", F.posexplode("total").alias("pos", "x")).groupBy("cell", "pos").agg(F.sum("x").alias("x"))
        moved = sums.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).collect()
        for r in moved:  # one row per cell
            v = np.array([x["x"] for x in r["v"]])
            norm = np.linalg.norm(v)
            if norm > 0:
                centroids[r["cell"]] = np.round(v / norm, DIGITS)
    return Cells(centroids)


def calibrate(cells: Cells, queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = False,
              recall: float = RECALL, sample: int = CALIBRATION) -> Cells:
    """Sets ``probes`` and ``share`` from the exact neighbours of the sampled queries."""
    n = len(cells.centroids)
    if n == 0:
        return cells
    asked = queries.orderBy(id_hash("query_id"), "query_id").limit(sample)
    true = blocked_top_k(asked.select("query_id", "vector"), items.select("item_id", "vector"), cosine_kernel(exclude_self), k)
    own = cells.assign(items.select("item_id", "vector"), 1).select("item_id", "cell")
    places = cells.assign(asked.select("query_id", "vector"), n).select("query_id", "place", "cell")
    hits = true.select("query_id", "item_id").join(own, "item_id").join(places, ["query_id", "cell"]).groupBy("place").agg(
        F.count("*").alias("n")).orderBy("place").collect()  # at most a row per cell
    total, seen, probes = sum(r["n"] for r in hits), 0, 1
    for r in hits:
        seen, probes = seen + r["n"], r["place"] + 1
        if seen >= recall * total:
            break
    size = {r["cell"]: r["n"] for r in own.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    looked = places.where(F.col("place") < probes).groupBy("cell").agg(F.count("*").alias("n")).collect()
    pairs = sum(size.values()) * (asked.count() or 1)
    return Cells(cells.centroids, probes, sum(r["n"] * size.get(r["cell"], 0) for r in looked) / max(1, pairs))


def ivf_search(queries: DataFrame, items: DataFrame, cells: Cells, k: int, exclude_self: bool = False,
               q_block_rows: int = 1024, i_block_rows: int = 8192) -> DataFrame:
    """Best ``k`` by cosine among the items of the query's ``probes`` nearest cells."""
    q = cells.assign(queries.select("query_id", "vector").where(F.col("vector").isNotNull()), cells.probes).drop("place")
    it = cells.assign(items.select("item_id", "vector").where(F.col("vector").isNotNull()), 1).drop("place")
    return bucketed_top_k(q, it, cosine_kernel(exclude_self), k, ("cell",), MAX_CELLS, q_block_rows, i_block_rows)



SLACK = 1e-7  # angles are compared with this much room, so rounding prunes no hit


def _deal(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell: cells in turn share blocks of about
    ``rows`` items, a larger cell has blocks of its own. No items: no block."""
    first, count = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    block, filled = 0, 0
    for c in np.flatnonzero(sizes):
        count[c] = -(-sizes[c] // rows)
        if filled and filled + sizes[c] > rows:
            block, filled = block + 1, 0
        first[c] = block
        block, filled = (block + count[c], 0) if count[c] > 1 else (block, filled + sizes[c])
    return first, count


def pruned_search(queries: DataFrame, items: DataFrame, cells: Cells, k: int, exclude_self: bool = False,
                  q_block_rows: int | None = None, i_block_rows: int | None = None) -> tuple[DataFrame, float]:
    """Exact best ``k`` by cosine (the rows of ``vector.vector_join``), and the share of all
    pairs that was scored. Angles obey the triangle inequality: an item of a cell is no
    nearer to a query than the cell's centroid less the cell's radius. A first pass over
    each query's nearest cell bounds its k-th hit; a second one scores only the cells that
    can still beat it. Vectors that are null or zero hit nothing. On vectors without
    clusters nothing can be pruned, and the plain join is cheaper.

    Which cells a query looks into is never a row: cells share blocks, a query is copied
    once per block that holds a cell for it, and within a block its cells are told again
    from the centroids. So at most as much is moved as by the plain join in blocks."""
    queries = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    items = items.select("item_id", "vector").where(F.col("vector").isNotNull())
    n = len(cells.centroids)
    if n == 0:
        return blocked_top_k(queries, items, cosine_kernel(exclude_self), k), 1.0
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(cells.centroids)

    @F.pandas_udf("double")
    def angle(v: pd.Series, cell: pd.Series) -> pd.Series:
        m = unit_rows(v)
        return pd.Series(np.arccos(np.clip((m * unit_rows(pd.Series(list(sent.value[cell])))).sum(axis=1), -1, 1)) if len(v) else [], dtype=float)
    own = materialize(cells.assign(items, 1).withColumn("angle", angle("vector", "cell")).drop("place"), "pruned-items")
    radius, size, dim = np.zeros(n), np.zeros(n, np.int64), 1
    for r in own.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).collect():
        radius[r["cell"]], size[r["cell"]], dim = r["radius"], r["n"], max(dim, r["dim"])  # a row per cell
    nq, ni = queries.count(), int(size.sum())
    if not nq or not ni:
        return blocked_top_k(queries, items, cosine_kernel(exclude_self), k), 0.0
    most = max(LEAST_ROWS, BLOCK_NUMBERS // dim)
    n_qb, n_ib = block_counts(nq, ni, most, 4 * spark.sparkContext.defaultParallelism)
    n_qb = math.ceil(nq / q_block_rows) if q_block_rows else n_qb
    block, blocks = _deal(size, i_block_rows or math.ceil(ni / n_ib))
    told = spark.sparkContext.broadcast((radius, size, block, blocks))

    def beats(m: np.ndarray, some: np.ndarray, first: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Which of ``some`` cells may hold a hit for each row, its first one apart."""
        far = np.arccos(np.clip(m @ unit_rows(pd.Series(list(sent.value[some]))).T, -1, 1)) - told.value[0][some]
        kth = np.where(np.isnan(floor), np.inf, np.arccos(np.minimum(floor, 1.0)))
        return (far <= kth[:, None] + SLACK) & (some[None, :] != first[:, None])

    def parts(v: pd.Series):
        """Rows that are met with all cells at once."""
        step = max(1, BLOCK_NUMBERS // n)
        for lo in range(0, len(v), step):
            yield slice(lo, lo + step), unit_rows(v.iloc[lo:lo + step])

    @F.pandas_udf("int")
    def nearest_held(v: pd.Series) -> pd.Series:
        held = told.value[1] > 0
        return pd.Series([c for _, m in parts(v) for c in np.argmax(np.where(held, m @ sent.value.T, -np.inf), axis=1)], dtype="int32")

    @F.pandas_udf("blocks array<int>, looked bigint")
    def places(v: pd.Series, cell: pd.Series, floor: pd.Series) -> pd.DataFrame:
        _, size, block, blocks = told.value
        held = np.flatnonzero(size)
        start = np.flatnonzero(np.r_[True, np.diff(block[held]) > 0])  # cells of one block follow each other
        found, looked = [], []
        for rows, m in parts(v):
            first = cell.to_numpy(np.int64)[rows]
            open_to = beats(m, held, first, floor.to_numpy(np.float64)[rows])
            looked.extend(open_to @ size[held] + size[first])
            per_block = np.repeat(np.logical_or.reduceat(open_to, start, axis=1), blocks[held][start], axis=1)
            found.extend(np.flatnonzero(x).astype(np.int32) for x in per_block)
        return pd.DataFrame({"blocks": pd.Series(found, dtype=object), "looked": pd.Series(looked, dtype="int64")})

    asked = queries.withColumn("cell", nearest_held("vector"))
    # the nearest cell that holds items
    near = materialize(bucketed_top_k(asked, own.drop("angle"), cosine_kernel(exclude_self), k, ("cell",), MAX_CELLS,
                                      q_block_rows or LEAST_ROWS, i_block_rows or 8 * LEAST_ROWS), "pruned-first")
    bound = near.where(F.col("hit_rank") == k).select("query_id", F.col("score").alias("floor"))
    todo = materialize(asked.join(bound, "query_id", "left").withColumn("to", places("vector", "cell", "floor")), "pruned-rest")
    share = todo.agg(F.sum("to.looked")).first()[0] / (nq * ni)
    q = todo.select("query_id", "vector", "cell", "floor", F.explode("to.blocks").alias("ib"),
                    F.pmod(F.xxhash64("query_id"), F.lit(n_qb)).cast("int").alias("qb"))
    at = spark.createDataFrame([(c, int(block[c]), int(blocks[c])) for c in np.flatnonzero(size).tolist()], "cell int, block int, blocks int")
    it = own.join(F.broadcast(at), "cell").select(
        "item_id", "vector", "cell", (F.col("block") + F.pmod(F.xxhash64("item_id"), F.col("blocks"))).cast("int").alias("ib"),
        F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))).alias("qb"))
    kernel = cosine_kernel(exclude_self, lambda qpdf, qm, some: np.concatenate(
        [beats(m, some, qpdf["cell"].to_numpy(np.int64)[rows], qpdf["floor"].to_numpy(np.float64)[rows]) for rows, m in parts(qpdf["vector"])]))

    def run(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(qpdf, ipdf, k) if len(qpdf) and len(ipdf) else pd.DataFrame(
            {"query_id": qpdf["query_id"].iloc[:0], "item_id": ipdf["item_id"].iloc[:0], "score": pd.Series([], dtype="float64")})
    rest = q.groupBy("qb", "ib").cogroup(it.groupBy("qb", "ib")).applyInPandas(run, hits_schema(queries, items))
    both = near.drop("hit_rank").withColumn("_pass", F.lit(1)).unionByName(rest.withColumn("_pass", F.lit(2)))
    best = both.repartition("query_id").groupBy("query_id", "item_id", "_pass").agg(F.max("score").alias("score")).drop("_pass")
    w = Window.partitionBy("query_id").orderBy(F.round("score", RANK_DIGITS).desc(), F.col("item_id").asc())
    return best.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank") <= k), share
