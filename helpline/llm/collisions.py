"""Near-duplicate vectors by collision counting on one-dimensional projections.

Two unit vectors at the least cosine differ by a known distance, and their
projections on a random direction by a known distribution: a window around the
query's projection of ``WINDOW`` standard deviations holds the other with known
probability. A pair that falls into each other's window on enough of the
projections (the largest count that a pair at the threshold reaches with
probability ``RECALL``) is verified by its cosine in double precision. The pairs
that are counted come from a wider window on the first projection alone, which
with the count keeps a pair at the threshold with probability ``RECALL``.

Only vectors of one label (and length) meet. A label larger than ``CELL`` is first
cut into cells by random hyperplanes, one bit per doubling, in as many tables as a
pair at the threshold needs to share a cell with probability ``RECALL``; a pair
that shares cells of several tables counts in the first. Inside a cell the queries
are sorted along the first projection, so a run of queries only sees the slice of
vectors within the wider window. A cell above ``BLOCK`` members is dealt out as pairs of
blocks. Equal vectors are one vector with a multiplicity. A task returns link
counts per vector and a spanning set of its links, never all pairs.

Edge cases: a null label, a null or zero vector, or one with null or non-finite
components links with nothing and is its own component; repeated rows are equal
vectors and link; a null id counts as a link but names no component; an empty
table gives no rows; extra columns are ignored; equal projections share a window, so ties
lose no pair; vectors of any length meet those of their own length only.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpline.llm.common import connected_components
from helpline.session import materialize

THRESHOLD = 0.93
RECALL = 0.9995
PROJECTIONS, WINDOW = 16, 2.0
CELL, BLOCK = 4_096, 2_048
QUERIES = 64                 # queries that share one slice
SEED = 20_240


def _count_and_recall(m: int, window: float, recall: float) -> tuple[int, float]:
    hit = math.erf(window / math.sqrt(2))
    tail = 0.0
    for t in range(m, 0, -1):
        tail += math.comb(m, t) * hit ** t * (1 - hit) ** (m - t)
        if tail >= recall:
            return t, tail
    return 0, 1.0


def calibrated_count(m: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """Largest count of ``m`` windows a pair at the threshold reaches with
    probability ``recall``."""
    return _count_and_recall(m, window, recall)[0]


def slice_window(m: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> float:
    """Standard deviations around a query on the first projection that may miss
    a pair at the threshold as often as the count leaves of ``1 - recall``."""
    missed = _count_and_recall(m, window, recall)[1] - recall
    return max(window, -NormalDist().inv_cdf(missed / 2))


def cell_plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """``(bits, tables)`` for a label of ``n`` vectors."""
    bits = max(0, math.ceil(math.log2(n / CELL))) if n > CELL else 0
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(1 - RECALL) / math.log(1 - share))


def _codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    out = np.zeros((len(vectors), tables), dtype=np.int64)
    for t in range(tables):
        for b in range(bits):
            plane = np.random.default_rng([SEED, t, b]).standard_normal(vectors.shape[1])
            out[:, t] = (out[:, t] << 1) | (vectors @ plane > 0)
    return out


def _links(a: np.ndarray, b: np.ndarray, threshold: float):
    """Verified pairs ``(i, j)`` of the rows of two unit matrices, run by run."""
    d = a.shape[1]
    lines = np.random.default_rng([SEED, 1 << 20]).standard_normal((d, PROJECTIONS))
    lines /= np.linalg.norm(lines, axis=0)
    sigma = math.sqrt(2 - 2 * threshold) / math.sqrt(d)
    window, wide = WINDOW * sigma, slice_window() * sigma
    need = calibrated_count()
    pa, pb = a @ lines, b @ lines
    order_a, order_b = np.argsort(pa[:, 0], kind="stable"), np.argsort(pb[:, 0], kind="stable")
    first = pb[order_b, 0]
    for at in range(0, len(a), QUERIES):
        q = order_a[at:at + QUERIES]
        lo = np.searchsorted(first, pa[q[0], 0] - wide)
        hi = np.searchsorted(first, pa[q[-1], 0] + wide, side="right")
        near = order_b[lo:hi]
        count = np.zeros((len(q), len(near)), dtype=np.uint8)
        for k in range(PROJECTIONS):
            count += np.abs(pa[q, k][:, None] - pb[near, k][None, :]) <= window
        passed = count >= need
        some = passed.any(axis=0)
        near, passed = near[some], passed[:, some]
        i, j = np.nonzero(passed & (a[q] @ b[near].T >= threshold))
        yield q[i], near[j]


def _cell(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        vec = np.vstack([np.frombuffer(x) for x in pdf["vec"]])
        code = np.vstack([np.frombuffer(x, dtype=np.int64) for x in pdf["codes"]])
        t, uid, copies, side = int(pdf["t"].iloc[0]), pdf["uid"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy()
        left = np.flatnonzero(side == side[0])
        right = np.flatnonzero(side != side[0]) if len(left) < len(side) else left
        count, label, edges = np.zeros(len(uid), np.int64), np.arange(len(uid)), []
        for i, j in _links(vec[left], vec[right], threshold):
            i, j = left[i], right[j]
            own = i != j
            if t:
                own &= ~(code[i, :t] == code[j, :t]).any(axis=1)
            if right is left:
                own &= i < j
            i, j = i[own], j[own]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            while len(i):  # join what is not connected yet
                open_ = label[i] != label[j]
                i, j = i[open_], j[open_]
                if len(i):
                    edges.append((uid[i[0]], uid[j[0]]))
                    label[label == label[i[0]]] = label[j[0]]
        rows = [(u, None, c) for u, c in zip(uid, count) if c] + [(a, b, 0) for a, b in edges]
        return pd.DataFrame(rows, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``(vec_id, embedding, label)``."""
    def number(batches):
        part, n = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            yield b.assign(uid=part + n + np.arange(len(b)), vec_id=b["vec_id"].astype("Int64"), label=b["label"].astype("Int64"))
            n += len(b)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                          F.col("label").cast("bigint").alias("label"))
    rows = materialize(rows.mapInPandas(number, "vec_id bigint, embedding array<double>, label bigint, uid bigint"), "collide-rows")
    ok = (F.col("label").isNotNull() & F.col("embedding").isNotNull()
          & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
          & F.exists("embedding", lambda x: x != 0))
    valid = rows.where(F.coalesce(ok, F.lit(False))).withColumn("key", F.md5(F.concat_ws(
        ",", F.col("label").cast("string"), F.transform("embedding", lambda x: (x + 0.0).cast("string")))))
    same = valid.groupBy("key").agg(F.min("uid").alias("rep"), F.count("*").alias("copies"))
    reps = valid.join(same, F.col("uid") == F.col("rep")).select("uid", "copies", "label", F.size("embedding").alias("d"), "embedding")
    sized = reps.join(reps.groupBy("label", "d").agg(F.count("*").alias("members")), ["label", "d"])

    def place(batches):
        for b in batches:
            for (_, n), x in b.groupby(["d", "members"]):
                v = np.vstack(x["embedding"].to_list()).astype(np.float64)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                bits, tables = cell_plan(int(n))
                codes = _codes(v, bits, tables)
                for t in range(tables):
                    yield pd.DataFrame({"label": x["label"].to_numpy(), "d": x["d"].to_numpy(), "t": t, "cell": codes[:, t],
                                        "uid": x["uid"].to_numpy(), "copies": x["copies"].to_numpy(),
                                        "vec": [r.tobytes() for r in v], "codes": [r.tobytes() for r in codes]})
    cells = materialize(sized.mapInPandas(
        place, "label bigint, d int, t int, cell bigint, uid bigint, copies bigint, vec binary, codes binary"), "collide-cells")
    size = cells.groupBy("label", "d", "t", "cell").agg(F.count("*").alias("n"))
    x = cells.join(size, ["label", "d", "t", "cell"]).where("n > 1").withColumn(
        "blocks", F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int"))
    x = x.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    told = x.select("label", "d", "t", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    F.col("own").alias("side"), "uid", "copies", "vec", "codes").groupBy(
        "label", "d", "t", "cell", "i", "j").applyInPandas(_cell(threshold), "a bigint, b bigint, n bigint")
    told = materialize(told, "collide-links")
    found = connected_components(told.where("b is not null"), "collide-classes")
    links = told.where("b is null").groupBy(F.col("a").alias("linked")).agg(F.sum("n").alias("others"))
    member = valid.select("uid", "key").join(same, "key").join(links, F.col("rep") == F.col("linked"), "left").join(
        found, F.col("rep") == F.col("id"), "left").select(
        F.col("uid").alias("u"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("root"))
    full = rows.select("uid", "vec_id").join(member, F.col("uid") == F.col("u"), "left").withColumn("root", F.coalesce("root", "uid"))
    least = full.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return full.join(least, "root").select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), "component_id",
                                           F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
