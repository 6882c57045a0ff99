"""Exact top-k inner-product search with a vector-approximation file."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sums of products under this are exact in double precision.
EXACT = float(1 << 53)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, no component null, NaN or infinite, and none of 2 ** 44 or more (its cell number would not be exact in double precision)."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float(1 << 44))), F.lit(False))


def cells(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The approximation file of a block: cell number of each component, and the cells' least and greatest values by dimension."""
    n = 1 << bits
    marks = np.quantile(v, np.linspace(0, 1, n + 1)[1:-1], axis=0)
    code = np.empty(v.shape, np.uint8)
    low, high = np.zeros((n, v.shape[1])), np.zeros((n, v.shape[1]))
    for d in range(v.shape[1]):
        code[:, d] = np.searchsorted(marks[:, d], v[:, d], side="right")
        order = np.argsort(code[:, d], kind="stable")
        s, x = code[order, d], v[order, d]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        low[s[first], d], high[s[first], d] = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    return code, low, high


def search_block(v: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, bits: int) -> list[tuple[int, int, int]]:
    """(query position, id, score) of the block's k best rows for each query, own row left out, ties to the smaller id.

    Scan: the cells give each row an upper and a lower bound of its inner product. Read: exact vectors in order of falling upper
    bound (the least possible distance first), until the kth score found is above every bound that is left.
    """
    exact = v if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1]) < EXACT else v.astype(object)
    code, low, high = cells(v.astype(np.float64), bits)
    dims = np.arange(v.shape[1])
    lo, hi = low[code, dims], high[code, dims]
    qf = q.astype(np.float64)
    up, down = np.maximum(qf, 0), np.minimum(qf, 0)
    upper = up @ hi.T + down @ lo.T
    slack = 0.0 if exact is v else np.abs(upper).max() * 1e-9  # beyond 2 ** 53 the bounds are rounded
    out = []
    for i in range(len(q)):
        row = upper[i] + slack
        order = np.argsort(-row, kind="stable")
        at, step, got_s, got_i = 0, 4 * k, [], []
        while at < len(order):
            take = order[at : at + step]
            at += len(take)
            take = take[ids[take] != own[i]] if own[i] is not None else take
            s = exact[take] @ (q[i] if exact is v else q[i].astype(object))
            got_s, got_i = np.concatenate([got_s, s]) if len(got_s) else s, np.concatenate([got_i, ids[take]]) if len(got_i) else ids[take]
            if len(got_s) >= k:
                best = np.lexsort((got_i, -got_s))[:k] if exact is v else np.array(sorted(range(len(got_s)), key=lambda j: (-got_s[j], got_i[j]))[:k])
                got_s, got_i = got_s[best], got_i[best]
                if at >= len(order) or row[order[at]] < got_s[-1]:
                    break
            step *= 2
        best = sorted(zip(got_s, got_i, strict=True), key=lambda x: (-x[0], x[1]))[:k]
        out += [(i, int(b), max(-1 << 63, min((1 << 63) - 1, int(a)))) for a, b in best]
    return out


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    c = t.column(column).combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.empty((0, 0), np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096, query_block: int = 4096, bits: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of vectors with the highest integer inner product, ties to the smaller id.

    Both tables are cut into blocks of about `block` and `query_block` rows by a hash of the row's place; each pair of blocks is one
    task's work, so no task holds more than one block of either. A query's own row (equal id) is no candidate. Vectors that are
    null or hold null, non-finite or very large components (2 ** 44 or more) take no part; a score beyond 64 bits is the nearest
    64-bit number; vectors of different lengths are not compared; fewer than k candidates give fewer rows, an empty table none.
    Repeated rows are candidates each, and queries of one id share one list; other columns are not read. Every row is searched:
    blocks bound memory, not the answer.
    """
    def ready(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        rows = df.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), quantised(F.col(vec_col)).alias("v"), F.monotonically_increasing_id().alias("row"))
        n = max(1, math.ceil(rows.count() / size))
        return rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("part")), n

    (rows, n_rows), (asks, n_asks) = ready(vectors, block), ready(queries, query_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select("id", "v", "dim", F.col("part").alias("rb"), every(n_asks).alias("qb"))
    asks = asks.select("id", "v", "dim", every(n_rows).alias("rb"), F.col("part").alias("qb"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right) and left.column("dim")[0].as_py():
            v, q = _matrix(left, "v"), _matrix(right, "v")
            ids, own = left.column("id").to_numpy(), right.column("id").to_numpy()
            found = [(own[i], x, s) for i, x, s in search_block(v, ids, q, own, k, bits)]
        return pa.table({n: pa.array([f[j] for f in found], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    keys = ["rb", "qb", "dim"]
    found = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
