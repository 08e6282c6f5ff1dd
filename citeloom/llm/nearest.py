"""Nearest neighbours by a block matrix join of int8 tiles, exact through error bounds."""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Rows of a candidate tile and of a query block.
TILE, BLOCK = 8192, 4096


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers of at most 127, their scale by row, and the length of what rounding leaves out."""
    scale = np.abs(v).max(1, initial=0, keepdims=True) / 127
    whole = np.rint(v / np.where(scale > 0, scale, 1))
    return whole, scale[:, 0], np.linalg.norm(v - whole * scale, axis=1)


def tile_best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of one tile: ids and scores of the ``k`` best candidates of each query, best first, ties to smaller ids.

    The products of int8 values, as floats, which hold them exactly, give each score to within |q - q'| |x| + |q'| |x - x'|, by the rounded vectors q' and x'. A
    candidate whose upper bound is below the k-th best lower bound can't be among the best; the others are
    computed in double precision.
    """
    qw, qs, q_lost = quantise(q)
    xw, xs, x_lost = quantise(x)
    kind = np.float32 if q.shape[1] * 127 * 127 < 2**24 else np.float64
    xt, x_len, ids_of = np.ascontiguousarray(xw.astype(kind).T), np.linalg.norm(x, axis=1), x_ids
    out = []
    for at in range(0, len(q), 256):
        part = slice(at, at + 256)
        near = (qw[part].astype(kind) @ xt).astype(np.float64) * qs[part, None] * xs[None, :]
        q_kept = np.linalg.norm(qw[part] * qs[part, None], axis=1)
        slack = q_lost[part, None] * x_len[None, :] + q_kept[:, None] * x_lost[None, :]
        slack += 1e-9 * (1 + np.abs(near))
        own = q_ids[part, None] == ids_of[None, :]
        lower = np.where(own, -np.inf, near - slack)
        least = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(lower), -np.inf)
        alive = (near + slack >= least[:, None]) & ~own
        for i in range(len(near)):
            c = np.flatnonzero(alive[i])
            exact = np.add.accumulate(x[c] * q[at + i], axis=1)[:, -1]  # one after another, so that equal vectors have equal scores wherever they stand
            order = np.lexsort((ids_of[c], -exact))[:k]
            out.append((ids_of[c][order], exact[order]))
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """The ``k`` candidates with the largest inner product with each query; all rows are candidates, but not of themselves.

    Candidates are dealt into tiles and queries into blocks, by hashes; each tile meets each block once, as a
    matrix product, and gives the best of its own; heaps merge these. The result is exact: the quantised
    products only rule out.

    Returns query_id, rank (from 1), vec_id, score (in double precision on the given vectors), nearest first, ties to
    the smaller id; all candidates if there are fewer than ``k``. Vectors that are null, empty, zero or hold null or
    non-finite components, and null ids, take no part; vectors of another length are no candidates of a query. Of rows
    that repeat an id, that with the least vector counts. Other columns are not carried.
    """
    v = F.col("v")
    good = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    valid = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("is_query")).filter(good)
    rows = stash(valid.groupBy("vec_id").agg(F.min("v").alias("v"), F.bool_or("is_query").alias("is_query")).withColumn("dim", F.size("v")), "vectors")
    n, n_q = rows.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1))).first()
    tiles, blocks = max(1, -(-n // tile)), max(1, -(-n_q // block))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("dim", part(tiles).alias("tile"), every(blocks).alias("block"), "vec_id", "v")
    queries = rows.filter("is_query").select(F.size("v").alias("dim"), every(tiles).alias("tile"), part(blocks).alias("block"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    keys = ["dim", "tile", "block"]
    found_schema = pa.schema([("query_id", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def product(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            return found_schema.empty_table()
        q_ids = q.column("query_id").to_numpy()
        best = tile_best(_matrix(q.column("q")), q_ids, _matrix(x.column("v")), x.column("vec_id").to_numpy(), k)
        return pa.table([pa.array(q_ids), pa.array([b[0] for b in best], pa.list_(pa.int64())), pa.array([b[1] for b in best], pa.list_(pa.float64()))], schema=found_schema)

    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(product, "query_id long, vec_ids array<long>, scores array<double>")

    def merge(key: tuple, lists: pa.Table) -> pa.Table:
        ways = [zip([-s for s in scores], ids) for ids, scores in zip(lists.column("vec_ids").to_pylist(), lists.column("scores").to_pylist())]
        best = list(islice(heapq.merge(*ways), k))
        return pa.table({"query_id": pa.array([key[0].as_py()] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()), "vec_id": pa.array([i for _, i in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.float64())})

    return found.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
