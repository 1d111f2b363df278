"""Dense distance work in numpy, on Arrow batches: exact k-NN, nearest centroids, product codes.

What is sent to the tasks is bounded: a block of queries, the centroids, the codebooks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.vectors import as_vector
from vecspark.operators.topk import DECIMALS, nearest

#: Queries that are sent to the tasks at a time, and distances that a task holds.
BLOCK, PIECE = 4096, 1 << 22


def rows_of(column: pa.Array) -> np.ndarray:
    """The vectors of a column as a matrix of doubles; they must have one length."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n and (column.null_count or len(flat) % n or (np.diff(column.offsets.to_numpy()) != len(flat) // n).any()):
        raise ValueError("vectors must have one length and not be null")
    return flat.reshape(n, -1 if n else 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows x to rows c, by |x|^2 + |c|^2 - 2 x.c, not below 0."""
    return np.maximum(np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", c, c) - 2 * (x @ c.T), 0)


def collect_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a small table, on the driver, in the order of ids."""
    table = rows.select(F.col(id_col).alias("id"), as_vector(vector).alias("v")).toArrow().sort_by("id").combine_chunks()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return table.column("id").to_numpy(), rows_of(table.column("v").combine_chunks())


def _closer(best: tuple, worst: np.ndarray, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool) -> tuple:
    """The k nearest of each query among ``best`` and rows x; ``worst`` is kept up to date.

    Distances by expansion choose the rows whose own distances are then taken.
    """
    near = np.sqrt(squared(x, q))
    if exclude_self:
        near[ids[:, None] == query_ids] = np.inf
    last = np.partition(near, k - 1, axis=0)[k - 1] if len(x) > k else np.full(len(q), np.inf)
    rows, at = np.nonzero((near <= np.minimum(last, worst) + 2 * 10.0**-DECIMALS) & np.isfinite(near))
    d = np.empty(len(rows))
    for a in range(0, len(rows), PIECE // 64):
        own = slice(a, a + PIECE // 64)
        diff = x[rows[own]] - q[at[own]]
        d[own] = np.round(np.sqrt(np.einsum("ij,ij->i", diff, diff)), DECIMALS)
    at, names, d = (np.concatenate(c) for c in zip(best, (at, ids[rows], d), strict=True))
    order = np.lexsort((names, d, at))
    at, names, d = at[order], names[order], d[order]
    first = np.searchsorted(at, np.arange(len(q)))
    rank = np.arange(len(at)) - first[at]
    full = np.flatnonzero(rank == k - 1)
    worst[at[full]] = d[full]
    return at[rank < k], names[rank < k], d[rank < k]


def exact_knn(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """query_id, rank, neighbor_id, l2_dist: the k nearest of the corpus, by full scan.

    Both sides are (vec_id, embedding). Queries are sent in blocks; each task
    keeps the k nearest of its rows for each query, and those are ranked.
    Distances are rounded to DECIMALS before they are compared.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = corpus.sparkSession
    count = queries.count()
    parts = max(1, -(-count // block))
    plain = corpus.select("vec_id", as_vector("embedding").alias("embedding"))
    found = None
    for b in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == b)
        sent = spark.sparkContext.broadcast(collect_vectors(own))

        def run(batches, sent=sent):
            query_ids, q = sent.value
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query number, id, distance
            worst = np.full(len(query_ids), np.inf)
            for batch in batches:
                if not batch.num_rows or not len(query_ids):
                    continue
                ids, x = batch.column("vec_id").to_numpy(), rows_of(batch.column("embedding"))
                step = max(1, PIECE // len(query_ids))
                for a in range(0, len(x), step):
                    best = _closer(best, worst, ids[a : a + step], x[a : a + step], query_ids, q, k, exclude_self)
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "neighbor_id", "l2_dist"])

        one = plain.mapInArrow(run, "query_id long, neighbor_id long, l2_dist double")
        found = one if found is None else found.unionByName(one)
    return nearest(found, k)


def nearest_centroids(rows: DataFrame, centroids: tuple[np.ndarray, np.ndarray], n: int = 1, id_col: str = "vec_id") -> DataFrame:
    """(id, probe_rank, cluster_id): the n nearest centroids of each row, ties to smaller ids."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        names, c = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            d = squared(rows_of(batch.column("v")), c)
            order = np.argsort(np.round(d, 10), axis=1, kind="stable")[:, :n]
            m = order.shape[1]
            ids = np.repeat(batch.column("id").to_numpy(), m)
            ranks = np.tile(np.arange(1, m + 1, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ranks), pa.array(names[order.ravel()].astype(np.int32))], ["id", "probe_rank", "cluster_id"])

    plain = rows.select(F.col(id_col).alias("id"), as_vector("embedding").alias("v"))
    return plain.mapInArrow(run, "id long, probe_rank int, cluster_id int").withColumnRenamed("id", id_col)


def product_codes(rows: DataFrame, books: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """(id, codes array<int>): the nearest codeword of each part; ``books`` is parts x codewords x components."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        b = sent.value
        parts, _, size = b.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column("v"))
            if x.shape[1] != parts * size:
                raise ValueError(f"vectors must have {parts * size} components")
            codes = np.stack([np.argmin(np.round(squared(x[:, m * size : (m + 1) * size], b[m]), 12), axis=1) for m in range(parts)], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "codes"])

    plain = rows.select(F.col(id_col).alias("id"), as_vector("embedding").alias("v"))
    return plain.mapInArrow(run, "id long, codes array<int>").withColumnRenamed("id", id_col)
