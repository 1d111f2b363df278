"""k-means: means by label, Lloyd steps with a fixed start, and the distributed estimator."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.vectors import as_vector
from vecspark.operators.dense import collect_vectors, rows_of, squared
from vecspark.operators.topk import train_sample


@dataclass(frozen=True)
class KMeansParams:
    k: int
    max_iter: int = 30
    tol: float = 1e-4
    seed: int = 1
    train_size: int | None = None

    def __post_init__(self):
        if self.k <= 0:
            raise ValueError("k must be positive")
        if self.max_iter < 0 or self.tol < 0:
            raise ValueError("max_iter and tol must not be negative")


def means(rows: DataFrame, label: str) -> DataFrame:
    """(cluster_id, centroid, n): the mean vector of each label. Sums are taken by component before the shuffle."""
    long = rows.select(F.col(label).cast("int").alias("cluster_id"), F.posexplode(as_vector("embedding")).alias("p", "x"))
    by = long.groupBy("cluster_id", "p").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return by.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("n"))


def assigned_means(rows: DataFrame, centroids: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(cluster_id, centroid): the means of the rows nearest to each centroid.

    A task sums up its rows by centroid, so a row for each centroid and task is shuffled.
    """
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        names, c = sent.value
        total, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column("v"))
                at = np.argmin(np.round(squared(x, c), 10), axis=1)
                np.add.at(total, at, x)
                n += np.bincount(at, minlength=len(c))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(names[some].astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64())), pa.array(n[some])], ["cluster_id", "total", "n"])

    sums = rows.select(as_vector("embedding").alias("v")).mapInArrow(run, "cluster_id int, total array<double>, n long")
    each = sums.select("cluster_id", "n", F.posexplode("total").alias("p", "x")).groupBy("cluster_id", "p").agg((F.sum("x") / F.sum("n")).alias("x"))
    return each.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centroid"))


def centroid_table(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (cluster_id, centroid) on the driver: as many rows as there are clusters."""
    return collect_vectors(centroids, "cluster_id", "centroid")


def lloyd(rows: DataFrame, params: KMeansParams) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after at most max_iter steps from the k vectors with the least ids.

    Each step assigns the rows and takes means on the executors; only the k
    centroids come to the driver. An empty cluster keeps its centroid. The steps
    end when no centroid moves by more than tol.
    """
    start = rows.orderBy("vec_id").limit(params.k)
    _, c = collect_vectors(start)
    if len(c) < params.k:
        raise ValueError("k is larger than the number of vectors")
    return _steps(rows, c, range(params.max_iter), params.tol)


def settled(rows: DataFrame, centroids: tuple[np.ndarray, np.ndarray], tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after as many steps from these as it takes until none moves by more than tol.

    No step makes the spread larger and there are finitely many assignments, so the steps end.
    """
    own = rows.select("vec_id", "embedding").persist()
    try:
        return _steps(own, centroids[1], itertools.count(), tol)
    finally:
        own.unpersist()


def _steps(rows: DataFrame, c: np.ndarray, steps: Iterable[int], tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after these steps, or fewer if no centroid moves by more than tol."""
    names = np.arange(len(c))
    for _ in steps:
        ids, new = centroid_table(assigned_means(rows, (names, c)))
        moved = c.copy()
        moved[ids] = new
        shift = float(np.sqrt(((moved - c) ** 2).sum(axis=1)).max())
        c = moved
        if shift <= tol:
            break
    return names, c


def fit(rows: DataFrame, params: KMeansParams, column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the distributed estimator (k-means|| start), fitted to a sample if train_size is given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    train = train_sample(rows, "vec_id", params.train_size, params.seed).select(array_to_vector(as_vector(column)).alias("features"))
    train = train.persist()
    try:
        if train.count() < params.k:
            raise ValueError("k is larger than the number of vectors")
        model = KMeans(k=params.k, maxIter=params.max_iter, tol=params.tol, seed=params.seed).fit(train)
        centres = np.array(model.clusterCenters())
    finally:
        train.unpersist()
    return np.arange(len(centres)), centres
