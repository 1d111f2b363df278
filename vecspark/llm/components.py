"""Connected components of a table of links, by alternating stars.

A large star links every larger neighbour of a node to the least of its
neighbourhood, a small star every smaller one; when neither changes a link,
each node is linked to the least node of its component. Each step is a grouped
minimum, which is summed up before the shuffle, and a join that skewed nodes may
be split in. Links are kept in tables between steps, none come to the driver.
Once there are at most ``FEW`` links they are finished by one task, which holds
those and no more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import Stage

#: Links that one task may finish: 16 bytes each.
FEW = 1 << 19


def _least(pairs: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(w, m): the least v of each u. Written, so that the join back can be split at nodes with many links."""
    return stage.write(pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), name)


def _large_star(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, stage, name).select("w", F.least("w", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    joined = links.join(_least(links, stage, name), F.col("u") == F.col("w"))
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, least = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(least[u], least[v]), np.maximum(least[u], least[v])
        open_ = low != high
        u, v = u[open_], v[open_]
        np.minimum.at(least, high[open_], low[open_])
        while (further := least[least] != least).any():
            least[further] = least[least[further]]
    return nodes, nodes[least]


def _finished(links: DataFrame) -> DataFrame:
    """Each node of few links (u, v) linked to the least of its component."""

    def run(batches):
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if held:
            nodes, least = roots(*map(np.concatenate, zip(*held, strict=True)))
            own = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(least[own])], ["u", "v"])

    return links.select("u", "v").repartition(1).mapInArrow(run, "u long, v long")


def components(links: DataFrame, stage: Stage, name: str = "links") -> DataFrame:
    """(id, component) of every node of links (a, b): the least id reachable. Nulls and loops link nothing."""
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = stage.write(links.distinct(), f"{name}0")
    seen, k = None, 0
    while True:
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now.n == 0 or tuple(now) == seen:
            break
        if now.n <= FEW:
            links = stage.write(_finished(links), f"{name}_finished")
            break
        seen, k = tuple(now), k + 1
        large = stage.write(_large_star(links, stage, f"{name}{k}a"), f"{name}{k}b")
        links = stage.write(_small_star(large, stage, f"{name}{k}c"), f"{name}{k}")
        stage.drop(f"{name}{k - 1}", *(f"{name}{k}{x}" for x in "abc"))
    nodes = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
