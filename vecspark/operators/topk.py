"""Ranking with fixed ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Decimals that distances are rounded to before they are compared.
DECIMALS = 4


def top_k(rows: DataFrame, by: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in order, with their rank from 1.

    The filter on the row number becomes a group limit before and after the shuffle.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def nearest(distances: DataFrame, k: int) -> DataFrame:
    """query_id, rank, neighbor_id, l2_dist: the k nearest of rows (query_id, neighbor_id, l2_dist), ties to smaller ids."""
    return top_k(distances, ["query_id"], ["l2_dist", "neighbor_id"], k).select("query_id", "rank", "neighbor_id", "l2_dist")


def ranked_hits(hits: DataFrame, n: int) -> DataFrame:
    """The n hits of each query with the highest bit scores, in file order where equal."""
    return top_k(hits, ["qseqid"], [F.desc("bitscore"), "line_no"], n)


def best_per_subject(hits: DataFrame) -> DataFrame:
    """The hit of each query and subject with the highest bit score, the first one where equal."""
    return top_k(hits, ["qseqid", "sseqid"], [F.desc("bitscore"), "line_no"], 1).drop("rank")


def head(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in the order of a column."""
    if n <= 0:
        raise ValueError("n must be positive")
    return rows.orderBy(order).limit(n)


def train_sample(rows: DataFrame, key: str, n: int | None, seed: int = 1) -> DataFrame:
    """n rows without replacement (all, if null or fewer): the first ones by a digest of seed and key; the same in every run."""
    if n is None:
        return rows
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)
