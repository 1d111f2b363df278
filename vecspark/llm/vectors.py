"""What the two vector searches share: clean vectors, blocks of queries, and the merge of shards.

Queries go through the data in blocks of at most about ``BLOCK_BYTES``. A block
is prepared once, on the driver, broadcast, and its results are written before
the next one starts. Rows are dealt to shards of about ``SHARD`` by a hash of
their ids, so what a shard holds doesn't depend on how the table comes; the best
of each shard are ranked together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vecspark.llm.shared import Stage

BLOCK_BYTES, SHARD = 1 << 24, 8192


def clean(rows: DataFrame, zero: bool) -> tuple[DataFrame, int, int]:
    """(vec_id, embedding array<double>) that can take part, their dimension (0: no rows) and their number.

    Left out are null vectors, those with null, infinite or NaN components,
    those without a vec_id, those of another size than most have (of equally
    frequent sizes the smallest), and, unless ``zero``, those of zeros only.
    """
    ok = F.forall("embedding", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    some = F.exists("embedding", lambda x: x != 0)
    v = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    v = v if zero else v.where(some)
    size = v.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    return (v.where(F.size("embedding") == size.d), size.d, size["count"]) if size else (v.where(F.lit(False)), 0, 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def searched(data: DataFrame, d: int, n: int, step: int, k: int, score: str, prepare: Callable, shard: Callable, name: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose vec_id is divisible by ``step``, of n rows.

    ``prepare(query_ids, queries)`` is what is sent of a block, and ``shard(ids,
    x, prepared)`` yields, for a shard's rows, (query_id, ids, scores) of the best
    for each query. Rows with the query's own vec_id are not its candidates.
    """
    spark, stage = data.sparkSession, Stage(data.sparkSession, name)
    queries = data.where(F.pmod("vec_id", F.lit(step)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    schema = f"query_id long, vec_id long, score {score}"
    found = spark.createDataFrame([], schema)
    if d:
        queries = stage.write(queries, "asked")
        blocks = -(-queries.count() * 8 * d // BLOCK_BYTES)
        queries = stage.write(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))).cast("int")), "queries", by="block")
        stage.drop("asked")
        shards = -(-n // SHARD)
        parts = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 16))
        data = data.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))
        data = data.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "vec_id", "embedding")
        if blocks > 1:  # dealt once for all blocks
            data = data.persist(StorageLevel.DISK_ONLY)
    for b in range(blocks if d else 0):
        block = queries.where(F.col("block") == b).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        sent = spark.sparkContext.broadcast(prepare(block.column("vec_id").to_numpy(), matrix(block.column("embedding").combine_chunks(), d)))

        def run(batches, sent=sent):
            prepared = sent.value

            def answers(held):
                ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                out = [(np.full(len(i), q), i, s) for q, i, s in shard(ids, x, prepared)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

            held, number = [], None  # the pieces of the last shard, which may go on in the next batch
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), batch.num_rows]
                for a, e in zip(cuts, cuts[1:], strict=False):
                    if held and own[a] != number:
                        yield from answers(held)
                        held = []
                    piece, number = batch.slice(a, e - a), own[a]
                    held.append((piece.column("vec_id").to_numpy(), matrix(piece.column("embedding"), d)))
            if held:
                yield from answers(held)

        own = stage.write(data.select("shard", "vec_id", "embedding").mapInArrow(run, schema), f"block{b}")
        found = found.unionByName(own)
        sent.unpersist()
    if d and blocks > 1:
        data.unpersist()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
