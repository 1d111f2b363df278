"""Whole runs from files to files: embedding, search with its report, sweeps, analysis."""

from __future__ import annotations

import contextlib
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators import aligner, alignment
from vecspark.operators.embed import EMBEDDERS, ProteinModel, embed
from vecspark.plans import search
from vecspark.sources import fasta, hits, report, vectors
from vecspark.store import written


def model(name: str, device: str = "auto"):
    """An embedder by its name; other names are pretrained protein models."""
    made = EMBEDDERS.get(name, ProteinModel)
    return made(name, device) if made is ProteinModel else made()


def embed_file(spark: SparkSession, source: str, target: str, name: str = "kmer", batch_size: int = 8, device: str = "auto", overwrite: bool = False, rescue: str | None = None) -> int:
    """Embeds a FASTA file into a vector table (a target that ends in .parquet) or a numpy file; the number of records.

    Where a numpy file can't be written, what there is of it goes, the vectors are
    saved in the folder ``rescue``, if there is one, and the error is raised.
    """
    if not overwrite and os.path.exists(target):
        raise FileExistsError(target)
    records = written(fasta.read_fasta(spark, source, ordered=True), "records")
    n = records.count()
    if not n:
        raise ValueError(f"{source} has no records")
    # Records are embedded under their numbers, since ids may occur twice.
    named = embed(records.select(F.col("pos").cast("string").alias("id"), "sequence"), model(name, device), batch_size)
    rows = written(named.select(F.col("id").cast("long").alias("row_idx"), "embedding").join(records.select(F.col("pos").alias("row_idx"), "id"), "row_idx"), "embedded")
    rows = rows.select("row_idx", "id", "embedding")
    if target.endswith(".parquet"):
        vectors.write_table(rows, target, overwrite)
        return n
    try:
        vectors.write_numpy(rows, target)
    except OSError:
        with contextlib.suppress(OSError):
            os.remove(target)
        if rescue:
            os.makedirs(rescue, exist_ok=True)
            vectors.write_numpy(rows, os.path.join(rescue, os.path.basename(target)))
        raise
    return n


def _numbered(corpus: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """Hits with the numbers of queries and rows for their ids; subjects that aren't in the corpus have numbers below 0."""
    q = queries.select(F.col("id").alias("qseqid"), F.col("vec_id").alias("q"))
    x = corpus.select(F.col("id").alias("sseqid"), F.col("vec_id").alias("x"))
    other = -F.pmod(F.xxhash64("sseqid"), F.lit(1 << 62)) - 1
    both = found.join(F.broadcast(q) if queries.limit(100_001).count() <= 100_000 else q, "qseqid").join(x, "sseqid", "left")
    return both.select(F.col("q").alias("qseqid"), F.coalesce("x", other).alias("sseqid"), "pident", "bitscore", "evalue", "line_no")


def inputs(spark: SparkSession, data: str, queries: str, hits_path: str | None = None, targets: str | None = None, folder: str | None = None,
           name: str = "kmer", batch_size: int = 8, device: str = "auto", n: int = 50) -> tuple[DataFrame, DataFrame, DataFrame, float | None]:
    """The corpus, the queries, the numbered hits and the seconds that the ground truth took for a query.

    Hits come from a table, else from the external aligner over ``targets`` where
    it is installed, else from the built-in alignment.
    """
    corpus = vectors.read(spark, data).select(F.col("row_idx").alias("vec_id"), "id", "embedding")
    records = written(fasta.read_fasta(spark, queries, ordered=True), "queries")
    if records.isEmpty():
        raise ValueError(f"{queries} has no records")
    asked = embed(records, model(name, device), batch_size).join(records.select("id", F.col("pos").alias("vec_id")), "id")
    asked = written(asked.select("vec_id", "id", "embedding"), "asked")
    began = time.perf_counter()
    if hits_path:
        found, seconds = hits.read_hits(spark, hits_path), None
    elif targets:
        try:
            found = aligner.run(records, aligner.database(targets, folder or f"{os.path.dirname(targets) or '.'}/.db_cache"), n)
            found = written(found, "hits")
        except FileNotFoundError:
            everything = fasta.read_fasta(spark, targets, ordered=True)
            found = written(alignment.align(alignment.seed_candidates(records, everything, 3, 1), records, everything), "hits")
        seconds = (time.perf_counter() - began) / asked.count()
    else:
        raise ValueError("a table of hits or the sequences of the corpus are needed")
    return corpus, asked, written(_numbered(corpus, asked, found), "numbered"), seconds


def search_files(spark: SparkSession, data: str, queries: str, output: str, method: str = "all", n: int = 50, print_k: int = 10, seed: int = 1,
                 settings: dict | None = None, one_by_one: bool = False, **truth) -> dict[str, DataFrame]:
    """Searches, and writes the report; what ``search`` returns, with the files' ids."""
    corpus, asked, found, seconds = inputs(spark, data, queries, n=n, **truth)
    out = search.search(corpus, asked, found, method, n, print_k, seed=seed, settings=settings, reference_seconds=seconds, one_by_one=one_by_one)
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    x = corpus.select(F.col("vec_id").alias("neighbor_id"), F.col("id").alias("x"))
    named = out["neighbors"].join(q, "query_id").join(x, "neighbor_id").drop("query_id", "neighbor_id").withColumnsRenamed({"q": "query_id", "x": "neighbor_id"})
    summaries = out["summaries"].join(q, "query_id").drop("query_id").withColumnRenamed("q", "query_id")
    named = written(named, "named")
    text = report.report(summaries, named, n, print_k).join(asked.select(F.col("id").alias("query_id"), "vec_id"), "query_id")
    text.orderBy("vec_id").select("value").write.mode("overwrite").text(output)
    return {"summaries": summaries, "neighbors": named, "by_method": out["by_method"]}


def grid_files(spark: SparkSession, data: str, queries: str, output: str, grids: dict[str, dict[str, list]], n: int = 50, seed: int = 1, **truth) -> None:
    """Sweeps the methods of ``grids`` and writes one CSV with a column for each parameter."""
    corpus, asked, found, _ = inputs(spark, data, queries, n=n, **truth)
    rows, names = None, sorted({k for grid in grids.values() for k in grid})
    for method, grid in grids.items():
        one = search.grid_search(corpus, asked, found, method, grid, n, seed)
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("there is nothing to sweep")
    hits.write_csv(search.wide(rows, names), output, sort_columns=True)


def analyze_file(spark: SparkSession, source: str, folder: str, threshold: float = 30.0, not_in_top: bool = False) -> list[str]:
    """The three tables of a report."""
    summaries, neighbors = report.read_report(spark, source)
    return search.write_analysis(summaries, neighbors, folder, threshold, not_in_top)
