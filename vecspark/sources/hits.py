"""Alignment hits in tabular text, and result tables in CSV."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {"qseqid": "string", "sseqid": "string", "pident": "double", "bitscore": "double", "evalue": "double"}


def parsed(value: Column, line_no: Column) -> list[Column]:
    """The five fields of a hit line and its number."""
    f = F.split(F.btrim(value), "\t")
    return [*(F.get(f, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(FIELDS.items())), line_no.alias("line_no")]


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """qseqid, sseqid, pident, bitscore, evalue and line_no of hit files; lines of under five fields are skipped, further fields ignored."""
    lines = spark.read.text(path).where((F.btrim("value") != "") & (F.size(F.split(F.btrim("value"), "\t")) >= 5))
    return lines.select(*parsed(F.col("value"), F.monotonically_increasing_id()))


def write_csv(rows: DataFrame, path: str, formats: dict[str, str] | None = None, sort_columns: bool = False) -> None:
    """Writes a small result table as one CSV file with a header.

    formats: printf patterns by column; Booleans become Yes or No. With
    sort_columns the header is in the order of names.
    """
    out = []
    for name, kind in sorted(rows.dtypes) if sort_columns else rows.dtypes:
        c = F.col(name)
        if kind == "boolean":
            c = F.when(c, "Yes").otherwise("No")
        elif formats and name in formats:
            c = F.format_string(formats[name], c)
        out.append(c.alias(name))
    rows.select(*out).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """method, qps and recall of grid results."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select("method", F.col("qps").cast("double").alias("qps"), F.col("avg_recall").cast("double").alias("recall"))


def read_grids(spark: SparkSession, paths: list[str], exists=os.path.exists) -> DataFrame | None:
    """The rows of all grid files that exist and hold rows, or None; the others are warned of and passed over."""
    out = None
    for p in paths:
        own = read_grid(spark, p) if exists(p) else None
        if own is None or own.isEmpty():
            warnings.warn(f"{p} {'does not exist' if own is None else 'has no rows'}", stacklevel=2)
            continue
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
