"""FASTA text: read, count, write."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.text import wrapped


def records(text: Column) -> Column:
    """An array of (id, sequence) from the text of a whole file.

    Lines are stripped and blank ones skipped. A line that begins with > starts
    a record, whose id is the first word after it; what comes before the first
    one is dropped. Sequences lose inner spaces and come in upper case; a record
    may have none. A header without an id is an error.
    """
    lines = F.filter(F.transform(F.split(text, r"\r?\n|\r"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c"))), lambda x: x != "")
    joined = F.array_join(F.transform(lines, lambda x: F.when(F.startswith(x, F.lit(">")), F.concat(F.lit("\x01"), F.substr(x, F.lit(2)), F.lit("\x02"))).otherwise(x)), "")
    blocks = F.filter(F.slice(F.split(joined, "\x01"), 2, 1 << 30), lambda b: F.contains(b, F.lit("\x02")))

    def record(block: Column) -> Column:
        name = F.regexp_extract(F.substring_index(block, "\x02", 1), r"^\s*(\S+)", 1)
        body = F.upper(F.replace(F.substring_index(block, "\x02", -1), F.lit(" "), F.lit("")))
        checked = F.when(name != "", name).otherwise(F.raise_error(F.lit("a FASTA header has no id")).cast("string"))
        return F.struct(checked.alias("id"), body.alias("sequence"))

    return F.transform(blocks, record)


def read_fasta(spark: SparkSession, path: str, strict: bool = False, ordered: bool = False) -> DataFrame:
    """(id, sequence) of FASTA files, with ``ordered`` also pos: numbers in the order of files and records, with gaps.

    Files are cut at line starts with >, so one large file is read by many
    tasks. ``strict`` reads each file as a whole, which also finds headers
    behind white space.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    # The number within a partition is taken for every row, before any row is looked at.
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")
    if strict:
        whole = spark.read.text(path, wholetext=True).select("value", *place, at)
    else:
        # A cut-off record has lost its >, but for the first one of a file, which may follow other text.
        piece = spark.read.option("lineSep", "\n>").text(path).select("value", *place, at)
        first = F.regexp_extract(F.concat(F.lit("\n"), "value"), r"(?s)\n(>.*)", 1)
        has_mark = F.startswith("value", F.lit(">"))
        head = (F.col("block") == 0) & (F.col("at") == 0)
        whole = piece.select(F.when(has_mark, F.col("value")).when(head, first).otherwise(F.concat(F.lit(">"), "value")).alias("value"), "file", "block", "at")
    found = whole.select("file", "block", "at", F.posexplode(records(F.col("value"))).alias("n", "r"))
    if not ordered:
        return found.select("r.id", "r.sequence")
    return number(found.select("r.id", "r.sequence", "file", "block", "at", "n"), ["file", "block", "at", "n"])


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with pos, a number that grows in the order of columns and takes their place.

    Rows are sorted over ranges and numbered within each, so no task holds all.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.withColumn("pos", F.monotonically_increasing_id()).drop(*order)


def count_records(spark: SparkSession, path: str) -> int:
    """The number of lines that begin with >, as they stand."""
    return spark.read.text(path).where(F.startswith("value", F.lit(">"))).count()


def fasta_text(rows: DataFrame, width: int = 60) -> DataFrame:
    """(id, value): a record's lines, the sequence without spaces and in lines of ``width``."""
    seq = F.replace(F.btrim("sequence"), F.lit(" "), F.lit(""))
    return rows.select("id", F.concat(F.lit(">"), "id", F.when(seq != "", F.concat(F.lit("\n"), wrapped(seq, width))).otherwise(F.lit(""))).alias("value"))


def write_fasta(rows: DataFrame, path: str, order: str = "id", width: int = 60) -> None:
    """One folder of FASTA text, in order of a column within and across its files."""
    text = fasta_text(rows, width) if order == "id" else fasta_text(rows.orderBy(order), width)
    (text.orderBy("id") if order == "id" else text).select("value").write.mode("overwrite").text(path)


def subset(spark: SparkSession, source: str, target: str, n: int) -> int:
    """Writes the first n records of a FASTA file, in file order; n below 1 or no records are errors."""
    if n <= 0:
        raise ValueError("n must be positive")
    first = read_fasta(spark, source, ordered=True).orderBy("pos").limit(n)
    count = first.count()
    if not count:
        raise ValueError(f"{source} has no records")
    fasta_text(first).select("value").coalesce(1).write.mode("overwrite").text(target)
    return count


def resolved(path: str | None, default: str, exists=os.path.exists) -> str:
    """The path, or the default where it is missing; neither is an error."""
    for p in (path, default):
        if p and exists(p):
            return p
    raise FileNotFoundError(f"neither {path} nor {default} exists")
