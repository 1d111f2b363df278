"""The text report of a search: one block for each query, written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.text import bare_id, columns_of, general, lenient_float, percent, yes

#: Fixed texts of the report's layout.
BAR = "\t|\t"
SUMMARY_HEADER = f"Method{BAR}Time/query (s){BAR}QPS{BAR}Recall@N vs BLAST Top-N"
NEIGHBOR_HEADER = f"Rank{BAR}Neighbor ID{BAR}L2 Dist{BAR}BLAST Identity{BAR}In BLAST Top-N?{BAR}Bio comment"
SUMMARY_TITLE = "[1] Συνοπτική σύγκριση μεθόδων"
NEIGHBOR_TITLE = "[2] Top-N γείτονες ανά μέθοδο (εδώ π.χ. N = %d για εκτύπωση)"
LIST_SIZE = "N = %d (μέγεθος λίστας Top-N για την αξιολόγηση Recall@N)"
REFERENCE_NOTE = "\t(ορίζει το Top-N)"
REFERENCE = "blast"


def summary_line(method: Column, seconds: Column, qps: Column, recall: Column) -> Column:
    note = F.when(F.startswith(F.lower(method), F.lit(REFERENCE)), F.lit(REFERENCE_NOTE)).otherwise(F.lit(""))
    return F.concat(F.concat_ws(BAR, method, F.format_string("%.3f", seconds), general(qps), F.format_string("%.2f", recall)), note)


def neighbor_line(rank: Column, neighbor: Column, dist: Column, identity: Column, in_top: Column, comment: Column) -> Column:
    top = F.when(in_top.isNull(), "-").when(in_top, "Yes").otherwise("No")
    shown = F.coalesce(F.nullif(F.btrim(comment), F.lit("")), F.lit("--"))
    return F.concat_ws(BAR, rank.cast("string"), F.concat(F.lit("<"), neighbor, F.lit(">")), F.format_string("%.2f", dist), percent(identity), top, shown)


def report(summaries: DataFrame, neighbors: DataFrame, recall_n: int, print_k: int) -> DataFrame:
    """(query_id, value): the block of each query.

    summaries: query_id, position, method, time_per_query_s, qps, recall_at_n.
    neighbors: query_id, position, method, rank, neighbor_id, l2_dist,
    blast_identity_pct, in_blast_top_n, bio_comment; printed ranks only.
    """
    line = summary_line(F.col("method"), F.col("time_per_query_s"), F.col("qps"), F.col("recall_at_n"))
    top = summaries.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda s: s["line"]), "\n").alias("summary"))
    row = neighbor_line(*(F.col(c) for c in ("rank", "neighbor_id", "l2_dist", "blast_identity_pct", "in_blast_top_n", "bio_comment")))
    blocks = neighbors.groupBy("query_id", "position", "method").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))
    block = F.concat(F.lit("Method: "), "method", F.lit(f"\n\n{NEIGHBOR_HEADER}\n"), "lines", F.lit("\n\n\n"))
    lists = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("block")))), lambda s: s["block"]), "").alias("blocks"))
    start = F.concat(F.lit("Query Protein: <"), F.col("query_id").cast("string"), F.lit(f">\n{LIST_SIZE % recall_n}\n\n{SUMMARY_TITLE}\n{SUMMARY_HEADER}\n"))
    both = top.join(lists, "query_id", "left")
    return both.select("query_id", F.concat(start, "summary", F.lit(f"\n\n\n{NEIGHBOR_TITLE % print_k}\n\n"), F.coalesce("blocks", F.lit(""))).alias("value"))


def parse_report(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries and neighbours of report text (value: whole files).

    A query's summary has the lines after the one with Method that have four
    columns or more, up to a blank one; each method's block the lines after its
    Rank header with six or more. Fields that hold no number are 0; a rank that
    is none is an error.
    """
    query = F.explode(F.slice(F.split("value", r"(?m)^Query Protein:"), 2, 1 << 30)).alias("block")
    q = text.select(query).select(F.regexp_extract("block", r"^\s*<([^>]+)>", 1).alias("query_id"), "block").where("query_id <> ''")
    first = F.regexp_extract("block", r"(?s)\n[^\n]*Method[^\n]*\n(.*?)(?:\n[ \t]*\n|$)", 1)
    lines = q.select("query_id", F.explode(F.transform(F.split(first, "\n"), columns_of)).alias("c")).where(F.size("c") >= 4)
    summaries = lines.select("query_id", F.col("c")[0].alias("method"), *(lenient_float(F.col("c")[i]).alias(n) for i, n in ((1, "time_per_query_s"), (2, "qps"), (3, "recall_at_n"))))
    parts = q.select("query_id", F.explode(F.slice(F.split("block", r"(?m)^Method:"), 2, 1 << 30)).alias("part"))
    body = F.regexp_extract("part", r"(?s)\n[ \t]*Rank[^\n]*\n(.*?)(?:\n[ \t]*\n|$)", 1)
    parts = parts.select("query_id", F.btrim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("method"), body.alias("body"))
    n = parts.select("query_id", "method", F.explode(F.transform(F.split("body", "\n"), columns_of)).alias("c")).where(F.size("c") >= 6)
    neighbors = n.select(
        "query_id", "method", F.col("c")[0].cast("int").alias("rank"), bare_id(F.col("c")[1]).alias("neighbor_id"), lenient_float(F.col("c")[2]).alias("l2_dist"),
        lenient_float(F.col("c")[3]).alias("blast_identity_pct"), yes(F.col("c")[4]).alias("in_blast_top_n"), F.col("c")[5].alias("bio_comment"),
    )
    return summaries, neighbors


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_report(spark.read.text(path, wholetext=True))
