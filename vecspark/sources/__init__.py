"""Readers and writers: sequences, vectors, alignment hits, reports and result tables."""

from vecspark.sources.fasta import count_records, read_fasta, write_fasta
from vecspark.sources.hits import read_grid, read_grids, read_hits, write_csv
from vecspark.sources.report import parse_report, read_report
from vecspark.sources.vectors import read_numpy, write_numpy, write_table

__all__ = ["count_records", "parse_report", "read_fasta", "read_grid", "read_grids", "read_hits", "read_numpy", "read_report", "write_csv", "write_fasta", "write_numpy", "write_table"]
