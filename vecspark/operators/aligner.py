"""Ground truth by an external aligner: its programs, its database, and runs of it on the executors.

The programs must be on the path of every machine, the database in a folder that
all of them share. Queries go in and hits come out through pipes, so no task
leaves a file.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.text import normalise

#: The fields of a hit line, as the program is asked for them.
FIELDS = "qseqid sseqid pident bitscore evalue"


def program(name: str) -> str:
    """Where a program is; a missing one is an error."""
    if not (found := shutil.which(name)):
        raise FileNotFoundError(f"the program {name} is not installed")
    return found


def database(fasta: str, folder: str, maker: str = "makeblastdb") -> str:
    """The database of a FASTA file in a shared folder; made again when the file's content is another."""
    with open(fasta, "rb") as file:
        name = hashlib.file_digest(file, "sha256").hexdigest()[:16]
    path = os.path.join(folder, name)
    if not os.path.exists(f"{path}.done"):
        os.makedirs(folder, exist_ok=True)
        subprocess.run([program(maker), "-in", fasta, "-dbtype", "prot", "-out", path], check=True, capture_output=True)
        with open(f"{path}.done", "w", encoding="utf-8") as file:
            file.write(f"{fasta}\n")
    return path


def run(queries: DataFrame, path: str, n: int = 50, evalue: float = 1e6, aligner: str = "blastp", parts: int | None = None) -> DataFrame:
    """qseqid, sseqid, pident, bitscore, evalue, line_no of queries (id, sequence), each query's hits in the program's order.

    Empty sequences have no hits; a program that fails is an error.
    """
    command = ["-db", path, "-outfmt", f"6 {FIELDS}", "-max_target_seqs", str(n), "-evalue", f"{evalue:g}"]

    def search(batches):
        for batch in batches:
            text = "".join(f">{i}\n{s}\n" for i, s in zip(batch.column("id").to_pylist(), batch.column("s").to_pylist(), strict=True))
            if not text:
                continue
            done = subprocess.run([program(aligner), *command], input=text, capture_output=True, text=True)
            if done.returncode:
                raise RuntimeError(f"{aligner} failed: {done.stderr[-500:]}")
            lines = [f for line in done.stdout.splitlines() if len(f := line.strip().split("\t")) >= 5]
            columns = [[f[i] if i < 2 else float(f[i]) for f in lines] for i in range(5)]
            kinds = [pa.string()] * 2 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(range(len(lines)), pa.int64())], [*FIELDS.split(), "line_no"])

    plain = queries.select("id", normalise(F.col("sequence")).alias("s")).where("s <> ''")
    plain = plain.repartition(parts, "id") if parts else plain
    return plain.mapInArrow(search, "qseqid string, sseqid string, pident double, bitscore double, evalue double, line_no long")
