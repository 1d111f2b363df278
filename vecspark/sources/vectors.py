"""Vector stores: Parquet tables, and numpy files with an id list beside them."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "row_idx long, id string, embedding array<float>"


def read_ids(path: str) -> list[str]:
    """The ids of a list, one a line, without blank lines; none is an error."""
    with open(path, encoding="utf-8") as file:
        ids = [x.strip() for x in file if x.strip()]
    if not ids:
        raise ValueError(f"{path} has no ids")
    return ids


def _ids_for(path: str, legacy: bool) -> str:
    for p in (os.path.join(os.path.dirname(path), "ids.txt"), *([f"{path}.ids.txt"] if legacy else [])):
        if os.path.exists(p):
            return p
    raise FileNotFoundError(f"no ids for {path}")


def read_numpy(spark: SparkSession, path: str, ids_path: str | None = None) -> DataFrame:
    """(row_idx, id, embedding) of an NPY file of any name, or of an NPZ file with ``vectors`` and perhaps ``ids``.

    Ids come from ``ids_path``, else the archive, else ids.txt beside the file,
    else (NPY only) <file>.ids.txt. These files are interchange of driver size.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    loaded = np.load(path, allow_pickle=False)
    if isinstance(loaded, np.lib.npyio.NpzFile):
        if "vectors" not in loaded:
            raise ValueError(f"{path} has no array 'vectors'")
        x, own = loaded["vectors"], [str(i) for i in loaded["ids"]] if "ids" in loaded else None
        ids = read_ids(ids_path) if ids_path else own or read_ids(_ids_for(path, False))
    else:
        x, ids = loaded, read_ids(ids_path or _ids_for(path, True))
    return from_numpy(spark, x, ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, id, embedding) of a vector table or a numpy file."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_numpy(spark, path)


def from_numpy(spark: SparkSession, x: np.ndarray, ids: list[str]) -> DataFrame:
    x = np.asarray(x, np.float32)
    if x.ndim != 2:
        raise ValueError("vectors must be two-dimensional")
    if len(x) != len(ids):
        raise ValueError(f"{len(x)} vectors and {len(ids)} ids")
    table = pa.table({"row_idx": np.arange(len(x)), "id": pa.array(ids, pa.string()), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    return spark.createDataFrame(table, schema=SCHEMA)


def write_numpy(rows: DataFrame, path: str) -> str:
    """Writes (row_idx, id, embedding) as one NPY file at the path, with ids.txt beside it, row by row."""
    n = rows.count()
    first = rows.select(F.size("embedding").alias("d")).first()
    d = first.d if first else 0
    if rows.where((F.size("embedding") != d) | F.col("id").isNull()).count():
        raise ValueError("vectors must have one length, and ids")
    out = np.lib.format.open_memmap(path, mode="w+", dtype=np.float32, shape=(n, d))
    with open(os.path.join(os.path.dirname(path), "ids.txt"), "w", encoding="utf-8") as ids:
        for i, r in enumerate(rows.orderBy("row_idx").select("id", "embedding").toLocalIterator()):
            out[i] = r.embedding
            ids.write(f"{r.id}\n")
    out.flush()
    return path


def write_table(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes a vector table as Parquet; an existing one is an error unless ``overwrite``."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_id_list(ids: DataFrame, path: str) -> None:
    """Writes the ids of column ``id``, stripped and without blanks, one a line."""
    ids.select(F.btrim("id").alias("value")).where("value <> ''").write.mode("overwrite").text(path)
