"""Sequences to vectors: any embedder that maps a list of strings to a matrix, run on Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.text import MAX_RESIDUES, truncate


@dataclass(frozen=True)
class KmerEmbedder:
    """Mean of hashed k-mer vectors with unit length; a stand-in that needs no weights, the same everywhere."""

    dim: int = 320
    k: int = 3

    def __call__(self, sequences: list[str]) -> np.ndarray:
        """Each distinct k-mer of the batch is hashed once."""
        out = np.zeros((len(sequences), self.dim))
        letters = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in sequences]
        for row, x in zip(out, letters, strict=True):
            if len(x) < self.k:
                continue
            mers, n = np.unique(np.lib.stride_tricks.sliding_window_view(x, self.k), axis=0, return_counts=True)
            h = np.array([zlib.crc32(m.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")) for m in mers], np.uint32)
            np.add.at(row, h % self.dim, np.where(h & np.uint32(0x80000000), n, -n))
            row /= np.sqrt((row * row).sum()) or 1.0
        return out.astype(np.float32)


def device(name: str = "auto") -> str:
    """``cpu`` or ``cuda``: what is asked for, or for ``auto`` what there is."""
    if name not in ("auto", "cpu", "cuda"):
        raise ValueError("the device must be auto, cpu or cuda")
    if name == "cpu":
        return name
    try:
        import torch

        there = torch.cuda.is_available()
    except ImportError:
        there = False
    if name == "cuda" and not there:
        raise ValueError("there is no cuda device")
    return "cuda" if there else "cpu"


class ProteinModel:
    """Means of the last layer's token vectors of a pretrained protein model, by the ``esm`` package where it is installed.

    The model is loaded where the first batch is embedded, so it isn't sent to the tasks.
    """

    def __init__(self, name: str = "esm2_t6_8M_UR50D", device: str = "auto"):
        self.name, self.device, self._loaded = name, device, None

    def __getstate__(self):
        return {"name": self.name, "device": self.device, "_loaded": None}

    def _load(self):
        if self._loaded is None:
            import esm

            model, alphabet = getattr(esm.pretrained, self.name)()
            self._loaded = model.eval().to(device(self.device)), alphabet, alphabet.get_batch_converter()
        return self._loaded

    def __call__(self, sequences: list[str]) -> np.ndarray:
        import torch

        model, alphabet, convert = self._load()
        _, _, tokens = convert([(str(i), s) for i, s in enumerate(sequences)])
        with torch.no_grad():
            found = model(tokens.to(device(self.device)), repr_layers=[model.num_layers], return_contacts=False)
        special = torch.zeros_like(tokens, dtype=torch.bool)
        for mark in (alphabet.padding_idx, alphabet.cls_idx, alphabet.eos_idx):
            special |= tokens == mark
        vectors = found["representations"][model.num_layers].float().cpu().numpy()
        return masked_mean(vectors, ~special.cpu().numpy()).astype(np.float32)


#: Names of models and what makes them; others can be registered.
EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {"kmer": KmerEmbedder, "esm2_t6_8M_UR50D": ProteinModel}


def embedder(name: str) -> Callable[[list[str]], np.ndarray]:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown model {name!r}: one of {', '.join(EMBEDDERS)}")
    return EMBEDDERS[name]()


def masked_mean(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means over tokens (sequences x tokens x components) where the mask is set; of none, zeros."""
    m = mask.astype(tokens.dtype)[:, :, None]
    return (tokens * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)


def batched(items: list, n: int) -> Iterable[list]:
    if n <= 0:
        raise ValueError("the batch size must be positive")
    return (items[i : i + n] for i in range(0, len(items), n))


def embed(records: DataFrame, model: str | Callable = "kmer", batch_size: int = 8, residues: int = MAX_RESIDUES) -> DataFrame:
    """(id, embedding) of records (id, sequence), normalised and cut to ``residues``; the model is made once a task."""
    if batch_size <= 0:
        raise ValueError("the batch size must be positive")
    make = (lambda: embedder(model)) if isinstance(model, str) else (lambda: model)

    def run(batches):
        f = make()
        for batch in batches:
            ids, seqs = batch.column("id"), batch.column("sequence").to_pylist()
            for at, own in enumerate(batched(seqs, batch_size)):
                x = np.asarray(f(own), np.float32)
                lists = pa.array(list(x), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([ids.slice(at * batch_size, len(own)), lists], ["id", "embedding"])

    return records.select("id", truncate(F.col("sequence"), residues).alias("sequence")).mapInArrow(run, "id string, embedding array<float>")


def pooled(tokens: DataFrame) -> DataFrame:
    """(id, embedding): the mean of the vectors of unmasked tokens, from (id, token, mask, vector); without any, zeros."""
    long = tokens.select("id", F.col("mask").cast("double").alias("m"), F.posexplode("vector").alias("p", "x"))
    by = long.groupBy("id", "p").agg((F.sum(F.col("x") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1.0))).alias("x"))
    return by.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("embedding"))
