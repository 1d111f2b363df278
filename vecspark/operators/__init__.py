"""Search, indexes, clustering, metrics and alignment on DataFrames."""

from vecspark.operators.clustering import KMeansParams
from vecspark.operators.dense import exact_knn
from vecspark.operators.embed import EMBEDDERS, KmerEmbedder, ProteinModel
from vecspark.operators.index import (
    INDEXES,
    HypercubeIndex,
    HypercubeParams,
    IvfFlatIndex,
    IvfFlatParams,
    IvfPqIndex,
    IvfPqParams,
    LshIndex,
    LshParams,
    Model,
    NeuralLshIndex,
    NeuralLshParams,
    PqParams,
    ProductQuantizer,
)
from vecspark.operators.metrics import recall_at_n

__all__ = [
    "EMBEDDERS",
    "INDEXES",
    "HypercubeIndex",
    "HypercubeParams",
    "IvfFlatIndex",
    "IvfFlatParams",
    "IvfPqIndex",
    "IvfPqParams",
    "KMeansParams",
    "KmerEmbedder",
    "LshIndex",
    "LshParams",
    "Model",
    "NeuralLshIndex",
    "NeuralLshParams",
    "PqParams",
    "ProductQuantizer",
    "ProteinModel",
    "exact_knn",
    "recall_at_n",
]
