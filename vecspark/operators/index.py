"""The indexes: fit makes a model of plain tables, search answers a batch of queries.

An index knows only how to file rows under buckets (``postings``) and which
buckets a query opens, in which order (``probes``). The join of the two, the
removal of doubles, the exact distances and the ranking are common. Postings
are written when an index is fitted, so that a search hashes or assigns its
queries only.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.vectors import as_vector, drawn_bit, l2, l2_squared, pack_bits, projection, sub_vector, valid
from vecspark.operators import clustering
from vecspark.operators.clustering import KMeansParams
from vecspark.operators.dense import collect_vectors, exact_knn, nearest_centroids, product_codes, rows_of, squared
from vecspark.operators.network import Network
from vecspark.operators.topk import DECIMALS, nearest, top_k
from vecspark.store import written

#: Bytes up to which the side of the queries of a join is broadcast.
BROADCAST_BYTES = 1 << 25


def _small(queries: DataFrame, row_bytes: int) -> DataFrame:
    """Marked for broadcast if there are counted to be few enough rows of so many bytes; beyond it the join shuffles."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(queries) if queries.limit(most + 1).count() <= most else queries


def _positive(**values) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def dimension(corpus: DataFrame, empty: int | None = None) -> int:
    """The number of components of the corpus's vectors; an empty corpus is an error, unless a number is given for it."""
    row = corpus.select(F.size("embedding").alias("d")).first()
    if row is None and empty is None:
        raise ValueError("the corpus is empty")
    return row.d if row else empty


def distances(candidates: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, neighbor_id, l2_dist) of candidate pairs (query_id, vec_id); vectors of another size than the queries' are an error."""
    d = dimension(queries, 0)
    if d and dimension(corpus, d) != d:
        raise ValueError("vectors of queries and corpus differ in length")
    sized = (lambda v: valid(v, d)) if d else (lambda v: v)
    q = queries.select(F.col("vec_id").alias("query_id"), sized(as_vector("embedding")).alias("qv"))
    x = corpus.select("vec_id", sized(as_vector("embedding")).alias("xv"))
    both = candidates.join(x, "vec_id").join(_small(q, 8 * d + 16), "query_id")
    return both.select("query_id", F.col("vec_id").alias("neighbor_id"), F.round(l2(F.col("qv"), F.col("xv")), DECIMALS).alias("l2_dist"))


@dataclass
class Model:
    """A fitted index."""

    corpus: DataFrame
    postings: DataFrame  # bucket, vec_id

    def probes(self, queries: DataFrame) -> DataFrame:
        """(query_id, bucket, probe_rank)"""
        raise NotImplementedError

    def candidates(self, queries: DataFrame) -> DataFrame:
        """Distinct (query_id, vec_id)."""
        p = written(self.probes(queries).select("query_id", "bucket").distinct(), "probes")
        return self.postings.join(_small(p, 64), "bucket").select("query_id", "vec_id").distinct()

    def search(self, queries: DataFrame, k: int, fallback_exact: bool = False, exclude_self: bool = False) -> DataFrame:
        """query_id, rank, neighbor_id, l2_dist. With fallback_exact, answers of under k rows are replaced by exact ones."""
        found = distances(self.candidates(queries), queries, self.corpus)
        if exclude_self:
            found = found.where("query_id <> neighbor_id")
        out = nearest(found, k)
        return with_fallback(out, queries, self.corpus, k, exclude_self) if fallback_exact else out


def with_fallback(answers: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """The answers, with those of under k rows (or none) replaced as a whole by exact ones.

    They are computed once, and read again to see which are short.
    """
    answers = written(answers, "answers")
    full = answers.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = written(queries.select("vec_id", "embedding").join(full, "vec_id", "left_anti"), "short")
    kept = answers.join(full.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
    return kept.unionByName(exact_knn(short, corpus, k, exclude_self))


# --- Euclidean LSH -------------------------------------------------------------


@dataclass(frozen=True)
class LshParams:
    """k hashes for each of L tables of width w. key_mode: ``tuple`` (all k hashes), or ``last_hash`` (see LshIndex)."""

    k: int = 4
    L: int = 5
    w: float = 4.0
    seed: int = 1
    key_mode: str = "tuple"

    def __post_init__(self):
        _positive(k=self.k, L=self.L, w=self.w)
        if self.key_mode not in ("tuple", "last_hash"):
            raise ValueError("key_mode must be 'tuple' or 'last_hash'")


#: The modulus of the compact key.
PRIME = 4_294_967_291


@dataclass
class LshModel(Model):
    params: LshParams = None
    directions: np.ndarray = None
    offsets: np.ndarray = None

    def probes(self, queries):
        return self.keyed(queries, False).withColumnRenamed("vec_id", "query_id").withColumn("probe_rank", F.lit(1))

    def keyed(self, rows: DataFrame, build: bool) -> DataFrame:
        """(vec_id, bucket): a row for each table; the bucket names the table and its key."""
        v = as_vector("embedding")
        buckets = []
        for t in range(self.params.L):
            hashes = [projection(v, a, b, self.params.w) for a, b in zip(self.directions[t], self.offsets[t], strict=True)]
            if self.params.key_mode == "tuple":
                key = F.concat_ws(",", *(h.cast("string") for h in hashes))
            else:
                key = compact_key(hashes, build).cast("string")
            buckets.append(F.concat(F.lit(f"{t}:"), key))
        return rows.select("vec_id", F.explode(F.array(*buckets)).alias("bucket"))


def compact_key(hashes: list, build: bool):
    """The key that depends on the last hash alone: h mod PRIME.

    While building, a wrapped product after a negative value takes 25 off the
    next one, so some rows are filed 25 places from where a query looks.
    """
    if not build:
        return F.pmod(hashes[-1], F.lit(PRIME))
    value = hashes[0]
    for h in hashes[1:]:
        value = h - F.when(value < 0, F.lit(25)).otherwise(F.lit(0))
    return F.pmod(value, F.lit(PRIME))


class LshIndex:
    """Hash tables of quantised random projections: floor((a.x + b) / w), k of them for each of L tables."""

    def __init__(self, params: LshParams = LshParams()):
        self.params = params

    def draws(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions and offsets for vectors of d components; the same in every fit."""
        p, rng = self.params, np.random.default_rng(self.params.seed)
        return rng.standard_normal((p.L, p.k, d)), rng.uniform(0, p.w, (p.L, p.k))

    def fit(self, corpus: DataFrame) -> LshModel:
        model = LshModel(corpus, None, self.params, *self.draws(dimension(corpus)))
        model.postings = written(model.keyed(corpus, True), "lsh")
        return model


# --- hypercube -----------------------------------------------------------------


@dataclass(frozen=True)
class HypercubeParams:
    kproj: int = 14
    w: float = 4.0
    M: int = 10
    probes: int = 2
    seed: int = 1

    def __post_init__(self):
        _positive(kproj=self.kproj, w=self.w, M=self.M, probes=self.probes)


def probe_masks(kproj: int, probes: int) -> list[int]:
    """What to flip in a vertex, in order: nothing, then each one bit, each two bits, ... from the lowest bit on."""
    flips = itertools.chain.from_iterable(itertools.combinations(range(kproj), n) for n in range(kproj + 1))
    return [sum(1 << b for b in bits) for bits in itertools.islice(flips, max(1, probes))]


@dataclass
class HypercubeModel(Model):
    params: HypercubeParams = None
    directions: np.ndarray = None
    offsets: np.ndarray = None

    def vertices(self, rows: DataFrame) -> DataFrame:
        v = as_vector("embedding")
        bits = [drawn_bit(projection(v, a, b, self.params.w), j, self.params.seed) for j, (a, b) in enumerate(zip(self.directions, self.offsets, strict=True))]
        return rows.select("vec_id", pack_bits(bits).alias("bucket"))

    def probes(self, queries):
        masks = F.lit(probe_masks(self.params.kproj, self.params.probes)).cast("array<bigint>")
        opened = self.vertices(queries).select(F.col("vec_id").alias("query_id"), "bucket", F.posexplode(masks).alias("probe_rank", "mask"))
        return opened.select("query_id", F.col("bucket").bitwiseXOR(F.col("mask")).alias("bucket"), "probe_rank")

    def candidates(self, queries):
        """At most M for each query, in the order of probes, then of ids."""
        both = self.postings.join(_small(written(self.probes(queries), "probes"), 64), "bucket")
        return top_k(both, ["query_id"], ["probe_rank", "vec_id"], self.params.M, "n").select("query_id", "vec_id")


class HypercubeIndex:
    """Rows at the vertices of a cube: one bit for each of kproj projections."""

    def __init__(self, params: HypercubeParams = HypercubeParams()):
        self.params = params

    def draws(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions and offsets for vectors of d components; the same in every fit."""
        p, rng = self.params, np.random.default_rng(self.params.seed)
        return rng.standard_normal((p.kproj, d)), rng.uniform(0, p.w, p.kproj)

    def fit(self, corpus: DataFrame) -> HypercubeModel:
        model = HypercubeModel(corpus, None, self.params, *self.draws(dimension(corpus)))
        model.postings = written(model.vertices(corpus), "hypercube")
        return model


# --- inverted files ------------------------------------------------------------


@dataclass(frozen=True)
class IvfFlatParams:
    kclusters: int = 50
    nprobe: int = 5
    max_iter: int = 30
    seed: int = 1
    train_size: int | None = None

    def __post_init__(self):
        _positive(kclusters=self.kclusters, nprobe=self.nprobe)


@dataclass
class IvfFlatModel(Model):
    centroids: tuple = None
    nprobe: int = 5

    def probes(self, queries):
        near = nearest_centroids(queries, self.centroids, min(self.nprobe, len(self.centroids[0])))
        return near.select(F.col("vec_id").alias("query_id"), F.col("cluster_id").alias("bucket"), "probe_rank")


class IvfFlatIndex:
    """Lists of rows by nearest centroid; a query opens the lists of its nprobe nearest centroids."""

    def __init__(self, params: IvfFlatParams = IvfFlatParams()):
        self.params = params

    def centroids(self, corpus: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        p = self.params
        return clustering.fit(corpus, KMeansParams(p.kclusters, p.max_iter, seed=p.seed, train_size=p.train_size))

    def fit(self, corpus: DataFrame, centroids: tuple | None = None) -> IvfFlatModel:
        centroids = centroids or self.centroids(corpus)
        lists = nearest_centroids(corpus, centroids).select(F.col("cluster_id").alias("bucket"), "vec_id")
        return IvfFlatModel(corpus, written(lists, "lists"), centroids, self.params.nprobe)


@dataclass(frozen=True)
class PqParams:
    M: int = 16
    nbits: int = 8
    train_size: int | None = 5000
    max_iter: int = 25
    seed: int = 1

    def __post_init__(self):
        _positive(M=self.M)
        if not 1 <= self.nbits <= 16:
            raise ValueError("nbits must be from 1 to 16")


class ProductQuantizer:
    """M codebooks of 2^nbits codewords, each for one part of the vectors."""

    def __init__(self, params: PqParams = PqParams()):
        self.params, self.books = params, None

    def fit(self, corpus: DataFrame) -> ProductQuantizer:
        p, d = self.params, dimension(corpus)
        if d % p.M:
            raise ValueError("the dimension must be a multiple of M")
        size = d // p.M
        books = []
        for m in range(p.M):
            part = corpus.select("vec_id", sub_vector(as_vector("embedding"), m, size).alias("embedding"))
            _, c = clustering.fit(part, KMeansParams(2**p.nbits, p.max_iter, seed=p.seed + m, train_size=p.train_size))
            # Equal points give fewer centres; the last one stands in for the rest.
            books.append(np.concatenate([c, np.repeat(c[-1:], 2**p.nbits - len(c), axis=0)]))
        self.books = np.stack(books)
        return self

    def with_books(self, books: np.ndarray) -> ProductQuantizer:
        """This quantizer with given codebooks: parts x codewords x components."""
        self.books = np.asarray(books, float)
        return self

    def _fitted(self) -> np.ndarray:
        if self.books is None:
            raise RuntimeError("the quantizer is not fitted")
        return self.books

    def encode(self, rows: DataFrame) -> DataFrame:
        """(vec_id, codes)"""
        return product_codes(rows, self._fitted())

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The codewords' vectors of rows of codes."""
        books = self._fitted()
        return np.concatenate([books[m][codes[:, m]] for m in range(len(books))], axis=1)

    def distance_table(self, queries: DataFrame) -> DataFrame:
        """(query_id, part, code, t): the squared distance of each part of a query to each codeword."""
        books = self._fitted()
        size = books.shape[2]
        rows = [(m, c, [float(x) for x in v]) for m, book in enumerate(books) for c, v in enumerate(book)]
        words = queries.sparkSession.createDataFrame(rows, "part int, code int, word array<double>")
        parts = queries.select(F.col("vec_id").alias("query_id"), as_vector("embedding").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(len(books) - 1))).alias("part"))
        both = parts.join(F.broadcast(words), "part")  # of a size that the quantizer fixes
        return both.select("query_id", "part", "code", l2_squared(sub_vector(F.col("v"), F.col("part"), size), F.col("word")).alias("t"))

    def tables(self, queries: DataFrame) -> DataFrame:
        """(query_id, tables): the distance table as an array of arrays, by part and code."""
        by = self.distance_table(queries).groupBy("query_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "t"))), lambda s: s["t"]).alias("t"))
        return by.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda s: s["t"]).alias("tables"))


def adc(tables, codes):
    """The approximate squared distance: the sum of each part's table entry for its code."""
    return F.aggregate(F.zip_with(tables, codes, lambda t, c: F.get(t, c)), F.lit(0.0), lambda s, x: s + x)


@dataclass(frozen=True)
class IvfPqParams:
    ivf: IvfFlatParams = field(default_factory=IvfFlatParams)
    pq: PqParams = field(default_factory=PqParams)


@dataclass
class IvfPqModel(IvfFlatModel):
    quantizer: ProductQuantizer = None
    codes: DataFrame = None

    def approximate(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, adc): the k candidates of each query with the least approximate distance."""
        opened = self.postings.join(_small(written(self.probes(queries), "probes"), 64), "bucket").select("query_id", "vec_id")
        tables = _small(written(self.quantizer.tables(queries), "tables"), 8 * self.quantizer._fitted()[:, :, 0].size + 16)
        both = opened.join(self.codes, "vec_id").join(tables, "query_id")
        rows = both.select("query_id", "vec_id", F.round(adc(F.col("tables"), F.col("codes")), 6).alias("adc"))
        return top_k(rows, ["query_id"], ["adc", "vec_id"], k, "n").drop("n")

    def search(self, queries, k, fallback_exact=False, exclude_self=False):
        """The k best by approximate distance, ranked again by exact distance."""
        near = written(self.approximate(queries, k).select("query_id", "vec_id"), "near")
        found = distances(near, queries, self.corpus)
        out = nearest(found.where("query_id <> neighbor_id") if exclude_self else found, k)
        return with_fallback(out, queries, self.corpus, k, exclude_self) if fallback_exact else out


class IvfPqIndex:
    """Inverted lists of product codes."""

    def __init__(self, params: IvfPqParams = IvfPqParams()):
        self.params = params

    def fit(self, corpus: DataFrame, centroids: tuple | None = None, quantizer: ProductQuantizer | None = None) -> IvfPqModel:
        flat = IvfFlatIndex(self.params.ivf).fit(corpus, centroids)
        quantizer = quantizer or ProductQuantizer(self.params.pq).fit(corpus)
        return IvfPqModel(corpus, flat.postings, flat.centroids, flat.nprobe, quantizer, written(quantizer.encode(corpus), "codes"))


# --- learnt partition ----------------------------------------------------------


@dataclass(frozen=True)
class NeuralLshParams:
    m: int = 100
    T: int = 5
    epochs: int = 10
    layers: int = 3
    nodes: int = 256
    batch_size: int = 256
    lr: float = 1e-3
    train_size: int = 20_000
    max_iter: int = 20
    seed: int = 1

    def __post_init__(self):
        _positive(T=self.T, epochs=self.epochs, layers=self.layers, nodes=self.nodes, batch_size=self.batch_size, lr=self.lr)
        if self.m <= 1:
            raise ValueError("m must be more than 1")


@dataclass
class NeuralLshModel(Model):
    network: Network = None
    T: int = 5

    def probes(self, queries):
        """The T bins that the network finds likeliest, in the order of their probabilities."""
        sent, t = queries.sparkSession.sparkContext.broadcast(self.network), self.T

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    p = sent.value.probabilities(rows_of(batch.column("v")))
                    order = np.argsort(-p, axis=1, kind="stable")[:, :t]
                    ids = np.repeat(batch.column("query_id").to_numpy(), order.shape[1])
                    ranks = np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), batch.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(order.ravel().astype(np.int32)), pa.array(ranks)], ["query_id", "bucket", "probe_rank"])

        plain = queries.select(F.col("vec_id").alias("query_id"), as_vector("embedding").alias("v"))
        return plain.mapInArrow(run, "query_id long, bucket int, probe_rank int")


class NeuralLshIndex:
    """Bins of k-means, which a network learns to open for a query, from a sample of at most ``train_size`` rows."""

    def __init__(self, params: NeuralLshParams = NeuralLshParams()):
        self.params = params

    def fit(self, corpus: DataFrame) -> NeuralLshModel:
        p, d = self.params, dimension(corpus)
        centroids = clustering.fit(corpus, KMeansParams(p.m, p.max_iter, seed=p.seed, train_size=p.train_size))
        bins = written(nearest_centroids(corpus, centroids).select(F.col("cluster_id").alias("bucket"), "vec_id"), "bins")
        sample = clustering.train_sample(corpus, "vec_id", p.train_size, p.seed)
        # The sample is bounded by train_size, so the network is trained on the driver.
        _, x = collect_vectors(sample)
        y = np.argmin(np.round(squared(x, centroids[1]), 10), axis=1)
        found = len(centroids[0])
        network = Network([d, *[p.nodes] * p.layers, found], p.seed).fit(x, y, p.epochs, p.batch_size, p.lr, p.seed)
        return NeuralLshModel(corpus, bins, network, min(p.T, found))


INDEXES = {"lsh": LshIndex, "hypercube": HypercubeIndex, "neural": NeuralLshIndex, "ivfflat": IvfFlatIndex, "ivfpq": IvfPqIndex}


def selected(method: str) -> list[str]:
    """The indexes that a method name stands for: one, both inverted files (``ivf``), or all."""
    groups = {"all": list(INDEXES), "ivf": ["ivfflat", "ivfpq"]} | {m: [m] for m in INDEXES}
    if method not in groups:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(groups)}")
    return groups[method]
