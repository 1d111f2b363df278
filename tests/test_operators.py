import numpy as np
import pytest

from vecspark.operators import alignment, clustering, dense, embed, index, metrics, topk
from vecspark.plans import search


@pytest.fixture(scope="module")
def corpus(spark):
    x = np.random.default_rng(7).standard_normal((80, 8))
    x[5], x[6] = x[4], 0.0  # a double and a zero vector
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").persist()


@pytest.fixture(scope="module")
def queries(corpus):
    return corpus.where("vec_id < 6")


def brute(corpus, queries, k):
    _, x = dense.collect_vectors(corpus)
    ids, q = dense.collect_vectors(queries)
    out = []
    for i, v in zip(ids, q, strict=True):
        d = np.round(np.sqrt(((x - v) ** 2).sum(axis=1)), 4)
        out += [(int(i), r + 1, int(j), d[j]) for r, j in enumerate(np.lexsort((np.arange(len(x)), d))[:k])]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.neighbor_id, r.l2_dist) for r in df.collect())


def test_exact(corpus, queries):
    assert rows(dense.exact_knn(queries, corpus, 7)) == brute(corpus, queries, 7)
    assert rows(dense.exact_knn(queries, corpus, 7, block=2)) == brute(corpus, queries, 7)
    assert len(rows(dense.exact_knn(queries, corpus, 500))) == 6 * 80
    assert all(r[0] != r[2] for r in rows(dense.exact_knn(queries, corpus, 7, exclude_self=True)))
    with pytest.raises(ValueError):
        dense.exact_knn(queries, corpus, 0)


def test_indexes_that_open_everything_are_exact(corpus, queries):
    full = brute(corpus, queries, 5)
    cube = index.HypercubeIndex(index.HypercubeParams(3, 1.0, 1000, 8)).fit(corpus)
    flat = index.IvfFlatIndex(index.IvfFlatParams(4, 4, max_iter=5)).fit(corpus)
    wide = index.LshIndex(index.LshParams(1, 3, 1e6)).fit(corpus)
    neural = index.NeuralLshIndex(index.NeuralLshParams(m=3, T=3, epochs=5, layers=1, nodes=8)).fit(corpus)
    for model in (cube, flat, wide, neural):
        assert rows(model.search(queries, 5)) == full


def test_recall_grows_with_probes(corpus, queries):
    truth = dense.exact_knn(queries, corpus, 10)
    centroids = clustering.fit(corpus, clustering.KMeansParams(6, 5))
    shares = []
    for nprobe in (1, 3, 6):
        found = index.IvfFlatIndex(index.IvfFlatParams(6, nprobe)).fit(corpus, centroids).search(queries, 10)
        shares.append(sum(r.recall_at_n for r in metrics.recall_at_n(found, truth, queries, 10).collect()))
    assert shares == sorted(shares) and shares[-1] == pytest.approx(6.0)


def test_fallback_replaces_short_answers(corpus, queries):
    model = index.LshIndex(index.LshParams(6, 1, 0.2, seed=3)).fit(corpus)
    short = model.search(queries, 10)
    assert short.count() < 60
    assert rows(model.search(queries, 10, fallback_exact=True)) == brute(corpus, queries, 10)


def test_sizes_that_differ_are_errors(spark, corpus):
    model = index.HypercubeIndex(index.HypercubeParams(3, 1.0, 1000, 8)).fit(corpus)
    short = spark.createDataFrame([(1, [0.5] * 7)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="components|length|size"):
        model.search(short, 3).collect()
    with pytest.raises(Exception, match="length|shape|match|core"):
        dense.exact_knn(short, corpus, 3).collect()
    assert model.search(short.where("false"), 3).count() == 0 == dense.exact_knn(short.where("false"), corpus, 3).count()


def test_model_is_written(spark, corpus, queries):
    """A fitted index is read from its files; a search doesn't hash the corpus again."""
    model = index.HypercubeIndex(index.HypercubeParams(3, 1.0, 1000, 8)).fit(corpus)
    plan = model.postings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Relation") and "aggregate" not in plan


def test_drawn_bits(spark):
    """Bits of neighbouring hash values are even and unrelated, and the same again."""
    from pyspark.sql import functions as F

    from vecspark.functions.vectors import drawn_bit

    frame = spark.range(-2000, 2000).select(*(drawn_bit(F.col("id"), j, 7).alias(f"b{j}") for j in range(2)), drawn_bit(F.col("id"), 0, 8).alias("other"))
    b = np.array(frame.orderBy(F.monotonically_increasing_id()).collect())
    for x in (b[:, 0], b[1:, 0] ^ b[:-1, 0], b[:, 0] ^ b[:, 1], b[:, 0] ^ b[:, 2]):
        assert abs(x.mean() - 0.5) < 0.05


def test_train_sample_of_large_ids(spark):
    rows = spark.createDataFrame([(10**18 + i,) for i in range(50)] + [(i,) for i in range(50)], "vec_id long")
    first, again = ([r.vec_id for r in topk.train_sample(rows.repartition(n), "vec_id", 40, 3).collect()] for n in (1, 5))
    assert len(set(first)) == 40 and sorted(first) == sorted(again) and first != [r.vec_id for r in topk.train_sample(rows, "vec_id", 40, 4).collect()]
    assert 8 <= sum(i < 50 for i in first) <= 32


def test_network():
    """Slopes against differences, and a task that only a hidden layer can learn."""
    from vecspark.operators.network import Network

    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((20, 4)), rng.integers(0, 3, 20)
    n = Network([4, 6, 5, 3], 1)
    for own, slope in zip(n.weights + n.offsets, n.slopes(x, y), strict=True):
        at = tuple(rng.integers(0, s) for s in own.shape)
        own[at] += 1e-6
        up = n.loss(x, y)
        own[at] -= 2e-6
        down = n.loss(x, y)
        own[at] += 1e-6
        assert slope[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    x = rng.uniform(-1, 1, (600, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    n = Network([2, 32, 32, 2], 1).fit(x, y, 60, 32, 1e-2, 1)
    assert (n.probabilities(x).argmax(axis=1) == y).mean() > 0.95
    assert n.loss(x, y) < Network([2, 32, 32, 2], 1).fit(x, y, 1, 32, 1e-4, 1).loss(x, y)


def test_neural_opens_the_right_bins(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8)) * 3
    x = centres[np.arange(300) % 6] + 0.2 * rng.standard_normal((300, 8))
    rows = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    model = index.NeuralLshIndex(index.NeuralLshParams(m=6, T=1, epochs=40, layers=2, nodes=32, lr=1e-2, batch_size=32)).fit(rows)
    own = {r.vec_id: r.bucket for r in model.postings.collect()}
    opened = {r.query_id: r.bucket for r in model.probes(rows).where("probe_rank = 1").collect()}
    assert sum(own[i] == opened[i] for i in own) > 290


def test_probe_masks():
    assert index.probe_masks(3, 8) == [0, 1, 2, 4, 3, 5, 6, 7]
    assert index.probe_masks(3, 1) == [0] and len(index.probe_masks(3, 100)) == 8


def test_compact_key(spark):
    from pyspark.sql import functions as F

    prime = index.PRIME
    frame = spark.createDataFrame([(5, -3, 7), (-1, 2, -4), (30, -2, 10), (0, 0, 0)], "a long, b long, c long")
    columns = [F.col(c) for c in "abc"]
    got = frame.select("a", "b", "c", index.compact_key(columns, True).alias("build"), index.compact_key(columns, False).alias("query")).collect()

    def wrapped(*hashes):  # 64-bit products that wrap
        key = 0
        for h in hashes:
            product = (key * prime) % 2**64
            product = product - 2**64 if product >= 2**63 else product
            key = (product + h) % prime
        return key

    for r in got:
        assert r.build == wrapped(r.a, r.b, r.c) and r.query == r.c % prime


def test_product_quantizer(corpus, queries):
    pq = index.ProductQuantizer(index.PqParams(M=4, nbits=3, max_iter=5)).fit(corpus)
    codes = {r.vec_id: r.codes for r in pq.encode(corpus).collect()}
    decoded = pq.decode(np.array([codes[i] for i in range(80)]))
    _, q = dense.collect_vectors(queries)
    tables = {r.query_id: r.tables for r in pq.tables(queries).collect()}
    for i in range(6):
        for j in (0, 11, 79):
            adc = sum(tables[i][m][codes[j][m]] for m in range(4))
            assert adc == pytest.approx(((q[i] - decoded[j]) ** 2).sum())
    with pytest.raises(ValueError):
        index.ProductQuantizer(index.PqParams(M=3)).fit(corpus)
    with pytest.raises(RuntimeError):
        index.ProductQuantizer(index.PqParams()).encode(corpus)


def test_ivf_pq(corpus, queries):
    params = index.IvfPqParams(index.IvfFlatParams(4, 4, max_iter=5), index.PqParams(4, 4, max_iter=5))
    found = rows(index.IvfPqIndex(params).fit(corpus).search(queries, 5))
    exact = {(q, n): d for q, _, n, d in brute(corpus, queries, 80)}
    assert len(found) == 30 and all(exact[q, n] == d for q, _, n, d in found)


def test_lloyd_by_hand(spark):
    points = spark.createDataFrame([(0, [0.0]), (1, [10.0]), (2, [1.0]), (3, [11.0]), (4, [12.0])], "vec_id long, embedding array<double>")
    _, c = clustering.lloyd(points, clustering.KMeansParams(2, 10))
    assert sorted(c.ravel().tolist()) == [0.5, 11.0]
    with pytest.raises(ValueError):
        clustering.lloyd(points, clustering.KMeansParams(6))
    with pytest.raises(ValueError):
        clustering.fit(points, clustering.KMeansParams(6))


@pytest.mark.parametrize(
    "make",
    [
        lambda: index.LshParams(k=0), lambda: index.LshParams(w=-1), lambda: index.LshParams(key_mode="x"), lambda: index.HypercubeParams(probes=0), lambda: index.IvfFlatParams(nprobe=0),
        lambda: index.PqParams(nbits=17), lambda: index.NeuralLshParams(m=1), lambda: index.NeuralLshParams(T=0), lambda: clustering.KMeansParams(0), lambda: index.selected("none"), lambda: search.configurations({}) and None or search.grid_search(None, None, None, "lsh", {}),
    ],
)
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_selected():
    assert index.selected("ivf") == ["ivfflat", "ivfpq"] and len(index.selected("all")) == 5


def test_recall(spark):
    def ranked(q, ids):
        return spark.createDataFrame([(q, i + 1, x) for i, x in enumerate(ids)], "query_id long, rank int, neighbor_id string")

    queries = spark.createDataFrame([(1,), (2,)], "vec_id long")
    for n, expected in ((3, 2 / 3), (5, 2 / 5)):
        got = {r.query_id: r.recall_at_n for r in metrics.recall_at_n(ranked(1, "abc"), ranked(1, "bcd"), queries, n).collect()}
        assert got == {1: pytest.approx(expected), 2: 0.0}
    with pytest.raises(ValueError):
        metrics.recall_at_n(queries, queries, queries, 0)


def test_remote_candidates(spark):
    n = spark.createDataFrame([("q", "a", None, False), ("q", "b", 29.6, True), ("q", "c", 30.0, False)], "query_id string, neighbor_id string, blast_identity_pct double, in_blast_top_n boolean")
    assert {r.neighbor_id for r in search.remote_candidates(n).collect()} == {"a", "b"}
    assert {r.neighbor_id for r in search.remote_candidates(n, not_in_top=True).collect()} == {"a"}


def test_head_and_sample(corpus):
    assert [r.vec_id for r in topk.head(corpus, "vec_id", 3).collect()] == [0, 1, 2]
    assert topk.train_sample(corpus, "vec_id", 10).count() == 10 and topk.train_sample(corpus, "vec_id", None).count() == 80
    with pytest.raises(ValueError):
        topk.head(corpus, "vec_id", 0)


def test_alignment(spark):
    assert alignment.local_alignment("ACGT", "ACGT") == (8, 4, 4)
    assert alignment.local_alignment("AAAA", "TTTT") == (0, 0, 0)
    assert alignment.local_alignment("XXACGTACGTYY", "ACGTCGT")[1] == 7
    s = spark.createDataFrame([("a", "MKVLAAGIT"), ("b", "MKVLAAGIS"), ("c", "WWWWWW")], "id string, sequence string")
    hits = alignment.align(alignment.seed_candidates(s, s, 3, 1), s, s)
    best = {(r.qseqid, r.sseqid): r.pident for r in hits.collect()}
    assert best["a", "a"] == 100.0 and best["a", "b"] == 100.0 and ("a", "c") not in best
    assert alignment.restricted(hits, spark.createDataFrame([("b",)], "id string")).select("sseqid").distinct().count() == 1


def test_embedding(spark):
    s = spark.createDataFrame([("a", " mk vl\n"), ("b", ""), ("c", "M" * 2000)], "id string, sequence string")
    got = {r.id: np.array(r.embedding) for r in embed.embed(s, batch_size=2).collect()}
    assert got["a"].shape == (320,) and np.linalg.norm(got["a"]) == pytest.approx(1) and not got["b"].any()
    assert np.allclose(got["a"], embed.KmerEmbedder()(["MKVL"])[0])
    for bad in ({"batch_size": 0}, {"model": "none"}):
        with pytest.raises(Exception, match="positive|unknown"):
            embed.embed(s, **bad).collect()
    assert embed.masked_mean(np.ones((1, 3, 2)), np.zeros((1, 3))).tolist() == [[0, 0]]


def test_search_and_grid(spark, corpus, queries):
    truth = dense.exact_knn(queries, corpus, 20)
    hits = truth.selectExpr("query_id as qseqid", "neighbor_id as sseqid", "50.0D as pident", "-l2_dist as bitscore", "0D as evalue", "rank as line_no")
    settings = {"ivfflat": {"kclusters": 4, "nprobe": 4}, "ivfpq": {"kclusters": 4, "nprobe": 4, "M": 4, "nbits": 3}}
    out = search.search(corpus, queries, hits, "ivf", 10, 5, settings=settings)
    by = {r.method: r for r in out["by_method"].collect()}
    assert by["IVF-Flat"].mean_recall_at_n == 1.0 and by["IVF-Flat"].n_queries == 6 and by["IVF-PQ"].mean_qps > 0
    assert out["neighbors"].count() == 2 * 6 * 5
    assert by["BLAST (Ref)"].mean_recall_at_n == 1.0 and by["BLAST (Ref)"].n_queries == 6 and by["BLAST (Ref)"].mean_time_per_query_s > 0
    alone = search.search(corpus, queries, hits, "ivfflat", 10, 5, settings=settings, reference_seconds=0.5, one_by_one=True)
    own = {(r.query_id, r.method): r for r in alone["summaries"].collect()}
    assert len(own) == 12 and len({own[i, "IVF-Flat"].time_per_query_s for i in range(6)}) > 1 and own[3, "BLAST (Ref)"].qps == 2.0
    assert sorted(map(tuple, alone["neighbors"].select("query_id", "rank", "neighbor_id").collect())) == sorted(map(tuple, out["neighbors"].where("method = 'IVF-Flat'").select("query_id", "rank", "neighbor_id").collect()))
    with pytest.raises(ValueError):
        search.search(corpus, queries.where("false"), hits, "lsh")
    grid = search.grid_search(corpus, queries, hits, "hypercube", {"kproj": [2, 3], "probes": [1]}, 10)
    wide = search.wide(grid, ["kproj", "probes"])
    assert wide.columns == sorted(wide.columns) and wide.count() == 2 and search.tradeoff(grid).count() == 2


def test_seeds_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = ["".join(rng.choice(list("acgt "), n)) for n in (0, 2, 30, 60, 200, 200)] + ["acgtacgtacgt" * 20, "ACGTACGTACGT"]
    s = spark.createDataFrame([(str(i), t) for i, t in enumerate(text)] + [("n", None)], "id string, sequence string")
    plain = ["".join(t.strip().split(" ")).upper() for t in text]
    mers = [{t[a : a + 3] for a in range(len(t) - 2)} for t in plain]
    expected = sorted((str(i), str(j), len(a & b)) for i, a in enumerate(mers) for j, b in enumerate(mers) if len(a & b) >= 4)
    for block in (alignment.SEED_BLOCK, 50):
        monkeypatch.setattr(alignment, "SEED_BLOCK", block)
        assert sorted(map(tuple, alignment.seed_candidates(s, s, 3, 4).collect())) == expected
    assert alignment.seed_candidates(s.where("false"), s, 3, 1).count() == 0 == alignment.seed_candidates(s, s.where("false"), 3, 1).count()


def test_device_and_protein_model(monkeypatch):
    """Means of the tokens that aren't special, by a stand-in for the package; and devices without one."""
    import sys
    import types

    for name in ("cpu", "auto"):
        assert embed.device(name) == "cpu"
    for bad in ("gpu", "cuda"):
        with pytest.raises(ValueError):
            embed.device(bad)

    class Tensor(np.ndarray):
        def to(self, *_):
            return self

        float = cpu = lambda self: self
        numpy = lambda self: np.asarray(self)

    def tensor(x):
        return np.asarray(x).view(Tensor)

    class Net:
        num_layers = 2
        eval = lambda self: self
        to = lambda self, _: self

        def __call__(self, tokens, repr_layers, return_contacts):
            return {"representations": {repr_layers[0]: tensor(np.stack([tokens * 1.0, tokens * 10.0], axis=2))}}

    class Alphabet:
        padding_idx, cls_idx, eos_idx = 1, 0, 2

        def get_batch_converter(self):
            def convert(rows):
                wide = max(len(s) for _, s in rows) + 2
                return None, None, tensor([[0, *map(ord, s), 2, *[1] * (wide - len(s) - 2)] for _, s in rows])

            return convert

    torch = types.SimpleNamespace(no_grad=__import__("contextlib").nullcontext, zeros_like=lambda t, dtype: tensor(np.zeros(t.shape, bool)), bool=bool, cuda=types.SimpleNamespace(is_available=lambda: False))
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "esm", types.SimpleNamespace(pretrained=types.SimpleNamespace(tiny=lambda: (Net(), Alphabet()))))
    got = embed.ProteinModel("tiny")(["AC", "M"])
    assert got.tolist() == [[66.0, 660.0], [77.0, 770.0]]


def test_stream(spark, corpus, queries, tmp_path):
    from vecspark.streaming import search_stream

    queries.write.parquet(str(tmp_path / "in"))
    model = index.HypercubeIndex(index.HypercubeParams(3, 1.0, 1000, 8)).fit(corpus)
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in"))
    query = search_stream(stream, model, 5, lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == brute(corpus, queries, 5)
