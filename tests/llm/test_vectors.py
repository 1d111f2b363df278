"""Vector searches against full scans."""

import duckdb
import numpy as np
import pytest

from vecspark.llm import covertree, forest, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string, query_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, "x", "y") for i, v in rows], SCHEMA)


def edge_rows(n=300, d=6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, d)) / 4  # many ties
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    return rows + [(1000, None), (1020, [0.5] * 3), (1040, [nan] * d), (1060, [None] * d), (1080, [inf] + [0.0] * (d - 1)), (1100, [0.0] * d), (7, rows[7][1]), (None, [0.5] * d), (1200, []), (2000, [0.25] * d)]


def usable(rows, d, zero):
    ok = [(i, v) for i, v in rows if i is not None and v and len(v) == d and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))]
    return np.array([i for i, _ in ok]), np.array([v for _, v in ok], float)


def full(ids, x, step, k):
    out = []
    for q in sorted({i for i in ids.tolist() if i % step == 0}):
        v = min(x[j].tolist() for j in np.flatnonzero(ids == q))
        s = x @ np.array(v)
        own = np.flatnonzero(ids != q)
        top = own[np.lexsort((ids[own], -s[own]))][:k]
        out += [(q, r + 1, int(ids[j]), s[j]) for r, j in enumerate(top)]
    return out


def test_cover_tree_edges(spark):
    rows = edge_rows()
    ids, x = usable(rows, 6, True)
    got = covertree.top_k(frame(spark, rows), 20, 10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(q, r, i, int(s)) for q, r, i, s in full(ids, np.floor(1024 * x), 20, 10)]
    assert covertree.top_k(frame(spark, rows).where("false")).count() == 0
    few = covertree.top_k(frame(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.0])])).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 1024 * 512)]


@pytest.mark.parametrize("search", [lambda x: covertree.top_k(x, 20, 10), lambda x: forest.nearest(x, 20, 10)])
def test_blocks_and_shards(spark, monkeypatch, search):
    """Many blocks of queries and shards of rows: exact where the search is, and the same again."""
    from vecspark.llm import vectors

    monkeypatch.setattr(vectors, "BLOCK_BYTES", 200)
    monkeypatch.setattr(vectors, "SHARD", 70)
    rows = edge_rows()
    got = answers(search(frame(spark, rows)))
    assert got == answers(search(frame(spark, rows).repartition(9)))
    if isinstance(got[0][3], int):
        ids, x = usable(rows, 6, True)
        assert got == sorted((q, r, i, int(s)) for q, r, i, s in full(ids, np.floor(1024 * x), 20, 10))


def test_cover_tree_large_values(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 0.0]), (2, [-3e9, 5.0])]
    got = [tuple(r) for r in covertree.top_k(frame(spark, rows)).collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


@pytest.mark.parametrize("kind", ["noise", "clusters", "copies"])
def test_cover_tree_covers(kind):
    """Radii cover, children share out the rows, and centres of children that aren't buckets are apart."""
    rng = np.random.default_rng(1)
    x = {"noise": rng.standard_normal((500, 5)), "clusters": clustered(800, 8), "copies": np.repeat(rng.standard_normal((3, 4)), 90, axis=0)}[kind]
    tree = covertree.CoverTree(x, 8)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for i in range(len(tree.begin)):
        points = x[tree.order[tree.begin[i] : tree.end[i]]]
        assert (np.sqrt(((points - tree.centre[i]) ** 2).sum(axis=1)) <= tree.radius[i] + 1e-9).all()
        if n := int(tree.children[i]):
            own = slice(tree.child[i], tree.child[i] + n)
            assert tree.begin[own][0] == tree.begin[i] and tree.end[own][-1] == tree.end[i] and (tree.begin[own][1:] == tree.end[own][:-1]).all()
        else:
            assert tree.end[i] - tree.begin[i] <= 8


def clustered(n, d, clusters=40, seed=3, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, d))
    x = centres[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, d)) / np.sqrt(d) * np.sqrt(d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_dual_tree_prunes():
    """On clustered vectors pairs go at inner query nodes, and few rows are scored; the answers are exact."""
    x = np.floor(1024 * clustered(6000, 32))
    ids = np.arange(len(x)) * 7
    q = np.arange(0, len(x), 15)
    search = covertree.Search(ids, x, covertree.CoverTree(x), ids[q], x[q], covertree.CoverTree(x[q], covertree.QUERY_LEAF), 10)
    search.run()
    assert search.pruned_inner > 0
    assert search.scored < 0.3 * len(q) * len(x), search.scored / (len(q) * len(x))
    for query, i, s in search.answers():
        scores = (x @ x[query // 7]).astype(np.int64)
        own = np.flatnonzero(ids != query)
        top = own[np.lexsort((ids[own], -scores[own]))][:10]
        assert i.tolist() == ids[top].tolist() and s.tolist() == scores[top].tolist()


def test_cover_tree_query(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    expected = sorted(tuple(r) for r in duckdb.sql(covertree.SQL).fetchall())
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in queries.op9_covertree(spark, sf).collect()) == expected


def test_forest_edges(spark):
    rows = edge_rows()
    ids, x = usable(rows, 6, False)
    got = forest.nearest(frame(spark, rows), 20, 5).orderBy("query_id", "rank").collect()
    expected = full(ids, x, 20, 5)
    assert [(r.query_id, r.rank) for r in got] == [e[:2] for e in expected]
    assert [r.score for r in got] == pytest.approx([e[3] for e in expected])  # so few rows are all candidates
    assert forest.nearest(frame(spark, rows).where("false")).count() == 0


def recall_of(got, expected, k):
    found = {}
    for q, _, i, _ in got:
        found.setdefault(q, set()).add(i)
    best = {}
    for q, _, i, _ in expected:
        best.setdefault(q, set()).add(i)
    return np.mean([len(best[q] & found[q]) / min(k, len(best[q])) for q in best])


def answers(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_forest_recall(spark):
    """In a shard of vectors without structure; only a part is scored, and answers don't depend on partitions."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((7000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = frame(spark, [(i, [float(y) for y in v]) for i, v in enumerate(x)])
    got = answers(forest.nearest(rows.repartition(1), 100, 20))
    expected = full(np.arange(7000), x.astype(float), 100, 20)
    assert recall_of(got, expected, 20) >= 0.9
    assert got == answers(forest.nearest(rows.repartition(5, "score", "vec_id"), 100, 20))
    f = forest.Forest(x.astype(float), forest.TREES, 10, 1)
    shard = forest.Shard(f, np.arange(7000), x.astype(float))
    own = [(q, r, int(i), v) for q, ids, scores in shard.search(np.arange(0, 7000, 100), x[::100].astype(float), forest.SHARE, 20) for r, (i, v) in enumerate(zip(ids, scores, strict=True))]
    assert recall_of(own, expected, 20) >= 0.9
    assert shard.scored < 0.4 * 70 * 7000, shard.scored / (70 * 7000)


def test_forest_clusters():
    """With structure far fewer rows do."""
    x = clustered(6000, 64, 200)
    shard = forest.Shard(forest.Forest(x, forest.TREES, 10, 1), np.arange(6000), x)
    own = [(q, r, int(i), v) for q, ids, scores in shard.search(np.arange(0, 6000, 100), x[::100], 0.02, 20) for r, (i, v) in enumerate(zip(ids, scores, strict=True))]
    assert recall_of(own, full(np.arange(6000), x, 100, 20), 20) >= 0.9
    assert shard.scored < 0.12 * 60 * 6000, shard.scored / (60 * 6000)


def test_forest_equal_vectors(spark):
    """More equal vectors than neighbours asked for, with fractions, tie to the smaller ids."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 24)) / 3
    same = rng.permutation(3000)[:60]
    x[same] = x[0] = np.abs(x[0]) + 1.7
    got = [r for r in answers(forest.nearest(frame(spark, [(i, [float(y) for y in v]) for i, v in enumerate(x.astype(np.float32))]), 1000, 20)) if r[0] == 0]
    ids = sorted({*same.tolist()} - {0})[:20]
    assert [r[2] for r in got] == ids and len({r[3] for r in got}) == 1


def test_forest_far():
    """Sums of squared distances, and leaves in the order of one queue, against a plain search with a heap."""
    import heapq

    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((400, 6)), rng.standard_normal(6)
    f = forest.Forest(x, 5, 4, 3)
    far, p = f.far(q[None])[0], f.projected(q[None])[0]
    queue, order = [(0.0, t, 0, 0) for t in range(5)], []
    while queue:
        cost, t, node, level = heapq.heappop(queue)
        if level == 4:
            order.append((cost, t * 16 + node - 15))
            continue
        side = p[t, level] - f.cuts[t, node]
        heapq.heappush(queue, (cost + max(0.0, side) ** 2, t, 2 * node + 1, level + 1))
        heapq.heappush(queue, (cost + max(0.0, -side) ** 2, t, 2 * node + 2, level + 1))
    assert np.allclose([far[leaf] for _, leaf in order], [c for c, _ in order], rtol=1e-4, atol=1e-6)
    assert (np.diff([far[leaf] for _, leaf in order]) >= -1e-5).all()
    leaves = f.leaves(x)
    assert all(0 <= f.far(x[i : i + 1])[0][leaves[:, i]].max() < 1e-9 for i in range(20))  # a row's own leaf is not far


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_forest_query(spark, data):
    got = answers(queries.op1_forest(spark, data))
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{data}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table], float)
    expected = full(ids, x, 20, 20)
    assert len(got) == len(expected) and recall_of(got, expected, 20) >= 0.9
    for q, _, i, s in got:
        assert s == float((x[np.searchsorted(ids, i)] * x[np.searchsorted(ids, q)]).sum())
