"""Exact top-k inner products of integer vectors by a dual-tree search over cover trees.

A cover tree is built over the queries of a block, once, and one over each shard
of the data. A node has a centre and a covering radius: no vector under it is
farther from the centre. The children of a node are made at half its scale: each
one's centre is a vector that is farther than that scale from the centres before
it, and it takes the vectors within the scale. Children of few vectors would
make a tree of single vectors where there is no structure; those of one node are
put together in buckets with a mean as centre, and with them, after ``LONELY`` of
them, the vectors that are left. So the separation of centres holds for the other
children. For a pair of nodes the inner products are at most

    cq.cx + |cq| rx + |cx| rq + rq rx,

and the pair is left out, with all pairs under it, if that is less than the worst
kth score so far of all queries under the query node. To have such scores from
the start, each leaf of queries is first scored with the data leaves that have
the highest inner product of centres. Then both trees are gone through together
from their roots; of a pair that stays, the side of the larger radius is split.
Pairs of leaves that are left are scored from the highest bound on, until the
bound is under the leaf's worst kth score. Scores are whole numbers, exact.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do those without a vec_id or of an unusual size. Rows that share
a query's vec_id aren't its candidates, and a repeated query is asked once (its
least vector). Equal scores rank by vec_id. Scores outside a long are set to
its nearest value. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.vectors import best, clean, searched

SCALE, LEAF, QUERY_LEAF = 1024, 48, 16
EXACT = 2.0**53
#: Centres of few vectors after which the rest of a node's vectors go to buckets as well.
LONELY = 32
#: Data leaves that a leaf of queries is scored with before the trees are gone through.
PRIMED = 2


class CoverTree:
    """A cover tree in arrays, parents before children.

    ``order`` are the rows, so that each node holds ``order[begin:end]``; its
    children are the nodes from ``child`` to ``child + children`` (0: a leaf).
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        nodes, self.child, self.children = [], [], []  # (begin, end, centre, radius, scale)

        def distances(rows, centre):
            diff = x[rows] - centre
            return np.sqrt(np.einsum("ij,ij->i", diff, diff))

        def add(begin, rows, centre, dist, scale):
            self.order[begin : begin + len(rows)] = rows
            nodes.append((begin, begin + len(rows), centre, float(dist.max(initial=0)), scale))
            self.child.append(0), self.children.append(0)
            return begin + len(rows)

        def halves(rows):
            """Rows in buckets, halved again and again along the line through two far ones."""
            if len(rows) <= leaf:
                yield rows
                return
            one = x[rows[distances(rows, x[rows[0]]).argmax()]]
            along = x[rows] @ (x[rows[distances(rows, one).argmax()]] - one)
            at = np.argsort(along, kind="stable")
            yield from halves(rows[at[: len(rows) // 2]])
            yield from halves(rows[at[len(rows) // 2 :]])

        if len(x):
            dist = distances(self.order, x[0])
            add(0, self.order.copy(), x[0], dist, max(float(dist.max()), 1.0))
        at = 0
        while at < len(nodes):
            begin, end, centre, radius, scale = nodes[at]
            if end - begin > leaf:
                while scale >= radius > 0:
                    scale /= 2
                self.child[at] = len(nodes)
                rows, small, place = self.order[begin:end].copy(), [], begin
                dist = distances(rows, centre)  # the first child keeps the centre
                if radius == 0:  # equal vectors go to buckets
                    rows, small = rows[:0], [rows]
                while len(rows):
                    own = dist <= scale
                    if own.sum() > leaf // 4:
                        place = add(place, rows[own], centre, dist[own], scale)
                    else:
                        small.append(rows[own])
                    rows = rows[~own]
                    if len(small) == LONELY:
                        small.append(rows)
                        break
                    if len(rows):
                        centre = x[rows[0]]
                        dist = distances(rows, centre)
                for own in halves(np.concatenate(small)) if small else ():
                    mean = x[own].mean(axis=0)
                    place = add(place, own, mean, distances(own, mean), scale)
                self.children[at] = len(nodes) - self.child[at]
            at += 1
        self.begin, self.end = (np.array([n[k] for n in nodes], np.int64) for k in (0, 1))
        self.centre = np.array([n[2] for n in nodes]).reshape(len(nodes), x.shape[1])
        self.radius = np.array([n[3] for n in nodes]) * (1 + 1e-12)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.centre, self.centre))
        self.child, self.children = np.array(self.child, np.int64), np.array(self.children, np.int64)
        self.leaves = np.flatnonzero(self.children == 0)

    def lowest(self, values: np.ndarray) -> np.ndarray:
        """The least value of the rows under each node, of values in the order of ``order``."""
        out = np.empty(len(self.begin))
        out[self.leaves] = [values[a:b].min() for a, b in zip(self.begin[self.leaves].tolist(), self.end[self.leaves].tolist(), strict=True)]
        for i in range(len(out) - 1, -1, -1):
            if self.children[i]:
                out[i] = out[self.child[i] : self.child[i] + self.children[i]].min()
        return out


class Search:
    """The k best data rows of each query, over two cover trees. Counts pairs of nodes pruned and of rows scored."""

    def __init__(self, ids, x, tree: CoverTree, query_ids, queries, query_tree: CoverTree, k: int):
        self.tree, self.ids, self.x = tree, ids[tree.order], x[tree.order]
        self.query_tree, self.query_ids, self.queries, self.k = query_tree, query_ids[query_tree.order], queries[query_tree.order], k
        self.exact = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * x.shape[1] < EXACT
        self.best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.best_scores = np.full((len(queries), k), -np.inf if self.exact else None, float if self.exact else object)
        self.have, self.worst = np.zeros(len(queries), np.int64), np.full(len(queries), -np.inf)
        self.scored = self.pruned = self.pruned_inner = 0

    def run(self) -> None:
        q, x = self.query_tree, self.tree
        if not len(q.begin) or not len(x.begin):
            return
        bounds = q.centre @ x.centre.T
        near = bounds[np.ix_(q.leaves, x.leaves)]
        primed = x.leaves[np.argsort(-near, axis=1, kind="stable")[:, :PRIMED]]
        for leaf, own in zip(q.leaves.tolist(), primed, strict=True):
            self.score(leaf, own)
        bounds += q.norm[:, None] * x.radius + q.radius[:, None] * x.norm + q.radius[:, None] * x.radius
        bounds += 1 + np.abs(bounds) * 1e-9  # above any rounding
        left_q, left_x = self.descend(bounds)
        done = {(int(a), int(b)) for a, own in zip(q.leaves, primed, strict=True) for b in own}
        order = np.lexsort((-bounds[left_q, left_x], left_q))
        left_q, left_x = left_q[order], left_x[order]
        for own in np.split(np.arange(len(left_q)), np.flatnonzero(np.diff(left_q)) + 1):
            if not len(own):
                continue
            leaf, most = int(left_q[own[0]]), 4
            nodes = np.array([n for n in left_x[own].tolist() if (leaf, n) not in done], np.int64)
            while len(nodes):
                alive = int(np.count_nonzero(bounds[leaf, nodes] >= self.worst[q.begin[leaf] : q.end[leaf]].min()))
                self.pruned += len(nodes) - alive
                self.score(leaf, nodes[: min(alive, most)])
                nodes, most = nodes[:alive][most:], 2 * most

    def descend(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of leaves that no bound rules out."""
        q, x = self.query_tree, self.tree
        worst = q.lowest(self.worst)
        a, b, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(a):
            keep = bounds[a, b] >= worst[a]
            self.pruned += int(np.count_nonzero(~keep))
            self.pruned_inner += int(np.count_nonzero(~keep & (q.children[a] > 0)))
            a, b = a[keep], b[keep]
            leaves = (q.children[a] == 0) & (x.children[b] == 0)
            found.append((a[leaves], b[leaves]))
            a, b = a[~leaves], b[~leaves]
            # The larger side is split, unless it is a leaf.
            split = (x.children[b] == 0) | ((q.children[a] > 0) & (q.radius[a] >= x.radius[b]))
            count = np.where(split, q.children[a], x.children[b])
            first = np.where(split, q.child[a], x.child[b])
            new = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            on = np.repeat(split, count)
            a, b = np.where(on, new, np.repeat(a, count)), np.where(on, np.repeat(b, count), new)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (a, b)

    def score(self, leaf: int, nodes: np.ndarray) -> None:
        """Scores the queries of a leaf with the rows of data leaves."""
        if not len(nodes):
            return
        members = slice(int(self.query_tree.begin[leaf]), int(self.query_tree.end[leaf]))
        points = np.concatenate([np.arange(a, b) for a, b in zip(self.tree.begin[nodes].tolist(), self.tree.end[nodes].tolist(), strict=True)])
        ids, queries, k = self.ids[points], self.queries[members], self.k
        self.scored += len(queries) * len(points)
        if not self.exact:
            self.score_large(members, ids, queries.astype(object) @ self.x[points].astype(object).T)
            return
        scores = queries @ self.x[points].T
        scores[ids == self.query_ids[members, None]] = -np.inf
        scores, ids = np.c_[self.best_scores[members], scores], np.c_[self.best_ids[members], np.broadcast_to(ids, scores.shape)]
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(scores, top, 1).min(axis=1)
        # Where more rows have the kth score than there are places, the smaller ids are taken.
        for r in np.flatnonzero(((scores >= last[:, None]).sum(axis=1) > k) & np.isfinite(last)).tolist():
            near = np.flatnonzero(scores[r] >= last[r])
            top[r] = near[np.lexsort((ids[r, near], -scores[r, near]))][:k]
        self.best_scores[members], self.best_ids[members] = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
        self.worst[members] = last

    def score_large(self, members: slice, ids: np.ndarray, scores: np.ndarray) -> None:
        """As ``score``, for inner products that a double can't hold."""
        for m, own in zip(range(members.start, members.stop), scores, strict=True):
            ok = ids != self.query_ids[m]
            n = int(self.have[m])
            s = [*self.best_scores[m, :n].tolist(), *(max(-(2**63), min(2**63 - 1, int(v))) for v in own[ok])]
            i = np.concatenate([self.best_ids[m, :n], ids[ok]])
            top = sorted(range(len(s)), key=lambda t: (-s[t], i[t]))[: self.k]
            self.best_ids[m, : len(top)], self.best_scores[m, : len(top)] = i[top], [s[t] for t in top]
            self.have[m] = len(top)
            if len(top) == self.k:
                self.worst[m] = np.nextafter(float(s[top[-1]]), -np.inf)

    def answers(self):
        """(query_id, ids, scores) of each query, best first."""
        for m, q in enumerate(self.query_ids.tolist()):
            ok = self.best_scores[m] > -np.inf if self.exact else np.arange(self.k) < self.have[m]
            ids, scores = self.best_ids[m][ok], self.best_scores[m][ok].astype(np.int64)
            top = best(ids, scores, self.k)
            yield q, ids[top], scores[top]


def top_k(rows: DataFrame, step: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (integer inner product) of the k best for each query."""
    data, d, n = clean(rows, zero=True)
    data = data.withColumn("embedding", F.transform("embedding", lambda v: F.floor(v * SCALE).cast("double")))

    def prepare(query_ids, queries):
        return query_ids, queries, CoverTree(queries, QUERY_LEAF)

    def shard(ids, x, prepared):
        search = Search(ids, x, CoverTree(x), *prepared, k)
        search.run()
        return search.answers()

    return searched(data, d, n, step, k, "long", prepare, shard, "covertree")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
