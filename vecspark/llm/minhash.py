"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its distinct word shingles, as 64-bit hashes; its
signature has 64 minima. The forest has 16 orders of the documents, order t
sorted by its own four minima and then by the next four. Documents that agree in
an order's first four minima are a region of it; a pair at a similarity of 0.8
shares none of the 16 with a probability of 0.0002. That is the only step that
may miss a link.

1. Documents with one and the same set are drawn together; the least id stands
   for them.
2. Neighbours: in each order a document is compared with the one before it, with
   which it has the longest common prefix, and with the first of its region. So
   pairs grow with the documents, however large a region is. Pairs whose
   signatures agree in at least ``AGREE`` of 64 places (a pair at 0.8 has less with
   a probability under 1e-10) are confirmed on the full sets; the components of
   the links are labels.
3. Regions that hold several labels after that are searched whole. Those of up to
   ``REGION`` documents are compared pair by pair. In larger ones the minima tell
   nothing any more, since they come from what all the documents share, so the
   depth adapts: the documents go on by their rarest shingles, counted over all
   documents of such regions. Two linked sets share one of the first
   n - ceil(0.8 n) + 1 shingles of either in that order, so the documents that hold
   a shingle so early meet, and a template that thousands share brings none
   together. What meets is confirmed at once on the shingles from there on; this
   step is exact. Shingles that many documents hold so early are dealt into cells,
   every two of which meet in a block, and only links that join labels come out of
   a block. The comparisons in a large family at the very threshold still grow with
   the square of its size; its rows don't.

Defined cases: a null text, or one without words, has an empty set and is
linked with nothing. A document with fewer words than a shingle has its whole
sequence as one. Rows of one doc_id are one document. A null doc_id is linked
with nothing, has a null component and is kept. Repeated rows are in one group.
Ties don't arise: links and least ids don't depend on an order of rows. A text of
any length is one set, made by one task; only such a document's own hashes are
held at once. An empty table gives an empty table. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.components import components
from vecspark.llm.shared import Stage, grams, mixed, prefix_sums, signed, sliced, small_side, spans_hash, texts, words

HASHES, ORDERS, DEPTH = 64, 16, 4
#: Agreeing minima that a pair has at least to be confirmed.
AGREE = 28
#: Regions of more documents go on by rare shingles.
REGION = 32
#: A cell of documents that hold a shingle has about so many, and so many hashes, at most.
CELL, CELL_ITEMS = 1024, 1 << 20
_rng = np.random.default_rng(5)
_MULTIPLY = (_rng.integers(0, 1 << 63, HASHES, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, np.int64).astype(np.uint64)


def shingle_sets(batch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and n + 1 offsets."""
    data, offsets = texts(batch.column("text"))
    starts, ends, first = words(data, offsets)
    h = spans_hash(prefix_sums(data, lower=True), starts, ends)
    count = np.diff(first)
    g = grams(h, shingle)
    sets = []
    for i, n in enumerate(count.tolist()):
        a = first[i]
        if n >= shingle:
            own = np.sort(g[a : a + n - shingle + 1])
            sets.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif n:  # the sequence as one, told apart by its length
            sets.append(grams(h[a : a + n], n) ^ np.uint64(n))
        else:
            sets.append(h[:0])
    sizes = np.array([len(x) for x in sets], np.int64)
    return (np.concatenate(sets) if sets else h[:0]), np.r_[0, np.cumsum(sizes)]


def _signatures(items: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of HASHES 32-bit minima for each row that isn't empty."""
    at = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(at), HASHES), np.uint32)
    for k in range(HASHES if len(at) else 0):
        v = ((items * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(v, at)
    return out


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, print (two hashes of the set) and sig (binary) of every document."""

    def run(batches):
        for batch in sliced(batches, "text"):
            items, offsets = shingle_sets(batch, shingle)
            n = np.diff(offsets)
            sig, some = _signatures(items, offsets), n > 0
            prints = []
            for salt in (0, 0x5BD1E995):
                sums = np.zeros(len(items) + 1, np.uint64)
                np.cumsum(mixed(items ^ np.uint64(salt)), out=sums[1:])
                prints.append(pa.array(signed(sums[offsets[1:]] - sums[offsets[:-1]])))
            sigs = iter(sig)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), *prints, pa.array([next(sigs).tobytes() if x else None for x in some], pa.binary())],
                ["doc_id", "n", "p1", "p2", "sig"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, p1 long, p2 long, sig binary")


def _keys(reps: DataFrame) -> DataFrame:
    """(key, d1, d2, id) of each order: a hash of its number and first minima, and the four after them."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, ids = _matrix(batch), batch.column("id")
            for t in range(ORDERS):
                own = sig[:, (np.arange(2 * DEPTH) + t * DEPTH) % HASHES].astype(np.uint64)
                key = np.full(len(sig), mixed(np.array([t], np.uint64))[0])
                for k in range(DEPTH):
                    key = mixed(key ^ own[:, k])
                deep = [signed(own[:, k] << np.uint64(32) | own[:, k + 1]) for k in (DEPTH, DEPTH + 2)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), *map(pa.array, deep), ids], ["key", "d1", "d2", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, d1 long, d2 long, id long")


def _matrix(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)


def regions(reps: DataFrame, stage: Stage) -> DataFrame:
    """(key, d1, d2, id, count) of the documents (id, sig) that share a region, with its number of documents."""
    keys = stage.write(_keys(reps), "keys")
    counts = keys.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("count")).where("count > 1")
    counts = stage.write(counts, "counts")  # of a table, not of the sum's own exchange, the join can be split
    out = stage.write(keys.join(counts, F.col("key") == F.col("k")).drop("k"), "shared")
    stage.drop("keys", "counts")
    return out


def _alike(n: np.ndarray, sig: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    """Whether rows i and j may be linked, by their sizes and signatures."""
    ok = 100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
    ok[ok] = (sig[i[ok]] == sig[j[ok]]).sum(axis=1) >= AGREE
    return ok


def _ordered(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def neighbours(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of rows (key, d1, d2, id, n, sig): each with the one before it in its order, and with the first of its region.

    The orders are cut into ranges, so a region of any size is spread over tasks;
    each range has a first of its own.
    """

    def run(batches):
        held = None  # the first row of the last region, and the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*(batch.column(k).to_numpy() for k in ("key", "id", "n")), _matrix(batch)]
            begin = 0
            if held is not None:
                begin, now = len(held[0]), [np.concatenate(x) for x in zip(held, now, strict=True)]
            key, ids, n, sig = now
            at = np.arange(len(key))
            first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
            i = at[max(begin, 1) :]
            i, j = np.concatenate([i, i]), np.concatenate([i - 1, first[i]])
            ok = (key[i] == key[j]) & (ids[i] != ids[j])
            i, j = i[ok], j[ok]
            ok = _alike(n, sig, i, j, threshold)
            if ok.any():
                yield _ordered(ids[i[ok]], ids[j[ok]])
            held = [x[[first[-1], len(key) - 1]] for x in now]

    order = ("key", "d1", "d2", "id")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("key", "id", "n", "sig").mapInArrow(run, "a long, b long").distinct()


def _pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of rows (key, id, n, sig, label) of one small region that may be linked and differ in label."""

    def compare(key, ids, n, label, sig):
        a, b = [], []
        for step in range(1, len(key)):
            i = np.flatnonzero((key[step:] == key[:-step]) & (label[step:] != label[:-step]))
            if not len(i) and not (key[step:] == key[:-step]).any():
                break
            i = i[_alike(n, sig, i, i + step, threshold)]
            a.append(ids[i]), b.append(ids[i + step])
        return _ordered(np.concatenate(a), np.concatenate(b)) if a else None

    def run(batches):
        held = None  # the rows of the last region, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*(batch.column(k).to_numpy() for k in ("key", "id", "n", "label")), _matrix(batch)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            held = [x[cut:] for x in now]
            if cut and (out := compare(*(x[:cut] for x in now))) is not None:
                yield out
        if held is not None and (out := compare(*held)) is not None:
            yield out

    dealt = rows.repartition("key").sortWithinPartitions("key", "id")
    return dealt.select("key", "id", "n", "label", "sig").mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, items binary): the full sorted sets of the documents in ids (id)."""

    def run(batches):
        for batch in sliced(batches, "text"):
            items, offsets = shingle_sets(batch, shingle)
            raw, cuts = items.tobytes(), (offsets * 8).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["id", "items"])

    chosen = docs.join(small_side(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi")
    return chosen.mapInArrow(run, "id long, items binary").where(F.length("items") > 0)


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= threshold * union."""

    def run(batches):
        for batch in sliced(batches, "x"):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _tokens(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, c), counted by batch, and (id, p, token), of sets (id, p, items)."""

    def count(batches):
        for batch in sliced(batches, "items"):
            token, c = np.unique(np.frombuffer(b"".join(batch.column("items").to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(c)], ["token", "c"])

    def each(batches):
        for batch in sliced(batches, "items"):
            items = batch.column("items").to_pylist()
            at = pa.array(np.repeat(np.arange(len(items)), [len(x) // 8 for x in items]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("p").take(at), pa.array(np.frombuffer(b"".join(items), np.int64))], ["id", "p", "token"])

    counted = sets.select("items").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    return counted, sets.select("id", "p", "items").mapInArrow(each, "id long, p long, token long")


def _links(rows: DataFrame, threshold: int) -> DataFrame:
    """Confirmed links (a, b) between labels of rows (block, across, side, id, n, label, items), as many as join them.

    Rows of a block hold one shingle, at which their ``items`` begin. Of a block
    ``across`` two cells, only rows of different sides are compared.
    """

    def compare(across, side, ids, n, label, items):
        code, a, b = np.unique(label, return_inverse=True)[1], [], []
        size, other, own, mark = np.array([len(x) for x in items]), np.flatnonzero(side == 1), None, None
        for i in np.flatnonzero(side == 0).tolist():
            j = other if across else np.arange(i + 1, len(ids))
            need = -(-threshold * (n[i] + n[j]) // (100 + threshold))
            ok = (code[j] != code[i]) & (np.minimum(size[i], size[j]) >= need)
            j, need = j[ok], need[ok]
            if not len(j):
                continue
            if own is None:
                number = np.unique(np.concatenate(items), return_inverse=True)[1]
                own, mark = np.split(number, np.cumsum(size)[:-1]), np.zeros(number.max() + 1, bool)
            mark[own[i]] = True
            both = np.add.reduceat(mark[np.concatenate([own[k] for k in j])], np.r_[0, np.cumsum(size[j])[:-1]], dtype=np.int64)
            mark[own[i]] = False
            for k in j[both >= need].tolist():
                if code[k] != code[i]:
                    code[code == code[k]] = code[i]
                    a.append(min(ids[i], ids[k])), b.append(max(ids[i], ids[k]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def done(held):
        return compare(held["across"][0][0], *(np.concatenate(held[k]) for k in ("side", "id", "n", "label")), held["items"])

    def run(batches):
        held, block = None, None  # the rows of the last block, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("block", "across", "side", "id", "n", "label")}
            lists = batch.column("items")
            values, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            cuts = np.r_[0, np.flatnonzero(np.diff(now["block"])) + 1, batch.num_rows].tolist()
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held is not None and now["block"][s] != block:
                    yield done(held)
                    held = None
                if held is None:
                    held, block = {k: [] for k in ("across", "side", "id", "n", "label", "items")}, now["block"][s]
                for k in held:
                    if k == "items":
                        held[k].extend(values[bounds[r] : bounds[r + 1]] for r in range(s, e))
                    else:
                        held[k].append(now[k][s:e])
        if held is not None:
            yield done(held)

    dealt = rows.repartition("block").sortWithinPartitions("block")
    return dealt.select("block", "across", "side", "id", "n", "label", "items").mapInArrow(run, "a long, b long").distinct()


def rare_links(sets: DataFrame, threshold: int, stage: Stage) -> DataFrame:
    """(a, b), links between different labels that join all that can be joined, of sets (id, label, items)."""
    sets = sets.select("id", "label", F.xxhash64("items").alias("p"), F.expr("length(items) div 8").alias("n"), "items").distinct()
    sets = stage.write(sets, "dense_sets")
    counted, each = _tokens(sets)
    common = stage.write(counted.where("c > 1").withColumnRenamed("token", "t"), "common")
    held = each.join(common, F.col("token") == F.col("t")).groupBy("id", "p").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("held"))
    # What only one document holds comes first in its order, and can't be shared.
    ranked = sets.drop("items").join(held, ["id", "p"]).withColumn("held", F.transform("held", lambda x: x.token))
    ranked = ranked.withColumn("early", F.size("held") - F.ceil(F.col("n") * threshold / 100).cast("int") + 1).where("early > 0")
    ranked = stage.write(ranked, "ranked")
    early = ranked.select("id", "p", "label", F.size("held").alias("size"), F.posexplode(F.slice("held", F.lit(1), F.col("early"))).alias("at", "token"))
    met = early.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("count"), F.sum("size").alias("items"), F.min("label").alias("x"), F.max("label").alias("y"))
    parts = F.greatest(F.ceil(F.col("count") / CELL), F.ceil(F.col("items") / CELL_ITEMS))
    met = stage.write(met.where("x <> y").select("t", parts.alias("parts")), "met")
    cell = early.join(met, F.col("token") == F.col("t")).withColumn("cell", F.pmod(F.xxhash64("id", "p", "token"), "parts"))
    cell = cell.select("id", "p", "token", "at", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("with"))
    block = F.xxhash64("token", F.least("cell", "with"), F.greatest("cell", "with"))
    dealt = cell.select("id", "p", "at", block.alias("block"), (F.col("cell") != F.col("with")).alias("across"), (F.col("cell") > F.col("with")).cast("int").alias("side"))
    dealt = stage.write(dealt, "dealt").join(ranked, ["id", "p"])
    return _links(dealt.select("block", "across", "side", "id", "n", "label", F.expr("slice(held, at + 1, size(held))").alias("items")), threshold)


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable) and kept of every document.

    Documents are linked whose sets of ``shingle``-word shingles, with A-Z in
    lower case, have 100 * intersection >= threshold * union.
    """
    stage = Stage(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    all_ = stage.write(signatures(docs, shingle), "signatures")
    some = all_.where("n > 0 AND doc_id IS NOT NULL")
    groups = stage.write(some.groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("rep")), "groups")
    reps = some.join(groups.select("n", "p1", "p2", F.col("rep").alias("doc_id")), ["doc_id", "n", "p1", "p2"], "left_semi")
    reps = stage.write(reps.select(F.col("doc_id").alias("id"), "n", "sig"), "reps")
    shared = regions(reps, stage)
    first = stage.write(neighbours(shared.join(reps, "id"), threshold), "first")
    sets = stage.write(sets_of(docs, shared.select("id").distinct(), shingle), "sets")
    links = stage.write(confirm(first, sets, threshold), "links_first")
    label = stage.write(components(links, stage, "one"), "labels").select("id", F.col("component").alias("label"))
    again = stage.write(shared.select("key", "id", "count").join(label, "id", "left").withColumn("label", F.coalesce("label", "id")), "again")
    several = again.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("k")
    again = stage.write(again.join(stage.write(several, "several"), F.col("key") == F.col("k")).drop("k"), "open")
    stage.drop("shared", "again")
    second = stage.write(_pairs(again.where(F.col("count") <= REGION).join(reps, "id"), threshold), "second")
    third = rare_links(sets.join(again.where(F.col("count") > REGION).select("id", "label").distinct(), "id"), threshold, stage)
    links = stage.write(links.unionByName(confirm(second, sets, threshold)).unionByName(third), "links")
    stage.drop("sets", "open", "dense_sets", "ranked", "dealt", "common", "met")

    # Rows of one doc_id with different sets are one document: their groups are linked through it.
    members = some.join(groups, ["n", "p1", "p2"]).select("doc_id", "rep")
    links = links.unionByName(members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b"))
    label = components(links, stage, "two")
    final = groups.join(label, F.col("rep") == F.col("id"), "left").select("n", "p1", "p2", F.coalesce("component", "rep").alias("component_id"))
    out = all_.drop("sig").join(final, ["n", "p1", "p2"], "left")
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The query of every document, for tables that DuckDB can hold.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
item AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM item a JOIN item b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = a"""
