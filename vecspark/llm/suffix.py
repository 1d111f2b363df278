"""Repeated byte strings over all documents, by prefix-free parsing.

A rolling hash over ``GRAM`` bytes sets the triggers: a place is one if its hash
is the least in some stretch of ``length`` bytes, so that every such stretch
holds a trigger and equal stretches hold it at the same place. Triggers cut a
document into overlapping phrases: a phrase covers all stretches whose least
hash is at one and the same trigger. Every string of ``length`` bytes starts in
exactly one phrase, and no phrase of a stretch is a proper prefix of another's.

1. Triggers that occur in one document only can't be part of a repeat. They are
   found by sending each batch's distinct trigger hashes, packed, to the task
   that owns the hash.
2. What is left is parsed: the dictionary has the distinct phrases with the least
   document of each, the parse the phrases of each document in order. A phrase
   that an earlier document has is repeated as a whole.
3. Where a trigger has several phrases, the suffixes of its phrases are sorted to
   a depth of ``length`` bytes. A run of equal ones is a string of the corpus,
   and the least document of its phrases has it first. Equal strings have the
   same trigger, so triggers are sorted apart; one with more than ``GROUP``
   phrases is sorted in pieces, whose runs are put together by hash.
4. The parse puts the marked suffixes in their places in each document.

The order between strings of different triggers is not needed and not made.
Texts that are equal as a whole are first drawn together.

Defined cases: a null text is empty. Texts under ``length`` bytes keep all.
Documents are compared by doc_id; a null doc_id comes after all others and
neither gives nor gets matches, rows of one doc_id don't match each other. Of
repeated rows each gets the same result. Triggers, phrases and runs across pieces are
told apart by 64-bit hashes. A text of any length is parsed whole, by one task. An
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import Stage, prefix_sums, row_of, signed, sliced, sliding, small_side, spans_hash, texts
from vecspark.llm.substring import chosen

LENGTH, GRAM = 50, 20
#: Bytes of text whose triggers one packed message holds.
BATCH_BYTES = 1 << 25
#: Bytes of text whose triggers one task puts together; these are a hash in about 16 bytes.
PART_BYTES = 1 << 25
ONCE, TWICE, KNOWN = 0, 1, 2
#: Phrases of one trigger that one task sorts; those of triggers with more are sorted in pieces.
GROUP = 4096
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20


def _grams(sums: np.ndarray, n: int) -> np.ndarray:
    starts = np.arange(len(sums) - n)
    return spans_hash(sums, starts, starts + n) if len(starts) else np.zeros(0, np.uint64)


def _parsed(batch, length: int) -> tuple:
    """The bytes, offsets, hashes, least hash of each stretch, and whether it is in one row."""
    data, offsets = texts(batch.column("text"))
    sums = prefix_sums(data)
    g = _grams(sums, GRAM)
    least = sliding(g, length - GRAM + 1)
    inside = np.zeros(len(least), bool)
    for a, b in zip(offsets.tolist(), (offsets[1:] - length + 1).tolist(), strict=False):
        inside[a : max(a, b)] = True
    return data, offsets, sums, g, least, inside


def _pack(hashes: np.ndarray, docs: np.ndarray, ids: np.ndarray, parts: int):
    """Messages (part, blob) of one batch's distinct (document, hash) pairs."""
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    same = np.r_[False, hashes[1:] == hashes[:-1]]
    state = np.where(same, KNOWN, np.where(np.r_[same[1:], False], TWICE, ONCE)).astype(np.uint8)
    part = np.where(state == KNOWN, docs.astype(np.uint64) % np.uint64(parts), (hashes >> np.uint64(24)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((docs, part))
    hashes, docs, state, part = hashes[order], docs[order], state[order], part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    keys, blobs = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            own, local = np.unique(docs[a:b], return_inverse=True)
            head = np.array([b - a, len(own)], np.int64)
            keys.append(int(part[a]))
            blobs.append(b"".join(x.tobytes() for x in (head, hashes[a:b], ids[own], local.astype(np.uint32), state[a:b])))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, np.int64, 2).tolist()
    hashes = np.frombuffer(blob, np.uint64, n, 16)
    ids = np.frombuffer(blob, np.int64, m, 16 + 8 * n)
    docs = ids[np.frombuffer(blob, np.uint32, n, 16 + 8 * (n + m))]
    return hashes, docs, np.frombuffer(blob, np.uint8, n, 16 + 8 * (n + m) + 4 * n)


def shared_triggers(docs: DataFrame, length: int, n_bytes: int) -> DataFrame:
    """(doc_id, v): the trigger hashes of each document that are in another one too.

    Messages go to so many parts that each holds those of about ``PART_BYTES`` of
    the documents' ``n_bytes``.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))

    def send(batches):
        held, size, count = [], 0, 0
        for batch in sliced(batches, "text", SLICE):
            data, offsets, _, g, least, inside = _parsed(batch, length)
            at = np.flatnonzero(chosen(g, least, inside, length - GRAM + 1))
            rows = np.searchsorted(offsets, at, "right") - 1
            order = np.lexsort((g[at], rows))
            h, r = g[at][order], rows[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
            held.append((h[new], r[new] + count, batch.column("doc_id").to_numpy()))
            size, count = size + len(data), count + batch.num_rows
            if size >= BATCH_BYTES:
                yield _pack(*map(np.concatenate, zip(*held, strict=True)), parts)
                held, size, count = [], 0, 0
        if held:
            yield _pack(*map(np.concatenate, zip(*held, strict=True)), parts)

    def answer(batches):
        found = [_unpack(x) for batch in batches for x in batch.column("blob").to_pylist()]
        if not found:
            return
        hashes, ids, state = map(np.concatenate, zip(*found, strict=True))
        del found
        known = state == KNOWN
        h, d, s = hashes[~known], ids[~known], state[~known]
        order = np.lexsort((d, h))
        h, d, s = h[order], d[order], s[order]
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        several = np.zeros(int(first.sum()), bool)
        several[group[s == TWICE]] = True
        several[group[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])]] = True
        take = several[group] if len(h) else first
        ids, hashes = np.concatenate([ids[known], d[take]]), np.concatenate([hashes[known], h[take]])
        for a in range(0, len(ids), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + (1 << 17)]), pa.array(signed(hashes[a : a + (1 << 17)]))], ["doc_id", "v"])

    sent = docs.select("doc_id", "text").mapInArrow(send, "part int, blob binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(answer, "doc_id long, v long")


def parse(rows: DataFrame, length: int) -> DataFrame:
    """The parse, and pieces of the dictionary, of rows (doc_id, text, alive).

    Rows with ``bytes`` are of the dictionary: trigger v, phrase p, its least
    document in the batch and its bytes. Others are of the parse: phrase p of
    doc_id covers ``n`` stretches from ``at`` on.
    """

    def run(batches):
        for batch in sliced(batches, "text", SLICE):
            data, offsets, sums, _, least, inside = _parsed(batch, length)
            ok = inside & np.isin(least, batch.column("alive").flatten().to_numpy().view(np.uint64))
            new = ok.copy()
            new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
            edge = offsets[(offsets > 0) & (offsets < len(ok))]
            new[edge] = ok[edge]
            starts = np.flatnonzero(new)
            if not len(starts):
                continue
            stop = ~ok
            stop[1:] |= least[1:] != least[:-1]
            stop[edge] = True
            ends = np.flatnonzero(np.r_[stop, True])
            n = ends[np.searchsorted(ends, starts, "right")] - starts
            p = spans_hash(sums, starts, starts + n + length - 1)
            rows = np.searchsorted(offsets, starts, "right") - 1
            ids = batch.column("doc_id").to_numpy()[rows]
            none = pa.nulls(len(p), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(signed(least[starts])), pa.array(signed(p)), pa.array(starts - offsets[rows]), pa.array(n), none], ["doc_id", "v", "p", "at", "n", "bytes"]
            )
            order = np.lexsort((ids, p))
            own = order[np.r_[True, p[order][1:] != p[order][:-1]]]
            raw = data.tobytes()
            pieces = [raw[a : a + k + length - 1] for a, k in zip(starts[own].tolist(), n[own].tolist(), strict=True)]
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[own]), pa.array(signed(least[starts[own]])), pa.array(signed(p[own])), none, pa.array(n[own]), pa.array(pieces, pa.binary())],
                ["doc_id", "v", "p", "at", "n", "bytes"],
            )

    return rows.select("doc_id", "text", "alive").mapInArrow(run, "doc_id long, v long, p long, at long, n long, bytes binary")


def _sorted(column, length: int) -> tuple:
    """The suffixes of a batch's phrases in order, to a depth of ``length`` bytes.

    Bytes, the start of each suffix, the phrase it is of, its place there, the
    suffix array, and whether each in order begins a run of equal ones.
    """
    data, offsets = texts(column)
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)])
    rows = np.searchsorted(offsets, starts, "right") - 1
    view = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[starts])
    array = np.argsort(view.view(f"V{length}").ravel(), kind="stable")
    inner = view[array]
    first = np.r_[True, (inner[1:] != inner[:-1]).any(axis=1)]
    return data, starts, rows, starts - offsets[rows], array, first


def marks_within(phrases: DataFrame, length: int) -> DataFrame:
    """(q, d, k, n): suffixes k to k + n - 1 of phrase q, first in document d, start in an earlier document.

    From rows (v, p, doc_id, bytes) with all phrases of each trigger v. The
    phrases of one trigger come to one task, where their suffixes are sorted.
    """

    def answer(batch):
        _, _, rows, k, array, first = _sorted(batch.column("bytes"), length)
        ids = batch.column("doc_id").to_numpy()[rows]
        least = np.empty(len(rows), np.int64)
        least[array] = np.minimum.reduceat(ids[array], np.flatnonzero(first))[np.cumsum(first) - 1]
        hit = least < ids
        begin = hit.copy()
        begin[1:] &= ~(hit[:-1] & (rows[1:] == rows[:-1]))
        at = np.flatnonzero(begin)
        stop = ~hit
        stop[1:] |= rows[1:] != rows[:-1]
        ends = np.flatnonzero(np.r_[stop, True])
        n = ends[np.searchsorted(ends, at, "right")] - at
        return pa.RecordBatch.from_arrays([batch.column("p").take(pa.array(rows[at])), pa.array(ids[at]), pa.array(k[at]), pa.array(n)], ["q", "d", "k", "n"])

    def run(batches):
        held = None  # the phrases of the last trigger, which may go on in the next batch
        for batch in sliced(batches, "bytes", 1 << 20):
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            v = table.column("v").to_numpy()
            cut = int(np.searchsorted(v, v[-1]))
            if cut:
                yield answer(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield answer(held)

    dealt = phrases.select("v", "p", "doc_id", "bytes").repartition("v").sortWithinPartitions("v")
    return dealt.mapInArrow(run, "q long, d long, k long, n long")


def marks_across(phrases: DataFrame, length: int, stage: Stage) -> DataFrame:
    """As ``marks_within``, for triggers with too many phrases for one task.

    Each batch sorts its suffixes and gives one row for each run and phrase; the
    least documents of runs are put together by the hash of the run's string.
    """

    def run(batches):
        for batch in sliced(batches, "bytes", 1 << 19):
            data, starts, rows, k, array, first = _sorted(batch.column("bytes"), length)
            names = spans_hash(prefix_sums(data), starts[array][first], starts[array][first] + length)
            runs = np.empty(len(starts), np.uint64)
            runs[array] = names[np.cumsum(first) - 1]
            yield pa.RecordBatch.from_arrays([batch.column("p").take(pa.array(rows)), pa.array(k), pa.array(signed(runs)), batch.column("doc_id").take(pa.array(rows))], ["p", "k", "run", "doc_id"])

    strings = stage.write(phrases.select("p", "doc_id", "bytes").mapInArrow(run, "p long, k long, run long, doc_id long"), "strings")
    earliest = strings.groupBy(F.col("run").alias("r")).agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("r", "m")
    marked = strings.join(stage.write(earliest, "earliest"), F.col("run") == F.col("r")).where("m < doc_id")
    return marked.select(F.col("p").alias("q"), F.col("doc_id").alias("d"), "k", F.lit(1).cast("long").alias("n"))


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, h1, h2, n_removed, n_spans, kept_sha256, rest) of rows with marked (at, n) stretches."""

    def run(batches):
        for batch in sliced(batches, "text", SLICE):
            data, offsets = texts(batch.column("text"))
            spans = batch.column("marks")
            at, n = (spans.flatten().field(k).to_numpy() for k in (0, 1))
            rows = row_of(spans.offsets.to_numpy().astype(np.int64) - spans.offsets[0].as_py())
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, offsets[rows] + at, 1)
            np.add.at(change, offsets[rows] + at + n + length - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = offsets[(offsets > 0) & (offsets < len(data))]
            begins[edge] = gone[edge]
            count, runs = np.r_[0, np.cumsum(gone)][offsets], np.r_[0, np.cumsum(begins)][offsets]
            left, cuts = data[~gone].tobytes(), (offsets - count).tolist()
            rest = [left[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            sha = [hashlib.sha256(x).hexdigest() for x in rest]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("doc_id", "h1", "h2")), pa.array(np.diff(count)), pa.array(np.diff(runs)), pa.array(sha), pa.array(rest, pa.binary())],
                ["doc_id", "h1", "h2", "removed", "spans", "digest", "rest"],
            )

    return rows.select("doc_id", "h1", "h2", "text", "marks").mapInArrow(run, "doc_id long, h1 long, h2 long, removed long, spans long, digest string, rest binary")


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and rest of every document.

    Removed is each byte covered by a string of ``length`` bytes that also starts
    in a document with a smaller doc_id; ``rest`` are the other bytes, null where
    none is removed.
    """
    stage = Stage(docs.sparkSession, "suffix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    d = d.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    seen = stage.write(d.select("doc_id", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole")), "seen")

    numbered = seen.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= length))
    least = numbered.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    later = stage.write(numbered.join(least, ["h1", "h2"]).select("doc_id", "h1", "h2", F.col("doc_id") > F.col("least")).toDF("doc_id", "h1", "h2", "later").distinct(), "later")
    copies = later.where("later").drop("later")
    own = d.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).join(small_side(copies), ["doc_id", "h1", "h2"], "left_anti")

    n_bytes = seen.agg(F.sum("n_bytes").alias("n")).first().n or 0
    alive = stage.write(shared_triggers(own, length, n_bytes).groupBy("doc_id").agg(F.collect_set("v").alias("alive")), "alive")
    both = parse(own.select("doc_id", "text").join(alive, "doc_id"), length).withColumn("kind", F.col("at").isNull().cast("int"))
    both = stage.write(both, "parse", by="kind")
    parsed, pieces = both.where("kind = 0"), both.where("kind = 1")
    phrase = stage.write(pieces.groupBy("p").agg(F.min("doc_id").alias("first"), F.min("v").alias("v")), "phrases")
    # Sums are written before they are joined back: of a table, not of the sum's own exchange, a skewed join can be split.
    trigger = stage.write(phrase.groupBy(F.col("v").alias("t")).agg(F.count("*").alias("c")).where("c > 1"), "triggers")
    several = phrase.join(trigger, F.col("v") == F.col("t")).select(F.col("p").alias("q"), "first", "c")
    bytes_ = pieces.select("v", "p", "doc_id", "bytes").join(several, (F.col("p") == F.col("q")) & (F.col("doc_id") == F.col("first")))
    bytes_ = stage.write(bytes_.select("v", "p", "doc_id", "bytes", "c"), "bytes")
    marked = marks_within(bytes_.where(F.col("c") <= GROUP), length)
    marked = marked.unionByName(marks_across(bytes_.where(F.col("c") > GROUP), length, stage))
    marked = stage.write(marked.distinct(), "marked")
    stage.drop("alive", "bytes", "strings", "earliest", "triggers", "parse/kind=1")

    whole = parsed.join(phrase.select(F.col("p").alias("q"), "first"), F.col("p") == F.col("q")).where("doc_id > first").select("doc_id", "at", "n")
    part = parsed.join(marked.withColumnRenamed("n", "marked_n"), (F.col("p") == F.col("q")) & (F.col("doc_id") == F.col("d")))
    part = part.select("doc_id", (F.col("at") + F.col("k")).alias("at"), F.col("marked_n").alias("n"))
    marks = stage.write(whole.unionByName(part).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("marks")), "marks")
    marked_docs = own.join(small_side(marks.select("doc_id")), "doc_id", "left_semi")
    cut = stage.write(_cut(marked_docs.join(marks, "doc_id"), length).dropDuplicates(["doc_id", "h1", "h2"]), "cut")
    stage.drop("parse", "phrases", "marked", "marks")

    gone = copies.select("doc_id", "h1", "h2", F.lit(True).alias("gone"))
    out = seen.join(cut, ["doc_id", "h1", "h2"], "left").join(gone, ["doc_id", "h1", "h2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("gone"), F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("gone"), none).otherwise(F.coalesce("digest", "whole")).alias("kept_sha256"),
        F.when(F.col("gone"), F.lit("").cast("binary")).otherwise(F.col("rest")).alias("rest"),
    )


#: The query of every document, for tables that DuckDB can hold.
SQL = r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS x FROM documents),
str AS (SELECT doc_id, i, sha256(substr(x, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100)),
least AS (SELECT s, min(doc_id) AS m FROM str GROUP BY s HAVING min(doc_id) < max(doc_id)),
mark AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS begins FROM str JOIN least USING (s) WHERE m < doc_id),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mark) GROUP BY doc_id, k),
piece AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start, a, b FROM run),
cut AS (SELECT doc_id, count(*) AS spans, sum(b - a) AS removed, string_agg(substr(x, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) AS head, max(b) AS last FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""
