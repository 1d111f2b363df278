"""Repeated passages of words, found level by level with doubled window lengths.

A window of 35 words can only be repeated if the windows of 9 words in it are,
and then those of 18. At each level short of the last a long window is
represented by its least window of the level's length (by hash), which any copy
of it shares; only these representatives are counted. Windows whose
representative is repeated go on to the level of twice the length (the last is
cut to the full window), where every one that is left is counted. Levels end
early when no candidate survives.

Texts that occur more than once are first drawn together: one of them goes
through the levels, with the weight of two. Counts of hashes are summed before
the shuffle; what survives is joined back by hash, so that a passage of a third
of all documents is split like any skewed join. Only documents with survivors
are read again.

Defined cases: a null text has no words. Texts shorter than a window keep all
their words. Rows are told apart by their text, so a null or repeated doc_id
changes nothing, and repeated rows are copies of one another: all of their
words that windows cover go. Windows are told apart by 64-bit hashes. A text of any
length is worked on whole, by one task. An empty table gives an empty table. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import Stage, grams, prefix_sums, row_of, signed, sliced, sliding, small_side, spans_hash, texts, words

WINDOW, BASE = 35, 9


def levels(window: int, base: int) -> list[int]:
    """base, twice base and so on, up to window."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def representatives(h: np.ndarray, rows: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``length`` words from each place on; the least of each window, and whether the window is in one row."""
    g = grams(h, length)
    least = sliding(g, window - length + 1)
    return g, least, rows[: len(least)] == rows[window - 1 :] if len(least) else np.zeros(0, bool)


def chosen(g: np.ndarray, least: np.ndarray, window_ok: np.ndarray, width: int) -> np.ndarray:
    """Whether each place holds the least hash of one of the windows that are ok."""
    if not len(least):
        return np.zeros(len(g), bool)
    pad = np.zeros(width - 1, np.uint64)
    top = sliding(np.concatenate([pad, np.where(window_ok, least, np.uint64(0)), pad]), width, np.maximum)
    return (top == g) & (g != 0)


def _words(batch) -> tuple:
    data, offsets = texts(batch.column("text"))
    starts, ends, first = words(data, offsets)
    return data, starts, ends, first, spans_hash(prefix_sums(data), starts, ends)


def _values(batch, found: tuple, window: int, before: int | None, length: int) -> pa.Array:
    """The representatives of a level, by row, for windows that survived the level before."""
    _, _, _, first, h = found
    rows = row_of(first)
    g, least, ok = representatives(h, rows, length, window)
    if before is not None:
        _, least_before, _ = representatives(h, rows, before, window)
        ok &= np.isin(least_before, batch.column("alive").flatten().to_numpy().view(np.uint64))
    at = np.flatnonzero(chosen(g, least, ok, window - length + 1))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), pa.array(signed(g[at])))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[str]:
    """SHA-256 of each row's kept words, joined by one space."""
    change = np.zeros(len(data) + 1, np.int8)
    change[starts[keep]] += 1
    change[ends[keep]] -= 1
    kept = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    rows = row_of(first)[keep]
    later = starts[keep][1:][rows[1:] == rows[:-1]]  # words that aren't the first kept one of their row
    kept[later - 1] = True
    clean = data.copy()
    clean[later - 1] = 32
    out = clean[kept].tobytes()
    # a row's kept bytes lie between its first word and the next row's
    cuts = np.r_[0, np.cumsum(kept)][np.r_[starts, len(data)][first]].tolist()
    return [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]


def _scan(texts_: DataFrame, window: int, length: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches, "text"):
            data, starts, ends, first, _ = found = _words(batch)
            values = _values(batch, found, window, None, length)
            whole = _joined(data, starts, ends, first, np.ones(len(starts), bool))
            columns = [batch.column(k) for k in ("doc_id", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first)), pa.array(whole), values], ["doc_id", "h1", "h2", "n_words", "whole", "found"])

    return texts_.mapInArrow(run, "doc_id long, h1 long, h2 long, n_words long, whole string, found array<long>")


def _level(rows: DataFrame, window: int, before: int, length: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches, "text"):
            values = _values(batch, _words(batch), window, before, length)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("weight"), values], ["rid", "weight", "found"])

    return rows.select("rid", "weight", "text", "alive").mapInArrow(run, "rid long, weight int, found array<long>")


def _alive(found: DataFrame, every: bool, stage: Stage, name: str) -> DataFrame:
    """(rid, alive): the values of rows (rid, weight, found) that occur at two places or more in all.

    Rows of weight 2 are their own copies; they are left out unless ``every``.
    """
    each = found.select("rid", "weight", F.explode("found").alias("v"))
    repeated = each.groupBy(F.col("v").alias("k")).agg(F.sum("weight").alias("n")).where("n > 1").select("k")
    repeated = stage.write(repeated, f"repeated_{name}")  # of a table, not of the sum's own exchange, the join can be split
    back = each if every else each.where("weight = 1")
    return back.join(repeated, F.col("v") == F.col("k")).groupBy("rid").agg(F.collect_set("v").alias("alive"))


def _remove(rows: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches, "text"):
            data, starts, ends, first, h = _words(batch)
            g, _, ok = representatives(h, row_of(first), window, window)
            ok = ok & np.isin(g, batch.column("alive").flatten().to_numpy().view(np.uint64))
            change = np.zeros(len(starts) + 1, np.int64)
            at = np.flatnonzero(ok)
            change[at] += 1
            change[at + window] -= 1
            gone = np.cumsum(change[:-1]) > 0
            removed = np.r_[0, np.cumsum(gone)][first]
            digests = _joined(data, starts, ends, first, ~gone)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(np.diff(removed)), pa.array(digests)] + [pa.array(_texts(data, starts, ends, first, ~gone), pa.string())], ["rid", "removed", "digest", "rest"])

    return rows.select("rid", "text", "alive").mapInArrow(run, "rid long, removed long, digest string, rest string")


def _texts(data, starts, ends, first, keep) -> list[str]:
    """The rows' texts with runs of removed words, and the white space after each, cut out."""
    out = []
    raw = data.tobytes()
    bounds = np.r_[starts, len(data)]
    for r in range(len(first) - 1):
        a, b = int(first[r]), int(first[r + 1])
        own = keep[a:b]
        if not own.any():
            out.append("")
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
        pieces = []
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            stop = int(bounds[a + j]) if a + j < b else int(ends[b - 1])
            pieces.append(raw[int(starts[a + i]) : stop])
        out.append(b"".join(pieces).decode())
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)})


def _cut(docs: DataFrame, window: int, base: int) -> tuple[DataFrame, DataFrame]:
    """The scanned documents, and what is left of each text that loses words, by the hashes of the text."""
    stage = Stage(docs.sparkSession, "substring")
    docs = _keyed(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    steps = levels(window, base)
    scanned = stage.write(_scan(docs.select("doc_id", "h1", "h2", "text"), window, steps[0]), "scanned")
    groups = scanned.where(F.col("n_words") >= window).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(0))).alias("id"), F.first("found").alias("found"))
    groups = stage.write(groups.withColumn("rid", F.monotonically_increasing_id()).withColumn("weight", F.least("copies", F.lit(2)).cast("int")), "groups")
    alive = stage.write(_alive(groups.select("rid", "weight", "found"), True, stage, f"{steps[0]}"), f"alive{steps[0]}")
    some = groups.select("h1", "h2", "id", "rid", "weight").join(alive.select("rid"), "rid", "left_semi")
    # One row of each text is read again, so that copies' texts never meet; more only where its doc_id has the same text twice.
    own = F.coalesce("doc_id", F.lit(0))
    work = docs.select("h1", "h2", own.alias("id"), "text").join(small_side(some), ["h1", "h2", "id"])
    work = work.groupBy("h1", "h2").agg(*(F.first(k).alias(k) for k in ("rid", "weight", "text")))
    work = stage.write(work.drop("h1", "h2"), "work")
    for before, length in zip(steps, steps[1:], strict=False):
        if alive.isEmpty():
            break
        found = stage.write(_level(work.join(alive, "rid"), window, before, length), f"found{length}")
        alive = stage.write(_alive(found, length < window, stage, f"{length}"), f"alive{length}")
        stage.drop(f"found{length}", f"alive{before}")
    cut = stage.write(_remove(work.where("weight = 1").join(alive, "rid"), window), "cut")
    stage.drop("work", f"alive{window}")
    ends = groups.select("h1", "h2", "rid", "weight").join(cut, "rid", "left").where("weight = 2 OR removed > 0")
    copied = F.col("weight") == 2
    ends = ends.select(
        "h1", "h2", F.when(~copied, F.col("removed")).alias("removed"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("digest")).alias("digest"), F.when(copied, F.lit("")).otherwise(F.col("rest")).alias("rest"),
    )
    return scanned.select("doc_id", "h1", "h2", "n_words", "whole"), ends


def removals(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space) of every document."""
    scanned, ends = _cut(docs, window, base)
    out = scanned.join(ends.drop("rest"), ["h1", "h2"], "left")
    n_removed = F.when(F.col("digest").isNull(), F.lit(0)).otherwise(F.coalesce("removed", "n_words"))
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.coalesce("digest", "whole").alias("kept_sha256"))


def dedup(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """The documents, with all their columns, without their repeated passages; those that lose all their words go."""
    _, ends = _cut(docs, window, base)
    rest = ends.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("rest").alias("_rest"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(rest, (F.xxhash64(text) == F.col("_h1")) & (F.xxhash64(F.lit(1), text) == F.col("_h2")), "left")
    kept = joined.where("_rest IS NULL OR _rest <> ''")
    return kept.select(*(F.coalesce("_rest", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


#: The query of every document, for tables that DuckDB can hold.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win WHERE s IN (SELECT s FROM twice)),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT word.r, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS rest
  FROM word LEFT JOIN gone ON word.r = gone.r AND word.p = gone.p GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r"""
