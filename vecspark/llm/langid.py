"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts hashed n-grams of 1 to 3 characters by language on the
executors; the counts of (language, bucket) are summed and become one matrix of
log probabilities of fixed size, which is broadcast. Scoring gathers the rows
of a batch's n-grams from the matrix and sums them over each document: a sparse
count matrix times a dense one, without building the former.

Learning reads a bounded sample: at most about ``per_lang`` rows of each
language, by a hash of doc_id. Scoring reads every whole text.

Defined cases: a text that is null or has no letter gets ``und`` and score 0.
With nothing to learn from, every prediction is ``und``. Of equally likely
languages the first by code point is taken. A null doc_id is scored, not
learnt from, and not held out. Repeated rows are scored alike. A text of any length is
scored whole, in blocks of characters. An empty table gives an empty table. Columns other
than doc_id, text and lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import sliced, small_side, uniform

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PER_LANG = 4000
#: Characters whose n-grams are worked on at a time.
BLOCK = 1 << 19


def ngram_buckets(chars: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place."""
    if len(chars) < order:
        return np.zeros(0, np.int64)
    h = np.full(len(chars) - order + 1, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ chars[k : len(chars) - order + 1 + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64)


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _counts(texts: list[str]) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for text in texts:
        chars = _chars(text)
        for order in ORDERS:
            out += np.bincount(ngram_buckets(chars, order), minlength=BUCKETS)
    return out


def train(rows: DataFrame, per_lang: int = PER_LANG, smoothing: float = 0.5) -> dict:
    """A model from rows of (doc_id, text, lang); null langs and texts teach nothing.

    The model holds the languages and a matrix of BUCKETS rows by languages.
    """
    rows = rows.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    totals = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = small_side(totals.select("lang", (F.lit(float(per_lang)) / F.col("n")).alias("share"), "n"))
    sample = rows.join(share, "lang").where(uniform("doc_id", 7) < F.col("share")).select("text", "lang")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches, "text"):
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, found in by.items():
                sums[lang] = sums.get(lang, 0) + _counts(found)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"]
            )

    counts = sample.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    prior = dict(totals.toArrow().to_pandas().itertuples(index=False))
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((BUCKETS, len(langs)))
    for j, lang in enumerate(langs):
        own = counts.filter(pc.equal(counts.column("lang"), lang))
        table[own.column("bucket").to_numpy(), j] = own.column("n").to_numpy()
    table += smoothing
    with np.errstate(divide="ignore"):
        first = np.log([prior[x] for x in langs]) - np.log(max(1, sum(prior[x] for x in langs)))
    return {"langs": langs, "prior": first, "logp": np.log(table / table.sum(axis=0)).astype(np.float32)}


def score_texts(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its probability, of a batch at once.

    The batch's sparse matrix of (text, bucket) is never built: its entries are
    rows of the model's matrix, which are summed up text by text.
    """
    langs, logp = model["langs"], model["logp"]
    preds, scores = ["und"] * len(texts), [0.0] * len(texts)
    some = [i for i, text in enumerate(texts) if text and any(map(str.isalpha, text))] if langs else []
    if not some:
        return preds, scores
    each = [_chars(texts[i]) for i in some]
    chars, row = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
    total = np.tile(model["prior"], (len(each), 1))
    for order in ORDERS:
        at = ngram_buckets(chars, order)
        for a in range(0, len(at), BLOCK):
            own = slice(a, min(a + BLOCK, len(at)))
            inside = row[own] == row[own.start + order - 1 : own.stop + order - 1]  # of one text
            r = row[own][inside]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]][: len(r)])
            if len(first):
                total[r[first]] += np.add.reduceat(logp.take(at[own][inside], axis=0), first, axis=0, dtype=np.float64)
    top = total.argmax(axis=1)
    p = 1 / np.exp(total - total[np.arange(len(total)), top][:, None]).sum(axis=1)
    for i, best, score in zip(some, top.tolist(), p.tolist(), strict=True):
        preds[i], scores[i] = langs[best], score
    return preds, scores


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every text of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches, "text"):
            preds, scores = score_texts(batch.column("text").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """True for the rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learnt from those not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))), per_lang)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
