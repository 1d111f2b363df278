"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, so tokens are labelled first: words that occur far
oftener in toxic than in other documents mark the toxic tokens of toxic
documents. On windows of so labelled tokens a chain with two states is
trained, with weights for hashed features of a word (itself, its prefix and
suffix, its length) and for transitions. Scoring runs forward and backward over
every token of a document; the marginals give the spans, and the largest
marginal and the expected number of toxic tokens the score, by a logistic
function fitted to the labelled sample.

Learning reads a bounded sample of labelled rows: at most about ``POSITIVE``
toxic and ``NEGATIVE`` other ones, by a hash of doc_id, of which near copies
(the same two least word hashes) count once, as the one of the least doc_id. A word
marks toxic tokens if at least 0.7 of its documents in the sample are toxic, four
of them at least, and this is over five standard deviations from chance; of such
words the ``LEXICON`` oddest count. The chain is fitted to at most ``WINDOWS``
windows of ``2 * AROUND`` tokens of each sampled document. What is learnt doesn't
depend on how the rows are dealt over tasks. The model has a fixed size and is
broadcast. Scoring reads every whole text and shuffles nothing.

Defined cases: a null or empty text has no tokens and gets the score of a
document without toxic tokens. Several labels of one doc_id count as the
highest; a null label or doc_id teaches nothing. Without labels of both kinds
to learn from, scores are 0. Repeated rows are scored alike. A text of any length is
tagged whole, by one task. An empty table gives an empty table. Columns other than
doc_id, text and toxic are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import Stage, sliced, uniform

POSITIVE, NEGATIVE, LEXICON = 2500, 5000, 2000
WINDOWS, AROUND, STEPS = 6, 10, 60
FEATURES, LONGEST = 1 << 16, 20.0
#: Words whose odds a task keeps at most, and bytes of text that it tags at a time.
KEPT_WORDS, SLICE = 150_000, 1 << 20
TOKEN = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """The hashed features of a word."""
    w = word.lower()
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % FEATURES for f in (f"w={w}", f"p={w[:4]}", f"s={w[-4:]}", f"n={min(len(w), 12)}", "1")]


def chain(w: np.ndarray, begins: np.ndarray, e: np.ndarray, start: float, lane: int = 64) -> np.ndarray:
    """Ratios r of state 1 to state 0 along rows that begin where ``begins``.

    r[t] = w[t] (e01 + e11 r[t-1]) / (e00 + e10 r[t-1]), and w[t] start at a
    beginning. Lanes of the sequence go side by side: first each lane's map as
    a fraction of linear functions, then the ratio that comes into each lane, then
    the ratios in it. Nothing is cut off.
    """
    n = len(w)
    lanes = max(1, -(-n // lane))
    wide = np.ones(lanes * lane)
    wide[:n] = w
    new = np.ones(lanes * lane, bool)
    new[:n] = begins
    wide, new = np.ascontiguousarray(wide.reshape(lanes, lane).T), np.ascontiguousarray(new.reshape(lanes, lane).T)
    a, b, c, d = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    (e00, e01), (e10, e11) = e
    for t in range(lane):
        x, at = wide[t], new[t]
        a, b, c, d = x * (e11 * a + e01 * c), x * (e11 * b + e01 * d), e10 * a + e00 * c, e10 * b + e00 * d
        a[at], b[at], c[at], d[at] = 0, x[at] * start, 0, 1
        if t % 8 == 7:
            top = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / top, b / top, c / top, d / top
    into, r = [], 1.0
    for p, q, s, u in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True):
        into.append(r)
        r = (p * r + q) / (s * r + u)
    out, r = np.empty_like(wide), np.array(into)
    for t in range(lane):
        r = np.where(new[t], wide[t] * start, wide[t] * (e01 + e11 * r) / (e00 + e10 * r))
        out[t] = r
    return out.T.ravel()[:n]


def forward_backward(odds: np.ndarray, first: np.ndarray, e: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward ratios, backward ratios with the token's own weight, and the odds of state 1 at each token.

    ``first`` are the n + 1 offsets of the rows' tokens.
    """
    w = np.exp(np.clip(odds, -LONGEST, LONGEST))
    begins, ends = np.zeros(len(w), bool), np.zeros(len(w), bool)
    some = np.diff(first) > 0
    begins[first[:-1][some]] = True
    ends[first[1:][some] - 1] = True
    forward = chain(w, begins, e, start)
    backward = chain(w[::-1], ends[::-1], e.T, 1.0)[::-1]
    return forward, backward, forward * backward / w


def fit(words: list[list[str]], labels: list[bytes], steps: int = STEPS, rate: float = 0.15, ridge: float = 1e-4) -> dict:
    """Weights of a chain from labelled windows, by Adam on the penalised likelihood."""
    names = {w: i for i, w in enumerate(dict.fromkeys(x for row in words for x in row))}
    at = np.fromiter((names[x] for row in words for x in row), np.int64)
    y = np.frombuffer(b"".join(labels), np.uint8).astype(float)
    first = np.r_[0, np.cumsum([len(row) for row in words])].astype(np.int64)
    feats = np.array([features(w) for w in names])
    weights, moves = np.zeros(FEATURES), np.zeros(5)  # moves: start, then 00, 01, 10, 11
    inner = np.ones(len(at), bool)
    inner[first[1:] - 1] = False
    inner = np.flatnonzero(inner)
    seen = np.bincount((2 * y[inner] + y[inner + 1]).astype(int), minlength=4).astype(float)
    mean, power = np.zeros(FEATURES + 5), np.zeros(FEATURES + 5)
    for step in range(1, steps + 1):
        odds = weights[feats].sum(axis=1)[at]
        e = np.exp(moves[1:]).reshape(2, 2)
        forward, backward, o = forward_backward(odds, first, e, float(np.exp(moves[0])))
        p = o / (1 + o)
        slope = np.bincount(at, y - p, len(names))
        g = np.bincount(feats.ravel(), np.repeat(slope, feats.shape[1]), FEATURES)
        r, q = forward[inner], backward[inner + 1]
        pairs = np.stack([np.full(len(r), e[0, 0]), e[0, 1] * q, e[1, 0] * r, e[1, 1] * r * q])
        expected = (pairs / pairs.sum(axis=0)).sum(axis=1)
        gm = np.r_[(y - p)[first[:-1]].sum(), seen - expected]
        g = np.r_[g, gm] / max(1.0, y.sum()) - ridge * np.r_[weights, moves]
        mean, power = 0.9 * mean + 0.1 * g, 0.99 * power + 0.01 * g * g
        change = rate * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
        weights, moves = weights + change[:FEATURES], moves + change[FEATURES:]
    return {"weights": weights.astype(np.float32), "moves": moves}


class Tagger:
    """A fitted chain at work, with the odds of words that it has seen."""

    def __init__(self, model: dict):
        self.weights = model["weights"]
        self.e, self.start = np.exp(model["moves"][1:]).reshape(2, 2), float(np.exp(model["moves"][0]))
        self.kept: dict[str, float] = {}

    def odds(self, words: list[str]) -> np.ndarray:
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = float(self.weights[features(w)].sum())
        return np.fromiter(map(kept.__getitem__, words), float, len(words))

    def tag(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The marginals of each text's tokens, and (largest log odds, log of expected tokens) of each text."""
        words = [TOKEN.findall(t) for t in texts]
        first = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
        odds = self.odds([x for w in words for x in w])
        _, _, o = forward_backward(odds, first, self.e, self.start)
        p = o / (1 + o)
        found = np.tile([-8.0, 0.0], (len(texts), 1))
        some = np.flatnonzero(np.diff(first))
        if len(some):
            found[some, 0] = np.clip(np.log(np.maximum.reduceat(o, first[some])), -8, 8)
            found[some, 1] = np.log1p(np.add.reduceat(np.where(p > 0.2, p, 0.0), first[some]))
        return [p[a:b] for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)], found


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights, with a constant first, by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return np.r_[w[0], np.maximum(w[1:], 0)]  # more evidence never lowers a score


def _texts(batch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def learn(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> dict | None:
    """A model from documents (doc_id, text) and labels (doc_id, toxic), or None without both kinds."""
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, "toxicity")
    label = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    label = label.agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    count = {r.toxic: r["count"] for r in label.groupBy("toxic").count().collect()}  # two rows
    if len(count) < 2:
        return None
    share = F.when(F.col("toxic") == 1, positive / count[1]).otherwise(negative / count[0])
    chosen = label.where(uniform("doc_id", 3) < share)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    # The chosen labels are bounded by the parameters.
    sample = plain.join(F.broadcast(chosen), "doc_id")

    def sketch(batches):
        for batch in sliced(batches, "text", SLICE):
            words = [sorted({w.lower() for w in TOKEN.findall(t)}) for t in _texts(batch)]
            least = [str(sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in row)[:2]) for row in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(least, pa.string()), pa.array(words, pa.list_(pa.string())), batch.column("text")], ["doc_id", "toxic", "sketch", "words", "text"])

    sample = sample.mapInArrow(sketch, "doc_id long, toxic int, sketch string, words array<string>, text string")
    sample = sample.groupBy("toxic", "sketch").agg(F.min(F.struct("doc_id", "text", "words")).alias("least"))  # the same row in every run
    sample = stage.write(sample.select("toxic", "least.*"), "sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    part = n[1] / (n[0] + n[1])
    words = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("c"), F.count("*").alias("n"))
    z = (F.col("c") - part * F.col("n")) / F.sqrt(F.col("n") * (part * (1 - part)))
    marked = words.where((F.col("c") >= min(4, n[1])) & (F.col("c") >= 0.7 * F.col("n"))).select("word", z.alias("z")).where("z > 5")
    lexicon = frozenset(r.word for r in marked.orderBy(F.desc("z"), "word").limit(LEXICON).collect())

    def windows(batches):
        for batch in sliced(batches, "text", SLICE):
            rows, tags = [], []
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist(), strict=True):
                tokens = TOKEN.findall(text)
                hits = [i for i, w in enumerate(tokens) if w.lower() in lexicon]
                spread = [len(tokens) * k // 3 for k in range(3)]
                for i in sorted({*hits[:: max(1, len(hits) // (WINDOWS - 3))][: WINDOWS - 3], *spread}):
                    own = range(max(0, i - AROUND), min(len(tokens), i + AROUND))
                    if own:
                        rows.append([tokens[j] for j in own])
                        tags.append(bytes(int(toxic and tokens[j].lower() in lexicon) for j in own))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), pa.array(tags, pa.binary())], ["words", "tags"])

    seen = sample.select("text", "toxic").mapInArrow(windows, "words array<string>, tags binary").toArrow()
    if not seen.num_rows:
        return None
    seen = sorted(zip(seen.column("words").to_pylist(), seen.column("tags").to_pylist(), strict=True))  # in an order that doesn't depend on tasks
    model = fit(*map(list, zip(*seen, strict=True)))
    sent = spark.sparkContext.broadcast(model)

    def evidence(batches):
        tagger = Tagger(sent.value)
        for batch in sliced(batches, "text", SLICE):
            _, found = tagger.tag(_texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found[:, 0]), pa.array(found[:, 1])], ["toxic", "top", "sum"])

    table = sample.select("text", "toxic").mapInArrow(evidence, "toxic int, top double, sum double").toArrow()
    x = np.c_[table.column("top").to_numpy(), table.column("sum").to_numpy()]
    y = table.column("toxic").to_numpy().astype(float)
    at = np.lexsort((x[:, 1], x[:, 0], y))
    x, y = x[at], y[at]
    # The sample holds the two kinds at other rates than the labels do.
    share = (count[1] / (count[0] + count[1])) / part
    w = _logistic(x, y)
    w[0] += np.log(share) - np.log(max(1e-9, (1 - share * part) / (1 - part)))
    stage.drop("sample")
    return model | {"score": w}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score and spans (start, end, p) of every text; spans count characters from 0."""
    schema = "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>"
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        return plain.select("doc_id", F.lit(0.0).alias("score"), F.from_json(F.lit("[]"), "array<struct<start:int,end:int,p:double>>").alias("spans"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tagger, w = Tagger(sent.value), sent.value["score"]
        for batch in sliced(batches, "text", SLICE):
            texts = _texts(batch)
            marginals, found = tagger.tag(texts)
            s = 1 / (1 + np.exp(-(w[0] + found @ w[1:])))
            spans = []
            for text, p in zip(texts, marginals, strict=True):
                places = np.flatnonzero(p >= 0.5)
                tokens = list(TOKEN.finditer(text)) if len(places) else []
                spans.append([{"start": tokens[i].start(), "end": tokens[i].end(), "p": float(p[i])} for i in places])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return plain.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document, learnt from labels that aren't held out."""
    model = learn(docs, labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
