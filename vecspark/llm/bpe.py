"""Byte-pair encoding and decoding with a contiguous rank array for each word.

A text is cut into words by the pattern of the vocabulary. A short word is held
as two arrays, its parts and the ranks of adjacent parts; the least rank is
looked for again and again, its boundary deleted and the ranks beside it
refreshed. Long words keep a heap in place of the scan, with the same merges.
Nothing is shuffled: a word's ids are kept by each task.

Defined cases: a null text is the empty text, with no ids. ``<|endoftext|>``
and other special strings become their own id, as the library does by default.
Ids that the vocabulary lacks can't be decoded and raise an error. Rows are
worked on one by one, so repeated rows, ties and empty tables need no rule;
the result has ``doc_id`` and the columns below only, whatever else the input has.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import sliced

#: The pattern that byte-level vocabularies of this kind cut words by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 128
#: Words whose ids a task keeps at most.
KEPT_WORDS = 250_000
NONE = 1 << 60
#: Documents of a batch that the JVM gets back at once, in bytes of text.
PIECE = 1 << 21


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in out)
    return out | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special strings of a byte-level vocabulary file."""

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.first = [vocab[letters[b]] for b in range(256)]
        self.pairs = {(vocab[a] << 20) | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(PATTERN).findall
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest))) if longest else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        if len(word) > LONG_WORD:
            return self.merge_long(word)
        pair = self.pairs.get
        parts = [self.first[b] for b in word]
        ranks = [pair((a << 20) | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pair((parts[i - 1] << 20) | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = pair((parts[i] << 20) | parts[i + 1], NONE)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """As ``merge``, in n log n steps: the least rank, leftmost first, comes from a heap."""
        pair, n = self.pairs.get, len(word)
        parts = [self.first[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pair((parts[i] << 20) | parts[i + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or pair((parts[i] << 20) | parts[j], NONE) != rank:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := pair((parts[i] << 20) | parts[after[i]], NONE)) < NONE:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := pair((parts[before[i]] << 20) | parts[i], NONE)) < NONE:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in parts if p >= 0]


class Kept(dict):
    """Word to its ids as little-endian bytes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.vocabulary.merge(word.encode()), "<u4").tobytes()
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


_loaded: dict[int, Vocabulary] = {}


def _of(text: str) -> Vocabulary:
    """The vocabulary of a file's text, read once by a worker."""
    key = hash(text)
    if key not in _loaded:
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def encode_text(text: str, vocabulary: Vocabulary, kept: Kept) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    get = kept.__getitem__
    if vocabulary.cut is None or not vocabulary.cut.search(text):
        return b"".join(map(get, vocabulary.words(text)))
    out, at = [], 0
    for m in vocabulary.cut.finditer(text):
        out += map(get, vocabulary.words(text[at : m.start()]))
        out.append(np.array([vocabulary.special[m[0]]], "<u4").tobytes())
        at = m.end()
    return b"".join([*out, *map(get, vocabulary.words(text[at:]))])


def decode_ids(ids: bytes, vocabulary: Vocabulary) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _vocabulary(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:  # the driver's own file, of fixed size
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens long and ids binary (little-endian unsigned 32-bit) of every whole text.

    With ``decoded``, also the text that the ids give, made in the same pass.
    """
    spec = _vocabulary(docs, path)

    def run(batches):
        vocabulary = _of(spec.value)
        kept = Kept(vocabulary)
        for batch in sliced(batches, "text", PIECE):
            ids = [encode_text(t or "", vocabulary, kept) for t in batch.column("text").to_pylist()]
            if len(kept) > KEPT_WORDS:
                kept.clear()
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array([decode_ids(x, vocabulary) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the decoded text beside the ids (null ids: empty)."""
    spec = _vocabulary(encoded, path)

    def run(batches):
        vocabulary = _of(spec.value)
        for batch in sliced(batches, "ids", PIECE):
            decoded = [decode_ids(x or b"", vocabulary) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], [*batch.schema.names, "decoded"])

    plain = encoded.select("doc_id", "n_tokens", "ids")
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded again."""
    return encode(docs, path, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
