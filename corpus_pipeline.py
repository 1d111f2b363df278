"""From raw documents to encoded training text, in five stages.

Each stage is written as Parquet, in the folder that the cluster's executors
share, and read again as the next one's documents. All but the last return the
columns of ``documents``.

1. toxicity: documents that the span tagger finds toxic go.
2. near_dedup: of each group of near duplicates (word shingles of five, a
   similarity of 0.8 or more) the document with the least doc_id stays.
3. substring_dedup: words in windows of ``PASSAGE`` words that occur again
   anywhere go; documents that lose all their words go.
4. mixing: sources are brought to their target weights.
5. encoding: byte-pair ids of each text, decoded again.

Defined cases, in every stage: an empty table gives an empty table with the same
columns. A null text counts as empty: it is scored like one without tokens, is
nobody's copy, has no words to lose and goes in the mix, which takes nothing of
it. A null doc_id is judged by its text where that is enough (toxicity, passages,
the mix), and never a near duplicate. Of repeated rows of one doc_id and text one
stays after near_dedup; before and after it each row is handled by itself. Ties
go to the least doc_id. A text of any length is handled whole. Columns besides
doc_id, text, source and n_chars pass through unread, whatever their names, but
for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import bpe, minhash, mixing, substring, toxicity
from vecspark.llm.queries import table, vocabulary_path
from vecspark.llm.shared import Stage, small_side

SHINGLE, SIMILARITY, PASSAGE = 5, 80, 35


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose doc_id isn't in ``gone``; those with a null doc_id stay."""
    out = docs.join(small_side(gone.select(F.col("doc_id").alias("_gone")).distinct()), F.col("doc_id") == F.col("_gone"), "left_anti")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that the tagger finds toxic, learnt from labels that aren't held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    key = F.xxhash64(F.col("text").cast("string"))  # a score depends on the text alone, so rows without a doc_id are judged too
    scored = toxicity.score(docs.select(key.alias("doc_id"), "text"), toxicity.learn(docs, labels))
    found = Stage(spark, "toxic").write(scored.where("score >= 0.5").select(F.col("doc_id").alias("_key")).distinct(), "found")
    out = docs.join(small_side(found), key == F.col("_key"), "left_anti")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the least doc_id, of each group of near duplicates; one row of it."""
    near = minhash.near_duplicates(docs, SHINGLE, SIMILARITY)
    kept = _without(docs, Stage(spark, "near").write(near.where("NOT kept").select("doc_id"), "gone"))
    # Rows of one doc_id and text are copies as well.
    again = Stage(spark, "rows").write(kept.where("doc_id IS NOT NULL").groupBy("doc_id", F.xxhash64("text").alias("h")).count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    some = kept.join(again.withColumnRenamed("doc_id", "_again"), F.col("doc_id") == F.col("_again"), "left")
    return some.where("_again IS NULL").unionByName(some.where("_again IS NOT NULL").dropDuplicates(["doc_id", "text"])).drop("_again")


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without words in repeated windows."""
    out = substring.dedup(docs, PASSAGE)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated or cut as the target weights ask."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can't express the tagger or the encoder; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage.write(docs, name)
    return docs
