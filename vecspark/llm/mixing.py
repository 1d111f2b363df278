"""Mixing sources to target weights, in blocks of words, with DataFrame functions only.

The words of each source are laid end to end, in a fixed order of documents,
and packed into blocks of ``block`` words. The mix is a row of slots, each of
one block, that fill output shards of about ``shard`` slots. How many slots of
each source a shard has is drawn: every slot of a source falls to a shard at
random, so the counts are multinomial, given that a source's counts of all
shards add up to its target. Summed up over the shards, the counts say which of
a source's slots a shard has, and these run through the source's blocks by a
pseudorandom permutation of the block numbers, another one in each pass, so that
no block comes again before all have come. Slots and packed documents are joined
by source and block number. The last slot of a source is cut so that its taken
words are its target, rounded.

Draws and permutations are closed forms of a hash (swap-or-not rounds over the
exact range), so no task holds a source's blocks, and reruns agree.

Word places, and places of counts, are sums in two levels: over documents within
groups of a source by a hash, of at most about ``CELL`` documents each, and over
the groups. A source that holds a third of all rows is so spread over many groups.

Defined cases: a null or empty text has size 0 and takes part with nothing; a
null source is a source, the last one. Documents of one group come in order of
doc_id (nulls first), then size, then a hash of the text; repeated rows have
places of their own. A text of any length is split by one task, a row at a time.
Without words all targets are 0; an empty table gives an empty table. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vecspark.llm.shared import SPACES, Stage, small_side

BLOCK, SHARD, SEED = 128, 1024, 42
CAP = 3
ROUNDS = 24
#: Slots, or shards, that one row stands for before it is opened up or summed.
RUN = 4096
#: Groups of a source at least, and documents of a group at most, but for repeated rows.
CELLS, CELL = 64, 1 << 16


def word_count(text: Column) -> Column:
    """The number of words between white space (null: 0)."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).otherwise(F.lit(0)).cast("long")


def shuffled(x: Column, n: Column, keys: list[Column], back: bool = False) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 to n - 1 (``back``: of which x is the place)."""

    def swap(y, r):
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - y, n)
        return F.when(F.pmod(F.xxhash64(*keys, r, F.greatest(y, other), F.lit(1)), F.lit(2)) == 1, other).otherwise(y)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, x.cast("long"), swap)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target by source of rows (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Filled up by
    weight, a source stops at CAP times its size: in order of cap by weight,
    those are capped whose cap is under what the level then gives them. The
    windows hold a row for each source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = s.withColumn("order", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")))
    s = s.withColumn("weight", ((F.col("order") - 1) % 3 + 1).cast("double")).withColumn("cap", F.lit(CAP) * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("weight"), "order")
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("full", F.col("cap") < F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return s.select("source", "order", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def quotas(sources: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """How many slots each source fills, of rows (order, source_size, target), and how many shards there are."""
    s = sources.where("source_size > 0").withColumn("words", F.round("target").cast("long")).where("words > 0")
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("short", F.col("blocks") * block - F.col("source_size"))
    s = s.withColumn("passes", F.floor(F.col("words") / F.col("source_size"))).withColumn("rest", F.col("words") % F.col("source_size"))
    # In the last pass the short block, the last one, has a place of its own; the blocks after it come that much earlier.
    keys = [F.lit(seed), F.col("order"), F.col("passes")]
    s = s.withColumn("short_at", shuffled(F.col("blocks") - 1, F.col("blocks"), keys, back=True))
    whole = F.ceil(F.col("rest") / block)
    later = F.ceil((F.col("rest") + F.col("short")) / block)
    s = s.withColumn("last_slots", F.when(F.col("rest") == 0, 0).when(whole <= F.col("short_at"), whole).otherwise(F.greatest(F.col("short_at") + 1, later)))
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("last_slots"))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return s.withColumn("shards", F.ceil(F.sum("slots").over(everything) / shard))


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Dealt over a fixed number of partitions: rows that are few before they are opened would be put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def draws(quota: DataFrame, seed: int) -> DataFrame:
    """(order, shard, n): the number of slots of each source in each shard, multinomial over the shards."""
    runs = quota.select("order", "slots", "shards", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / RUN))).alias("run"))
    end = F.least(F.col("slots"), (F.col("run") + 1) * RUN) - 1
    drawn = _spread(runs, "order", "run").select("order", "shards", F.explode(F.sequence(F.col("run") * RUN, end)).alias("j"))
    drawn = drawn.select("order", F.pmod(F.xxhash64(F.lit(seed), F.lit("shards"), "order", "j"), "shards").alias("shard"))
    return drawn.groupBy("order", "shard").agg(F.count("*").alias("n"))


def plan(sources: DataFrame, stage: Stage, block: int, shard: int, seed: int) -> DataFrame:
    """The slots: order (of the source), pass, block, words taken from the block's start, shard, slot.

    From rows (order, source_size, target).
    """
    s = stage.write(quotas(sources, block, shard, seed), "quotas")
    n = stage.write(draws(s, seed).withColumn("run", F.floor(F.col("shard") / RUN)), "draws")
    before = W.unboundedPreceding, -1
    runs = n.groupBy("order", "run").agg(F.sum("n").alias("n"))
    runs = runs.select(F.col("order").alias("o"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(W.partitionBy("order").orderBy("run").rowsBetween(*before)), F.lit(0)).alias("offset"))
    inner = F.coalesce(F.sum("n").over(W.partitionBy("order", "run").orderBy("shard").rowsBetween(*before)), F.lit(0))
    n = n.withColumn("inner", inner).join(runs, (F.col("order") == F.col("o")) & (F.col("run") == F.col("r"))).drop("o", "r")
    slot = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("order").rowsBetween(*before)), F.lit(0))
    n = n.select("order", "shard", "n", (F.col("offset") + F.col("inner")).alias("first"), slot.alias("slot"))
    n = _spread(n, "order", "shard").join(small_side(s.drop("source").withColumnRenamed("order", "o")), F.col("order") == F.col("o")).drop("o")
    j = n.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).withColumn("j", F.col("first") + F.col("k"))
    j = j.withColumn("pass", F.floor(F.col("j") / F.col("blocks"))).withColumn("at", F.col("j") % F.col("blocks"))
    j = j.withColumn("block", shuffled(F.col("at"), F.col("blocks"), [F.lit(seed), F.col("order"), F.col("pass")]))
    size = F.when(F.col("block") == F.col("blocks") - 1, block - F.col("short")).otherwise(F.lit(block))
    before = F.col("at") * block - F.when(F.col("at") > F.col("short_at"), F.col("short")).otherwise(F.lit(0))
    taken = F.when(F.col("pass") < F.col("passes"), size).otherwise(F.greatest(F.lit(0), F.least(size, F.col("rest") - before)))
    return j.select("order", "pass", "block", taken.cast("long").alias("words"), "shard", (F.col("slot") + F.col("k")).alias("slot"))


def placed(docs: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source's row of words, and the sources with their targets."""
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(text).alias("size"), F.xxhash64(text).alias("hash"))
    d = stage.write(d, "sizes")
    d = d.withColumn("cell", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(max(CELLS, -(-d.count() // CELL)))))
    sources = stage.write(targets(d), "sources")
    cell = d.groupBy("source", "cell").agg(F.sum("size").alias("sum"))
    offset = F.coalesce(F.sum("sum").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cell = cell.select(F.col("source").alias("s"), F.col("cell").alias("k"), offset.alias("offset"))
    inner = W.partitionBy("source", "cell").orderBy("doc_id", "size", "hash").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    d = d.join(cell, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("k"))).withColumn("start", F.col("offset") + F.col("before"))
    s = sources.withColumnRenamed("source", "s2")
    d = d.drop("s", "k").join(s, F.col("source").eqNullSafe(F.col("s2")))
    return d.select("doc_id", "source", "size", "hash", "order", "start", "source_size", "target"), sources


def takes(docs: DataFrame, sources: DataFrame, stage: Stage, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """A row for each slot that takes words of a document: order, start, pass, lo, hi, shard, slot.

    From what ``placed`` returns; lo and hi count the document's words.
    """
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = docs.where("size > 0").select(F.col("order").alias("o"), "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("b"))
    slots = plan(sources, stage, block, shard, seed)
    both = pieces.join(slots.hint("shuffle_merge"), (F.col("o") == F.col("order")) & (F.col("b") == F.col("block")))
    lo = F.greatest(F.col("b") * block, F.col("start")) - F.col("start")
    hi = F.least(F.col("b") * block + F.col("words"), F.col("start") + F.col("size")) - F.col("start")
    return both.select("order", "start", "pass", lo.alias("lo"), hi.alias("hi"), "shard", "slot").where("hi > lo")


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and shards (that they go to) of every document."""
    stage = Stage(docs.sparkSession, "mixing")
    d, sources = placed(docs, stage)
    got = takes(d, sources, stage, block, shard, seed).groupBy("order", "start")
    got = got.agg(F.sum(F.col("hi") - F.col("lo")).alias("got"), F.size(F.collect_set("shard")).cast("long").alias("several"))
    got = got.select(F.col("order").alias("o"), F.col("start").alias("at"), "got", "several")
    out = d.join(got, (F.col("order") == F.col("o")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).cast("long").alias(k) for c, k in (("got", "taken"), ("several", "shards"))))


def mixed(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix as documents: the words that each pass takes of a document, as a row with the document's columns.

    A document that a pass takes whole keeps its text as it is; of others the
    taken words are joined by one space. n_chars, if there, is of the new text.
    Documents that the mix takes no words of, or that have none, are left out.
    """
    stage = Stage(docs.sparkSession, "mixed")
    d, sources = placed(docs, stage)
    parts = takes(d, sources, stage, block, shard, seed).groupBy("order", "start", "pass")
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_ranges"), F.sum(F.col("hi") - F.col("lo")).alias("_n"))
    names = {"_id": F.col("doc_id"), "_source": F.col("source"), "_hash": F.col("hash"), "_size": F.col("size"), "_o": F.col("order"), "_at": F.col("start")}
    d = d.where("size > 0").select(*(c.alias(k) for k, c in names.items()))
    parts = d.join(parts, (F.col("_o") == F.col("order")) & (F.col("_at") == F.col("start"))).select("_id", "_source", "_hash", "_size", "_ranges", "_n")
    parts = stage.write(parts, "parts")
    # Rows that agree in doc_id, source and text share one text, which the parts of all of them are cut from.
    keys = {"_k_id": F.col("doc_id").cast("long"), "_k_source": F.col("source").cast("string"), "_k_hash": F.xxhash64(F.col("text").cast("string"))}
    one = docs.withColumns(keys).groupBy(*keys).agg(*(F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns))
    same = F.col("_k_id").eqNullSafe(F.col("_id")) & F.col("_k_source").eqNullSafe(F.col("_source")) & (F.col("_k_hash") == F.col("_hash"))
    both = one.join(parts.hint("shuffle_merge"), same)
    words = F.split(F.btrim(F.col("text").cast("string"), F.lit(SPACES)), r"[\x20\x09-\x0D]+")
    cut = F.array_join(F.flatten(F.transform("_ranges", lambda r: F.slice(F.col("_words"), r.lo.cast("int") + 1, (r.hi - r.lo).cast("int")))), " ")
    both = both.withColumn("_words", F.when(F.col("_n") < F.col("_size"), words)).withColumn("text", F.when(F.col("_n") == F.col("_size"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(*(F.col(f"`{c}`") for c in docs.columns))
