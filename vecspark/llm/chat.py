"""Chat formatting: every conversation from the perspective of each of its speakers.

For every speaker of a conversation the whole dialogue is rendered with that
speaker as the assistant and the others as users with their names. The
rendering is kept as one row per (conversation, speaker, turn), with the place
of the turn's segment in the rendered dialogue and of the part that counts in
training, so that a conversation of any length is never held by one task; in
order of ``pos`` the segments of a speaker join to the dialogue.

Places are sums over earlier segments. They are made in two levels: within
chunks of turns, and over the chunks of a conversation. A segment's length for
a speaker is its length for anyone plus what the speaker's own turns differ by,
so both sums are taken once, over turns, before the speakers are joined.

Defined cases: a null text or role is the empty string, and the empty role is a
speaker like others. Turns come in order of turn (nulls first), then role, then
text; repeated rows are each rendered. A null conv_id is a conversation of its
own. An empty table gives no rows. A text of any length is one segment. Other
columns are not read. Marks inside roles and texts aren't escaped: turns are told
apart by pos and by the places of segments and targets, not by searching the
rendered text for marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ASSISTANT, USER, NAME, BODY, END = "<|assistant|>", "<|user", " name=", "\n", "<|end|>\n"
#: Turns of one chunk: consecutive numbers of turn that share the number divided by this.
CHUNK = 64


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, pos, role, segment, mask, char_start, char_end, target_start, target_end.

    ``mask`` is 1 for segments of the speaker, whose text and end mark are the
    target: characters target_start to target_end of the rendered dialogue
    (null where mask is 0). pos counts the turns from 0.
    """
    t = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    as_user = F.length("role") + F.length("text") + len(USER + NAME + ">" + BODY + END)
    as_self = F.length("text") + len(ASSISTANT + BODY + END)
    t = t.withColumn("chunk", F.floor(F.col("turn") / CHUNK)).withColumn("n_user", as_user.cast("long")).withColumn("less", (as_user - as_self).cast("long"))
    # Keys without nulls, so that windows and joins share one partitioning and texts are shuffled once.
    for name in ("conv_id", "chunk"):
        t = t.withColumns({f"{name}_": F.coalesce(name, F.lit(0).cast("long")), f"{name}_null": F.col(name).isNull()})
    conv = ["conv_id_", "conv_id_null"]
    chunk = [*conv, "chunk_", "chunk_null"]
    in_order = [F.desc("chunk_null"), "chunk_"]
    t = t.select(*chunk, "turn", "role", "text", "n_user", "less")

    within = W.partitionBy(*chunk).orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy(*conv).orderBy(*in_order).rowsBetween(W.unboundedPreceding, -1)
    per_chunk = t.groupBy(*chunk).agg(F.count("*").alias("n"), F.sum("n_user").alias("length"))
    per_chunk = per_chunk.select(*chunk, F.coalesce(F.sum("n").over(over), F.lit(0)).alias("turns_before"), F.coalesce(F.sum("length").over(over), F.lit(0)).alias("chars_before"))
    placed = (
        t.withColumn("pos", F.coalesce(F.count("*").over(within), F.lit(0)))
        .withColumn("at", F.coalesce(F.sum("n_user").over(within), F.lit(0)))
        .join(per_chunk, chunk)
        .select(*chunk, "role", "text", "n_user", "less", (F.col("pos") + F.col("turns_before")).alias("pos"), (F.col("at") + F.col("chars_before")).alias("at"))
    )

    # What the speaker's own turns before a chunk, and in it before a turn, take less than those of a user.
    own = t.groupBy(*chunk, F.col("role").alias("speaker")).agg(F.sum("less").alias("own"))
    grid = own.select(*conv, "speaker").distinct().join(per_chunk.select(*chunk), conv)
    by_speaker = W.partitionBy(*conv, "speaker").orderBy(*in_order).rowsBetween(W.unboundedPreceding, -1)
    grid = grid.join(own, [*chunk, "speaker"], "left").select(*chunk, "speaker", F.coalesce(F.sum("own").over(by_speaker), F.lit(0)).alias("less_before"))
    all_ = placed.join(grid, chunk)
    mine = (F.col("role") == F.col("speaker")).cast("int")
    inside = W.partitionBy(*chunk, "speaker").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("at") - F.col("less_before") - F.coalesce(F.sum(mine * F.col("less")).over(inside), F.lit(0))
    size = F.col("n_user") - mine * F.col("less")
    body = F.concat(F.lit(BODY), "text", F.lit(END))
    segment = F.when(mine == 1, F.concat(F.lit(ASSISTANT), body)).otherwise(F.concat(F.lit(USER + NAME), "role", F.lit(">"), body))
    target = F.when(F.col("mask") == 1, F.col("char_start") + len(ASSISTANT + BODY))
    conv_id = F.when(~F.col("conv_id_null"), F.col("conv_id_")).alias("conv_id")
    return (
        all_.select(conv_id, "speaker", "pos", "role", segment.alias("segment"), mine.alias("mask"), start.alias("char_start"), size.alias("size"))
        .select("conv_id", "speaker", "pos", "role", "segment", "mask", "char_start", (F.col("char_start") + F.col("size")).alias("char_end"),
                target.alias("target_start"), F.when(F.col("mask") == 1, F.col("char_start") + F.col("size")).alias("target_end"))
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t),
r AS (
  SELECT t.conv_id, s.speaker, t.pos, t.role,
         CASE WHEN t.role = s.speaker THEN '<|assistant|>' ELSE '<|user name=' || t.role || '>' END || chr(10) || t.text || '<|end|>' || chr(10) AS segment,
         CASE WHEN t.role = s.speaker THEN 1 ELSE 0 END AS mask
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY pos) AS char_end FROM r)
SELECT conv_id, speaker, pos, role, segment, mask,
       CAST(char_end - length(segment) AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end,
       CAST(CASE WHEN mask = 1 THEN char_end - length(segment) + 14 END AS BIGINT) AS target_start,
       CAST(CASE WHEN mask = 1 THEN char_end END AS BIGINT) AS target_end
FROM p"""
