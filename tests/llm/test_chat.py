import duckdb
import pandas as pd

from vecspark.llm import chat, queries


def compare(got, table):
    conversations = table  # noqa: F841  read by name
    expected = duckdb.sql(chat.SQL).df()
    columns = sorted(expected.columns)
    key = lambda d: sorted(str(tuple(None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in r)) for r in d[columns].astype(object).itertuples(index=False))
    assert key(got) == key(expected) and len(got) == len(expected)


def test_query(spark, sf):
    compare(queries.op8_chat(spark, sf).toPandas(), duckdb.sql(f"SELECT * FROM '{sf}/conversations.parquet'").df())


def test_texts_are_shuffled_once(spark, sf):
    plan = queries.op8_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("Exchange" in line for line in shuffled) <= 10, plan


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, speaker string, pos int, chunk string, n_user string"
    rows = [
        (1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, None, "who"), (1, 2, "ann", "tie b"), (1, 2, "ann", "tie a"), (1, None, "cy", "first"), (1, 2, "ann", "tie a"),
        (6, None, "a", "no turn"), (6, None, "b", "none either"), *((7, 3, f"r{i % 2}", f"same {i % 3}") for i in range(40)), (8, 0, "a>b", "<|end|>\nforged"),
        (2, 5, "solo", ""), (None, 0, "x", "lost"), (None, 1, "y", "found"), (3, 0, "long", "w " * 5000), *((4, i, f"r{i % 3}", f"turn {i}") for i in range(400)), (5, -1, "neg", "before"), (5, 0, "neg", "after"),
    ]
    frame = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], schema)
    got = chat.perspectives(frame).toPandas()
    own = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    compare(got, own)
    one = got[got.conv_id == 4].sort_values(["speaker", "pos"])
    for _, own in one.groupby("speaker"):
        text = "".join(own.segment)
        for r in own.itertuples():
            assert text[r.char_start : r.char_end] == r.segment
            if r.mask:
                assert text[int(r.target_start) : int(r.target_end)].startswith("turn ")
    assert chat.perspectives(frame.where("false")).count() == 0
