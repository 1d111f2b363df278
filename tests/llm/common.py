"""Rows that every operator has to stand: nulls, blanks, long texts, repeats, and columns with clashing names."""

import random
import re

import duckdb

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, n int, size int, h1 string, rid string, weight string, alive string, found string, "
    "label string, kept string, ids string, start int, hash string, cell string, marks string, least string, n_words int, removed string, `a.b` string"
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(words))


def frame(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns that clash with inner names."""
    full = [(*r, None, None)[:4] if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x" if "string" in f else 1.5 if "double" in f else 7 for f in SCHEMA.split(", ")[5:]]) for r in full], SCHEMA)


def edge_rows():
    base, other = text_of(1, 120), text_of(2, 400)
    return [
        (1, base, "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (4, " \t\n ", "fr", "s2"), (5, text_of(3, 6000), "en", "s1"), (6, base, "fr", None),
        (7, other, None, "s2"), (7, other, None, "s2"), (None, base, "en", "s1"), (None, None, None, None), (8, "one two", "en", "s2"), (9, "Üñí <|endoftext|> 日本 ́x", "fr", "s3"),
        (10, other.upper(), "fr", "s1"), (11, text_of(4, 50) + " " + base + "\t" + text_of(5, 50), "en", "s1"), (12, "a " * 200, "en", "s2"), (13, "!!! 123 ...", "en", "s2"),
        (14, base.replace(base.split()[60], "zzz", 1), "en", "s3"),
    ]


def documents(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
