"""Texts longer than the slices that tasks work on, against brute force."""

from collections import Counter

import pytest

from tests.llm.common import WORD, frame, text_of
from tests.llm.test_documents import PATH, bpe_expected, mix_targets, near_expected, suffix_expected, window_expected
from vecspark.llm import bpe, chat, langid, minhash, mixing, shared, substring, suffix, toxicity


@pytest.fixture(scope="module")
def rows():
    words = [w for i in range(40) for w in text_of(100 + i, 10_000).split()]
    long = " ".join(words)
    assert len(long) > shared.SLICE_BYTES + 100_000
    changed = [f"new{i}" if i % 50_000 == 7 else w for i, w in enumerate(words)]
    return [(1, "short text of a few words"), (2, long), (3, " ".join(changed)), (4, long[900_000:1_000_000]), (5, None), (6, text_of(9, 300))]


def got(df):
    return Counter(map(tuple, df.collect()))


def test_bpe(spark, rows):
    assert got(bpe.digests(frame(spark, rows), PATH)) == bpe_expected(rows)


def test_near_duplicates(spark, rows):
    expected = near_expected(rows, 4)
    assert got(minhash.near_duplicates(frame(spark, rows), 4)) == expected and (3, 2) in {(r[0], r[2]) for r in expected}


def test_repeated_strings(spark, rows):
    few = [(i, t and t[:1_300_000]) if i != 2 else (i, t) for i, t in rows]
    assert got(suffix.removals(frame(spark, few)).drop("rest")) == suffix_expected(few, 50)


def test_repeated_windows(spark, rows):
    assert got(substring.removals(frame(spark, rows))) == window_expected(rows, 35)


def test_languages_and_toxicity(spark, rows):
    full = [(i, t, "en", None) for i, t in rows] + [(50 + i, "été où ça " * 30, "fr", None) for i in range(8)]
    by = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, full)).collect()}
    assert by[2] == by[3] == "en" and by[50] == "fr"
    words = "vileword nastyterm grossname".split()
    marked = [(100 + i, f"{text_of(i, 40)} {words[i % 3]} {text_of(900 + i, 20)}" if i % 2 else text_of(i, 60)) for i in range(300)]
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.learn(frame(spark, marked), labels)
    toxic = rows[1][1] + " vileword nastyterm"
    found = {r.doc_id: r for r in toxicity.score(frame(spark, [*rows, (7, toxic)]), model).collect()}
    assert [toxic[s.start : s.end] for s in found[7].spans][-2:] == ["vileword", "nastyterm"] and found[7].score > found[2].score


def test_mix(spark, rows):
    full = [(i, t, "en", f"s{i % 3}") for i, t in rows]
    size = Counter()
    for _, t, _, s in full:
        size[s] += len(WORD.findall(t or ""))
    taken, target = Counter(), mix_targets(dict(size))
    source = {i: s for i, _, _, s in full}
    for r in mixing.mix(frame(spark, full)).collect():
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_chat(spark, rows):
    turns = spark.createDataFrame([(1, 0, "a", rows[1][1]), (1, 1, "b", "yes")], "conv_id long, turn long, role string, text string")
    ends = {(r.speaker, r.pos): (r.char_start, r.char_end, len(r.segment)) for r in chat.perspectives(turns).collect()}
    assert len(ends) == 4 and all(b - a == n for a, b, n in ends.values()) and ends["a", 1][0] == ends["a", 0][1]


@pytest.mark.parametrize("texts", [[None], [""], [None, "", " "]])
def test_nothing_but_empty_texts(spark, texts):
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)]).repartition(1)
    assert [r.n_shingles for r in minhash.near_duplicates(docs).collect()] == [0] * len(texts)
    assert [r.n_words for r in substring.removals(docs).collect()] == [0] * len(texts)
    assert all(r.n_removed == 0 for r in suffix.removals(docs).collect())


def test_powers_of_nothing(monkeypatch):
    import numpy as np

    monkeypatch.setattr(shared, "_powers", {})
    assert shared.prefix_sums(np.zeros(0, np.uint8)).tolist() == [0] and len(shared.grams(np.zeros(0, np.uint64), 3)) == 0
