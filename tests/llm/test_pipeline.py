"""Each stage of the pipeline against brute force on its own input."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tests.llm.common import WORD, edge_rows, empty, frame
from tests.llm.test_documents import bpe_expected, near_expected, window_expected
from vecspark.llm import queries, toxicity

STAGES = dict(pipeline.STAGES)


def test_stages_are_in_order():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "encoding"]


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The input of each stage, and what the last one returns."""
    root, docs, out = tmp_path_factory.mktemp("stages"), queries.table(spark, sf, "documents"), []
    for name, stage in pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, sf).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
    return [*out, docs]


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_toxic_documents_go(spark, sf, steps):
    gone = {r.doc_id for r in toxicity.classify(steps[0], queries.table(spark, sf, "labels")).where("predicted = 1").collect()}
    assert Counter(rows(steps[1])) == Counter(r for r in rows(steps[0]) if r[0] not in gone)


def test_one_of_each_group_stays(steps):
    kept = {i for i, _, _, k in near_expected(rows(steps[1]), 5) if k}
    assert Counter(rows(steps[2])) == Counter(r for r in rows(steps[1]) if r[0] in kept)


def test_repeated_passages_go(steps):
    before = rows(steps[2])
    expected = {i: n - gone for i, n, gone, _ in window_expected(before, pipeline.PASSAGE)}
    after = dict(rows(steps[3]))
    assert {i: len(WORD.findall(t or "")) for i, t in after.items()} == {i: n for i, n in expected.items() if n or i in after}
    assert all(i in after for i, t in before if expected[i])


def test_mix_meets_targets(steps):
    from tests.llm.test_documents import mix_targets

    size, got = Counter(), Counter()
    for r in steps[3].collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    for r in steps[4].collect():
        got[r.source] += len(WORD.findall(r.text))
    assert all(abs(got[s] - t) <= 1 for s, t in mix_targets(dict(size)).items())


def test_everything_is_encoded(steps):
    assert Counter(map(tuple, steps[5].collect())) == bpe_expected(rows(steps[4]))


def test_run(spark, sf, steps):
    assert Counter(map(tuple, pipeline.run(spark, sf).collect())) == Counter(map(tuple, steps[5].collect()))


def test_awkward_rows(spark, sf):
    for docs in (frame(spark, edge_rows()), empty(spark)):
        for name in ("toxicity", "near_dedup", "substring_dedup", "mixing"):
            docs = STAGES[name](spark, docs, sf)
            assert docs.columns == frame(spark, []).columns
        STAGES["encoding"](spark, docs, sf).count()
    near = STAGES["near_dedup"](spark, frame(spark, edge_rows()), sf).collect()
    assert len([r for r in near if r.doc_id == 7]) == 1 and len([r for r in near if r.doc_id is None]) == 2
