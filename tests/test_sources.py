import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import text as tx
from vecspark.plans import search
from vecspark.sources import fasta, hits, report, vectors

MINI = "lost line\n\n>A1 first > one\nac gt\n  nnn \n\n>B2\n> C3 spaced header\nMK\nvl\n>D4|x tail\n" + "q" * 130


def expected():
    """By hand: text before the first header goes, bodies are joined, D4 has no final newline."""
    return [("A1", "ACGTNNN"), ("B2", ""), ("C3", "MKVL"), ("D4|x", "Q" * 130)]


@pytest.mark.parametrize("strict", [False, True])
def test_fasta(spark, tmp_path, strict):
    path = tmp_path / "mini.fasta"
    path.write_text(MINI)
    got = fasta.read_fasta(spark, str(path), strict)
    assert sorted(map(tuple, got.collect())) == expected()
    assert fasta.count_records(spark, str(path)) == 4


def test_fasta_first_record_and_indented_header(spark, tmp_path):
    path = tmp_path / "two.fasta"
    path.write_text(">X1\nAA\n  >X2\nCC\n")
    assert sorted(map(tuple, fasta.read_fasta(spark, str(path), True).collect())) == [("X1", "AA"), ("X2", "CC")]
    assert fasta.count_records(spark, str(path)) == 1  # counts lines as they stand


def test_fasta_header_without_id(spark, tmp_path):
    path = tmp_path / "bad.fasta"
    path.write_text(">\nAA\n")
    with pytest.raises(Exception, match="no id"):
        fasta.read_fasta(spark, str(path)).collect()


def test_fasta_write_and_subset(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x" * 61), ("b", "y y")], "id string, sequence string")
    fasta.write_fasta(rows.coalesce(1), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == sorted([">a", "x" * 60, "x", ">b", "yy"])
    source = tmp_path / "mini.fasta"
    source.write_text(MINI)
    assert fasta.subset(spark, str(source), str(tmp_path / "sub"), 2) == 2
    assert sorted(r[0] for r in fasta.read_fasta(spark, str(tmp_path / "sub")).collect()) == ["A1", "B2"]
    with pytest.raises(ValueError):
        fasta.subset(spark, str(source), str(tmp_path / "sub"), 0)


def test_resolved(tmp_path):
    (tmp_path / "d").write_text("x")
    assert fasta.resolved(None, str(tmp_path / "d")) == str(tmp_path / "d")
    with pytest.raises(FileNotFoundError):
        fasta.resolved(str(tmp_path / "no"), str(tmp_path / "none"))


def test_numpy_store(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    rows = vectors.from_numpy(spark, x, ["a", "b|1", "c"])
    path = vectors.write_numpy(rows, str(tmp_path / "store.bin"))
    back = vectors.read_numpy(spark, path).orderBy("row_idx").collect()
    assert [r.id for r in back] == ["a", "b|1", "c"] and np.array_equal([r.embedding for r in back], x)
    np.savez(tmp_path / "v.npz", vectors=x, ids=np.array(["p", "q", "r"]))
    assert [r.id for r in vectors.read_numpy(spark, str(tmp_path / "v.npz")).orderBy("row_idx").collect()] == ["p", "q", "r"]
    np.savez(tmp_path / "w.npz", other=x)
    for bad, error in ((str(tmp_path / "w.npz"), ValueError), (str(tmp_path / "none"), FileNotFoundError)):
        with pytest.raises(error):
            vectors.read_numpy(spark, bad)
    with pytest.raises(ValueError):
        vectors.from_numpy(spark, x, ["a"])
    with pytest.raises(ValueError):
        vectors.from_numpy(spark, x[0], ["a"])
    (tmp_path / "empty.txt").write_text("\n \n")
    with pytest.raises(ValueError):
        vectors.read_ids(str(tmp_path / "empty.txt"))
    vectors.write_table(rows, str(tmp_path / "table"))
    with pytest.raises(Exception, match="already exists"):
        vectors.write_table(rows, str(tmp_path / "table"))
    vectors.write_table(rows, str(tmp_path / "table"), overwrite=True)
    vectors.write_id_list(rows.select(F.concat(F.lit(" "), "id").alias("id")), str(tmp_path / "ids"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["a", "b|1", "c"]


def test_hits(spark, tmp_path):
    path = tmp_path / "hits.tsv"
    path.write_text("q1\ts1\t50\t10.5\t1e-5\nq1\ts2\t40\t20\t0.1\textra\n\nq1\ts3\t1\t2\nq2\ts1\t99\t20\t1\nq1\ts1\t70\t10.5\t1\nq1\ts4\t1\t20\t5\n")
    h = hits.read_hits(spark, str(path))
    assert h.count() == 5
    from vecspark.operators.topk import best_per_subject, ranked_hits

    assert [(r.sseqid, r["rank"]) for r in ranked_hits(h, 3).where("qseqid = 'q1'").orderBy("rank").collect()] == [("s2", 1), ("s4", 2), ("s1", 3)]
    assert {(r.qseqid, r.sseqid): r.pident for r in best_per_subject(h).collect()}["q1", "s1"] == 50.0


def test_csv_and_grids(spark, tmp_path):
    rows = spark.createDataFrame([("lsh", 2.0, 0.5, True)], "method string, qps double, avg_recall double, ok boolean")
    hits.write_csv(rows, str(tmp_path / "one"), {"qps": "%.6f"}, sort_columns=True)
    text = "".join(p.read_text() for p in (tmp_path / "one").glob("*.csv"))
    assert text == "avg_recall,method,ok,qps\n0.5,lsh,Yes,2.000000\n"
    with pytest.warns(UserWarning, match="not exist"):
        both = hits.read_grids(spark, [str(tmp_path / "one"), str(tmp_path / "missing")])
    assert [tuple(r) for r in both.collect()] == [("lsh", 2.0, 0.5)]
    with pytest.warns(UserWarning, match="not exist"):
        assert hits.read_grids(spark, [str(tmp_path / "missing")]) is None
    assert search.tradeoff(both, "recall").count() == 1


def test_field_functions(spark):
    numbers = [0.0, 0.001234, 0.00001234, 1.0, 50.0, 99.95, 999.4, 999.6, 1900.0, 0.667, 83.3333, 123456.0, 1e10, 0.5]
    frame = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r.g for r in frame.select(tx.general(F.col("x")).alias("g")).collect()] == [f"{x:.3g}" for x in numbers]
    fields = {"31%": 31.0, "abc": 0.0, "1.9e+03 q": 1900.0, "-.5": -0.5, "": 0.0}
    got = spark.createDataFrame([(k,) for k in fields], "s string").select("s", tx.lenient_float(F.col("s")).alias("x")).collect()
    assert {r.s: r.x for r in got} == fields
    ident = spark.createDataFrame([(2.5,), (3.5,), (None,), (29.6,)], "x double").select(tx.percent(F.col("x")).alias("p")).collect()
    assert [r.p for r in ident] == ["2%", "4%", "0%", "30%"]


def test_report_round_trip(spark, tmp_path):
    summaries = spark.createDataFrame(
        [("q1", 0, "Euclidean LSH", 0.0123, 81.3, 0.125), ("q1", 1, "BLAST (Ref)", 1.5, 0.6667, 1.0), ("q2", 0, "Euclidean LSH", 0.0005, 1900.0, 0.5)],
        "query_id string, position int, method string, time_per_query_s double, qps double, recall_at_n double",
    )
    neighbors = spark.createDataFrame(
        [("q1", 0, "Euclidean LSH", 1, "sp|P1|NAME", 0.5349, 31.2, True, None), ("q1", 0, "Euclidean LSH", 2, "x", 1.0, None, None, " note ")],
        "query_id string, position int, method string, rank int, neighbor_id string, l2_dist double, blast_identity_pct double, in_blast_top_n boolean, bio_comment string",
    )
    text = report.report(summaries, neighbors, 50, 10)
    text.select("value").coalesce(1).write.text(str(tmp_path / "r"))
    s, n = report.read_report(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, s.collect())) == [("q1", "BLAST (Ref)", 1.5, 0.667, 1.0), ("q1", "Euclidean LSH", 0.012, 81.3, 0.13), ("q2", "Euclidean LSH", 0.001, 1900.0, 0.5)]
    assert [tuple(r) for r in n.orderBy("rank").collect()] == [("q1", "Euclidean LSH", 1, "sp|P1|NAME", 0.53, 31.0, True, "--"), ("q1", "Euclidean LSH", 2, "x", 1.0, 0.0, False, "note")]
