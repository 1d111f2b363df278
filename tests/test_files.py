"""Whole runs from files, by the command line."""

import os
import stat

import numpy as np
import pytest

from vecspark import cli
from vecspark.operators import aligner
from vecspark.sources import fasta, hits, vectors

LETTERS = list("ACDEFGHIKLMNPQRSTVWY")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A corpus of families, and the first member of each family as a query."""
    rng, root, records = np.random.default_rng(1), tmp_path_factory.mktemp("files"), []
    for f in range(6):
        base = rng.choice(LETTERS, 120)
        for m in range(5):
            own = base.copy()
            own[rng.integers(0, 120, 3 * m)] = rng.choice(LETTERS, 3 * m)
            records.append((f"sp|F{f}M{m}|X", "".join(own)))
    write = lambda rows: "".join(f">{i} text\n{s[:60]}\n{s[60:]}\n" for i, s in rows)
    (root / "corpus.fasta").write_text(write(records))
    (root / "queries.fasta").write_text(write([(f"Q{f}", records[5 * f][1]) for f in range(6)]))
    return root


def read(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_run(spark, folder):
    corpus, queries, table, numpy = (str(folder / x) for x in ("corpus.fasta", "queries.fasta", "v.parquet", "v.dat"))
    for target in (table, numpy):
        cli.main(["embed", "-i", corpus, "-o", target], spark)
        with pytest.raises(FileExistsError):
            cli.main(["embed", "-i", corpus, "-o", target], spark)
    a, b = (vectors.read(spark, x).orderBy("row_idx").collect() for x in (table, numpy))
    assert [r.id for r in a] == [r.id for r in b] == [r.id for r in fasta.read_fasta(spark, corpus, ordered=True).orderBy("pos").collect()]
    assert np.allclose([r.embedding for r in a], [r.embedding for r in b])

    small = ["--ivf-kclusters", "4", "--ivf-nprobe", "4", "--recall-n", "5", "--print-topk", "3"]
    cli.main(["search", "-d", table, "-q", queries, "-o", str(folder / "report"), "-method", "ivfflat", "--blast-fasta", corpus, *small], spark)
    text = read(folder / "report")
    assert text.count("Query Protein: <Q") == 6 and text.index("<Q0>") < text.index("<Q5>") and text.count("BLAST (Ref)") == 6
    cli.main(["analyze", "-i", str(folder / "report"), "-o", str(folder / "out"), "--identity-threshold", "101"], spark)
    by = read(folder / "out" / "summary_by_method.csv").splitlines()
    assert by[0] == "method,mean_time_per_query_s,mean_qps,mean_recall_at_n,n_queries"
    rows = {x.split(",")[0]: x.split(",") for x in by[1:]}
    assert rows["BLAST (Ref)"][3:] == ["1.000000", "6"] and float(rows["IVF-Flat"][3]) > 0.9
    each = read(folder / "out" / "summary_per_query.csv").splitlines()
    assert each[0] == "query_id,method,time_per_query_s,qps,recall_at_n" and len(each) == 13
    found = read(folder / "out" / "candidates_remote_homologs.csv").splitlines()
    assert found[0] == "query_id,method,rank,neighbor_id,l2_dist,blast_identity_pct,in_blast_top_n,bio_comment" and len(found) == 19
    first = next(x for x in found if x.startswith("Q2,IVF-Flat,1,"))
    assert first == "Q2,IVF-Flat,1,sp|F2M0|X,0.000000,100.00,Yes,--"


def test_grid_and_plot(spark, folder):
    queries, table = str(folder / "queries.fasta"), str(folder / "g.parquet")
    cli.main(["embed", "-i", str(folder / "corpus.fasta"), "-o", table], spark)
    lines = [f"Q{f}\tsp|F{f}M{m}|X\t{100 - m}\t{50 - m}\t1e-5" for f in range(6) for m in range(5)] + ["Q0\tlost\t1\t1\t1", "Q0\tshort"]
    (folder / "hits.tsv").write_text("\n".join(lines))
    cli.main(["grid", "-d", table, "-q", queries, "-o", str(folder / "grid"), "--method", "hypercube", "--hits", str(folder / "hits.tsv"), "--recall-n", "5",
              "--hc-kproj-grid", "2, 3", "--hc-w-grid", "1.0", "--hc-M-grid", "100", "--hc-probes-grid", "8"], spark)
    text = read(folder / "grid").splitlines()
    assert text[0] == "avg_recall,avg_time_per_query_s,build_time_s,method,param_M,param_kproj,param_probes,param_w,qps,recall_n" and len(text) == 3
    assert all(float(x.split(",")[0]) > 0.9 for x in text[1:])
    (folder / "none").mkdir()
    (folder / "none" / "part-0.csv").write_text("method,qps,avg_recall\n")
    with pytest.warns(UserWarning, match="no rows|not exist"):
        assert hits.read_grids(spark, [str(folder / "grid"), str(folder / "none"), str(folder / "missing")]).count() == 2
    with pytest.raises(ValueError):
        cli.main(["grid", "-d", table, "-q", queries, "-o", "x", "--method", "lsh", "--hits", "y", "--lsh-k-grid", " , "], spark)


def test_subset(spark, folder):
    cli.main(["subset", "-i", str(folder / "corpus.fasta"), "-o", str(folder / "head"), "-n", "3"], spark)
    assert [r.id for r in fasta.read_fasta(spark, str(folder / "head"), ordered=True).orderBy("pos").collect()] == ["sp|F0M0|X", "sp|F0M1|X", "sp|F0M2|X"]


def test_order_of_many_pieces(spark, tmp_path):
    """A file that is cut into many pieces keeps the order of its records."""
    (tmp_path / "many.fasta").write_text("".join(f">r{i}\n{'ACGT' * (i % 50)}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [r.id for r in fasta.read_fasta(spark, str(tmp_path / "many.fasta"), ordered=True).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"r{i}" for i in range(3000)]


def test_rescue_and_missing_files(spark, folder, monkeypatch):
    """Vectors that can't be written are saved elsewhere and the error stands; missing inputs have defaults."""
    corpus = str(folder / "corpus.fasta")
    with pytest.raises(OSError):
        cli.main(["embed", "-i", corpus, "-o", "/proc/none/v.dat", "--rescue-dir", str(folder / "rescue")], spark)
    assert vectors.read(spark, str(folder / "rescue" / "v.dat")).count() == 30
    monkeypatch.chdir(folder)
    with pytest.raises(FileNotFoundError):
        cli.main(["embed", "-i", "missing.fasta", "-o", "d.dat"], spark)
    (folder / "datasets").mkdir()
    (folder / "datasets" / "swissprot_50k.fasta").write_text(">only\nMKVL\n")
    monkeypatch.setattr(cli, "CORPUS", str(folder / "datasets" / "swissprot_50k.fasta"))
    cli.main(["embed", "-i", "missing.fasta", "-o", str(folder / "d.dat")], spark)
    assert [r.id for r in vectors.read(spark, str(folder / "d.dat")).collect()] == ["only"]


def test_settings():
    args = cli.parser().parse_args(["search", "-d", "d", "-q", "q", "-o", "o", "-method", "all", "--lsh-w", "2.5", "--nlsh-epochs", "3"])
    assert cli.settings(args) == {"lsh": {"w": 2.5}, "hypercube": {}, "ivfflat": {}, "ivfpq": {}, "neural": {"epochs": 3}}
    args = cli.parser().parse_args(["grid", "-d", "d", "-q", "q", "-o", "o", "--method", "ivf", "--ivf-nprobe-grid", "1,2"])
    assert cli.grids(args) == {"ivfflat": {"kclusters": [50], "nprobe": [1, 2]}, "ivfpq": {"kclusters": [50], "nprobe": [1, 2], "M": [16], "nbits": [8]}}


def test_external_aligner(spark, folder, tmp_path, monkeypatch):
    """Stand-ins for the programs: a database that is made once, and hits of every query."""
    for name, body in {
        "makeblastdb": "#!/bin/sh\necho made >> \"$6.log\"\n",
        "blastp": "#!/bin/sh\ngrep '^>' | while read -r x; do printf '%s\\tS1\\t50.0\\t10\\t1e-3\\n%s\\tS2\\t40.0\\t9\\t0.5\\tmore\\nshort\\n' \"${x#>}\" \"${x#>}\"; done\n",
    }.items():
        path = tmp_path / name
        path.write_text(body)
        path.chmod(path.stat().st_mode | stat.S_IXUSR)
    monkeypatch.setenv("PATH", f"{tmp_path}{os.pathsep}{os.environ['PATH']}")
    made = [aligner.database(str(folder / "corpus.fasta"), str(tmp_path / "db")) for _ in range(2)]
    assert made[0] == made[1] and open(f"{made[0]}.log").read() == "made\n"
    queries = spark.createDataFrame([("a", "MK"), ("b", ""), ("c", "VL")], "id string, sequence string")
    found = sorted(map(tuple, aligner.run(queries.coalesce(1), made[0], aligner=str(tmp_path / "blastp")).collect()))
    assert found == [("a", "S1", 50.0, 10.0, 0.001, 0), ("a", "S2", 40.0, 9.0, 0.5, 1), ("c", "S1", 50.0, 10.0, 0.001, 2), ("c", "S2", 40.0, 9.0, 0.5, 3)]
    with pytest.raises(FileNotFoundError):
        aligner.program("no-such-program")
