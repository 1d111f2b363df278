"""The command line: embed, search, grid, analyze, plot and subset."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from vecspark.plans import files, search
from vecspark.sources import fasta, hits

METHODS = ["all", "lsh", "hypercube", "neural", "ivf", "ivfflat", "ivfpq"]
#: Option names of a method's settings, with the parameters that they set.
SETTINGS = {
    "lsh": {"lsh-k": "k", "lsh-L": "L", "lsh-w": "w"},
    "hypercube": {"hc-kproj": "kproj", "hc-w": "w", "hc-M": "M", "hc-probes": "probes"},
    "ivfflat": {"ivf-kclusters": "kclusters", "ivf-nprobe": "nprobe"},
    "ivfpq": {"ivf-kclusters": "kclusters", "ivf-nprobe": "nprobe", "pq-M": "M", "pq-nbits": "nbits"},
    "neural": {"nlsh-m": "m", "nlsh-T": "T", "nlsh-epochs": "epochs", "nlsh-layers": "layers", "nlsh-nodes": "nodes", "nlsh-lr": "lr", "nlsh-batch-size": "batch_size"},
}
REALS = {"w", "lr"}
#: Where queries and corpus are looked for if the given files are missing.
QUERIES, CORPUS = "datasets/targets.fasta", "datasets/swissprot_50k.fasta"


def _number(parameter: str, text: str):
    return float(text) if parameter in REALS else int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vecspark", description="Vector similarity search and its evaluation.")
    commands = top.add_subparsers(dest="command", required=True)

    def truth(p):
        p.add_argument("-d", "--data", required=True, help="vectors: a Parquet table or a numpy file")
        p.add_argument("-q", "--queries", required=True, help="FASTA file of the queries")
        p.add_argument("-o", "--output", required=True)
        p.add_argument("--recall-n", type=int, default=50)
        p.add_argument("--seed", type=int, default=1)
        p.add_argument("--hits", help="table of alignment hits; else the corpus is aligned")
        p.add_argument("--blast-fasta", help="FASTA file of the corpus, for the ground truth")
        p.add_argument("--blast-db-dir", help="shared folder of the aligner's databases")
        p.add_argument("--embed-model", default="kmer")
        p.add_argument("--embed-device", default="auto", choices=["auto", "cpu", "cuda"])
        p.add_argument("--embed-batch-size", type=int, default=8)

    e = commands.add_parser("embed", help="FASTA to vectors")
    e.add_argument("-i", "--input", required=True)
    e.add_argument("-o", "--output", required=True)
    e.add_argument("-model", "--model", default="kmer")
    e.add_argument("--batch-size", type=int, default=8)
    e.add_argument("--device", default="auto", choices=["auto", "cpu", "cuda"])
    e.add_argument("--overwrite", action="store_true")
    e.add_argument("--rescue-dir", help="folder for vectors that can't be written to the output")

    s = commands.add_parser("search", help="methods against a ground truth, with a report")
    truth(s)
    s.add_argument("-method", "--method", required=True, choices=METHODS)
    s.add_argument("--print-topk", type=int, default=10)
    s.add_argument("--one-by-one", action="store_true", help="time each query alone")
    g = commands.add_parser("grid", help="sweeps of a method's settings")
    truth(g)
    g.add_argument("--method", required=True, choices=METHODS)
    for option, parameter in {o: p for own in SETTINGS.values() for o, p in own.items()}.items():
        s.add_argument(f"--{option}", type=lambda t, p=parameter: _number(p, t))
        g.add_argument(f"--{option}-grid", help="values, divided by commas")

    a = commands.add_parser("analyze", help="tables of a report")
    a.add_argument("-i", "--input", required=True)
    a.add_argument("-o", "--out-dir", required=True)
    a.add_argument("--identity-threshold", type=float, default=30.0)
    a.add_argument("--require-not-in-blast", action="store_true")
    p = commands.add_parser("plot", help="recall against queries a second")
    p.add_argument("inputs", nargs="+")
    p.add_argument("-o", "--output", required=True)
    u = commands.add_parser("subset", help="the first records of a FASTA file")
    u.add_argument("-i", "--input", required=True)
    u.add_argument("-o", "--output", required=True)
    u.add_argument("-n", type=int, required=True)
    return top


def settings(args: argparse.Namespace) -> dict[str, dict]:
    """What the options set, by method."""
    found = {m: {p: getattr(args, o.replace("-", "_")) for o, p in own.items()} for m, own in SETTINGS.items()}
    return {m: {p: v for p, v in own.items() if v is not None} for m, own in found.items()}


def grids(args: argparse.Namespace) -> dict[str, dict[str, list]]:
    """The values to sweep of each chosen method; a setting without values has its default alone."""
    out = {}
    for m in search.selected(args.method):
        given = {p: getattr(args, f"{o.replace('-', '_')}_grid") for o, p in SETTINGS[m].items()}
        values = {p: [_number(p, x.strip()) for x in v.split(",") if x.strip()] for p, v in given.items() if v is not None}
        out[m] = {p: [v] for p, v in search.GRID_DEFAULTS[m].items()} | values
        if any(not v for v in out[m].values()):
            raise ValueError("a setting has no values to sweep")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"vecspark {args.command}").getOrCreate()
    if args.command == "embed":
        n = files.embed_file(spark, fasta.resolved(args.input, CORPUS), args.output, args.model, args.batch_size, args.device, args.overwrite, args.rescue_dir)
        print(f"{n} records: {args.output}")
    elif args.command in ("search", "grid"):
        queries = fasta.resolved(args.queries, QUERIES)
        target = fasta.resolved(args.blast_fasta, CORPUS) if args.blast_fasta and not args.hits else None
        given = {"hits_path": args.hits, "targets": target, "folder": args.blast_db_dir, "name": args.embed_model, "device": args.embed_device, "batch_size": args.embed_batch_size}
        if args.command == "search":
            files.search_files(spark, args.data, queries, args.output, args.method, args.recall_n, args.print_topk, args.seed, settings(args), args.one_by_one, **given)
        else:
            files.grid_files(spark, args.data, queries, args.output, grids(args), args.recall_n, args.seed, **given)
        print(args.output)
    elif args.command == "analyze":
        print(*files.analyze_file(spark, args.input, args.out_dir, args.identity_threshold, args.require_not_in_blast), sep="\n")
    elif args.command == "plot":
        rows = hits.read_grids(spark, args.inputs)
        if rows is None:
            raise FileNotFoundError(", ".join(args.inputs))
        search.plot(search.tradeoff(rows, "recall"), args.output)
    else:
        print(fasta.subset(spark, args.input, args.output, args.n))
