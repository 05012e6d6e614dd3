"""python -m vektorium COMMAND: the programs of the engine over Parquet tables with vec_id and embedding."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import embed
from .operators import evaluate, programs, search, tables
from .operators.index import HnswIndex, IvfIndex, IvfPqIndex
from .sources import files


class _Hnsw:
    """A graph index under the signature of the others: nprobe is the width of the search."""

    def __init__(self, index: HnswIndex):
        self.index = index

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        return self.index.search(queries, k, max(nprobe, k))


KINDS = {"ivf": IvfIndex, "ivfpq": IvfPqIndex, "hnsw": HnswIndex}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vektorium", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        p = sub.add_parser(name)
        for flag, kind, default in options:
            p.add_argument(f"--{flag}", type=kind, default=default, required=default is None)

    both = [("base", str, None), ("queries", str, None), ("k", int, 10)]
    command("preview", ("base", str, None), ("rows", int, 3))
    command("check", ("base", str, None))
    command("exact", *both, ("metric", str, "dot"), ("kernel", str, "numpy"), ("out", str, ""))
    command("truth", *both, ("metric", str, "dot"), ("out", str, None))
    command("bench", *both, ("metric", str, "dot"), ("batch", int, 256), ("warmup", int, 1))
    command("build", ("base", str, None), ("kind", str, "ivf"), ("nlist", int, 4096), ("m", int, 16), ("bits", int, 8), ("ef", int, 200), ("out", str, None))
    command("eval", *both, ("index", str, None), ("kind", str, "ivf"), ("nprobe", int, 16), ("refine", int, 0), ("truth", str, ""), ("mode", str, "full"), ("pipeline", str, "staged"), ("batch", int, 256), ("warmup", int, 1), ("out", str, ""))
    command("ingest", ("csv", str, None), ("vectors", str, None), ("meta", str, None), ("size", int, 2000))
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """What a command prints: a table, of which the last column of one row may be a RESULT line."""
    read = lambda path: spark.read.parquet(path).select("vec_id", "embedding")
    if args.command == "ingest":
        return embed.ingest_csv(spark, args.csv, args.vectors, args.meta, size=args.size)
    base = read(args.base)
    if args.command == "preview":
        return tables.preview(base, args.rows)
    if args.command == "check":
        dim = tables.require_sound(base)
        return tables.storage_bytes(base).where(F.col("dim") == dim)
    if args.command == "build":
        if args.kind == "ivf":
            index = IvfIndex.build(base, args.nlist)
        elif args.kind == "ivfpq":
            index = IvfPqIndex.build(base, args.nlist, args.m, args.bits)
        else:
            index = HnswIndex.build(base, args.m, args.ef)
        index.save(args.out)
        return evaluate.result_line(base.agg(F.lit(args.kind).alias("kind"), F.count("*").alias("rows")))
    q = read(args.queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    if args.command == "bench":
        return evaluate.result_line(programs.bench_exact(base, q, args.k, args.metric, batch=args.batch, warmup=args.warmup))
    if args.command in ("exact", "truth"):
        got = search.exact_search(base, q, args.k, args.metric, kernel=getattr(args, "kernel", "numpy"))
        if args.command == "truth":
            files.write_truth(got, args.out, search.dimension(base, "embedding"), base.count())
        elif args.out:
            files.write_tsv(got, args.out)
        return got
    index = KINDS[args.kind].load(spark, args.index)
    index = _Hnsw(index) if args.kind == "hnsw" else index
    truth = files.read_truth(spark, args.truth, args.k) if args.truth else None
    got = programs.evaluate(index, base, q, args.k, args.nprobe, args.refine, truth, args.mode, args.pipeline, args.batch, args.warmup)
    if args.out:
        files.write_tsv(got, args.out)
    return evaluate.result_line(got)


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName(f"vektorium {args.command}").getOrCreate()
    run(spark, args).show(100, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
