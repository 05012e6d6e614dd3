"""Evaluation and benchmark runs, the commands, pruned scans, files of saved indexes."""

import os

import numpy as np
import pytest

from tests.test_vectors import table
from vektorium import __main__ as commands
from vektorium.ingest import embed
from vektorium.operators import evaluate, programs
from vektorium.operators.index import HnswIndex, IvfIndex, IvfPqIndex
from vektorium.sources import files


@pytest.fixture(scope="module")
def base(spark):
    return table(spark, np.random.default_rng(9).normal(size=(400, 8)).astype(np.float32))


@pytest.fixture(scope="module")
def queries(base):
    return base.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS q")


@pytest.mark.parametrize("mode,pipeline,refine", [("full", "staged", 40), ("full", "interleaved", 40), ("ann_only", "staged", 40), ("full", "staged", 0)])
def test_evaluate(spark, base, queries, mode, pipeline, refine):
    index = IvfPqIndex.build(base, 4, 4, 4)
    r = programs.evaluate(index, base, queries, 5, 4, refine, mode=mode, pipeline=pipeline, batch=7).first()
    assert (r["queries"], r["mode"], r["pipeline"]) == (20, mode, pipeline) and r["avg_ms"] > 0 and r["qps"] > 0
    again = mode == "full" and refine > 0
    assert (r["refine_ms"] > 0) == again and r["refine_k"] == (refine if again else 0)
    assert abs(r["avg_ms"] * 20 - r["ann_ms"] - r["refine_ms"]) < 1e-6 * r["avg_ms"] * 20 + 1e-6
    assert r["recall"] >= 0.9 if again else 0 <= r["recall"] <= 1
    with pytest.raises(ValueError):
        programs.evaluate(index, base, queries, 5, mode="half")


def test_bench_exact(base, queries):
    r = programs.bench_exact(base, queries, 3, batch=10).first()
    assert r["n"] == 20 and r["bytes_per_query"] == 400 * 8 * 4 and r["gb_per_s"] > 0


def test_searches_read_the_probed_folders_only(spark, base, queries, tmp_path):
    IvfIndex.build(base, 8, None, 2).save(f"{tmp_path}/ivf")
    IvfIndex.append(f"{tmp_path}/ivf", base.where("vec_id < 3"))
    IvfPqIndex.build(base, 8, 4, 4).save(f"{tmp_path}/pq")
    for index in (IvfIndex.load(spark, f"{tmp_path}/ivf"), IvfPqIndex.load(spark, f"{tmp_path}/pq")):
        one = queries.where("query_id = 20")
        got = index.search(one, 5, 1)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(list_id" in plan or "list_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
        full = index.search(one, 5, 8)._jdf.queryExecution().executedPlan().toString()
        assert " = " not in full.split("PartitionFilters: [")[1].split("]")[0]
    lists = [d for d in os.listdir(f"{tmp_path}/ivf/lists") if d.startswith("list_id=")]
    n = sum(len([f for f in os.listdir(f"{tmp_path}/ivf/lists/{d}") if f.endswith(".parquet")]) for d in lists)
    assert n <= 8 * len(lists) + 3


def test_a_list_may_be_spread(base, queries):
    index = IvfIndex.build(base, 4, None, 2)
    rows = lambda n: sorted(map(tuple, index.search(queries, 5, 2, spread=n).collect()))
    assert rows(1) == rows(7)


@pytest.mark.parametrize("kind", ["ivf", "ivfpq", "hnsw"])
def test_commands(spark, base, queries, tmp_path, kind):
    base.write.parquet(f"{tmp_path}/base")
    base.where("vec_id % 20 = 0").selectExpr("vec_id div 20 AS vec_id", "embedding").write.parquet(f"{tmp_path}/queries")
    run = lambda *a: commands.run(spark, commands.parser().parse_args([str(x) for x in a]))
    both = ("--base", f"{tmp_path}/base", "--queries", f"{tmp_path}/queries", "--k", 5)
    assert run("check", *both[:2]).count() == 3 and run("preview", *both[:2]).count() == 24
    truth = run("truth", *both, "--metric", "l2", "--out", f"{tmp_path}/truth")
    assert truth.count() == 100 and files.truth_layout(f"{tmp_path}/truth").queries == 20
    run("build", *both[:2], "--kind", kind, "--nlist", 4, "--m", 4, "--bits", 4, "--ef", 40, "--out", f"{tmp_path}/index")
    line = run("eval", *both, "--index", f"{tmp_path}/index", "--kind", kind, "--nprobe", 4, "--refine", 40, "--truth", f"{tmp_path}/truth", "--out", f"{tmp_path}/tsv").first()["line"]
    assert line.startswith("RESULT mode=full pipeline=staged queries=20 k=5") and " recall=" in line
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/tsv").first()["queries"] == "20"
    assert run("bench", *both).first()["line"].startswith("RESULT n=20")


def test_ingest_command(spark, tmp_path):
    rows = [(0, "a", "T", "First. Second."), (1, "b", None, None), (2, "c", "U", 'quoted "text"\nover lines, and more')]
    spark.createDataFrame(rows, "doc_id long, id string, title string, abstract string").coalesce(1).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv")
    out = commands.run(spark, commands.parser().parse_args(["ingest", "--csv", f"{tmp_path}/csv", "--vectors", f"{tmp_path}/v", "--meta", f"{tmp_path}/m"])).first()
    assert (out["rows"], out["docs"], out["dim"]) == (2, 2, embed.DIM)
    assert files.vector_layout(f"{tmp_path}/v").count == 2
    meta = spark.read.json(f"{tmp_path}/m").orderBy("row").collect()
    assert [(r["row"], r["doc_idx"], r["id"], r["title"], r["section"], r["chunk_index"]) for r in meta] == [(0, 0, "a", "T", "abstract", 0), (1, 2, "c", "U", "abstract", 0)]


def test_hits(spark):
    rows = lambda x: spark.createDataFrame(x, "query_id long, rank int, vec_id long")
    got = evaluate.hits(rows([(1, 1, 5), (1, 2, 6), (1, 3, 7)]), rows([(1, 1, 6), (1, 2, 7), (2, 1, 5)]), 2)
    assert [tuple(r) for r in got.collect()] == [(1, 6)]


def test_saved_graphs(spark, base, queries, tmp_path):
    index = HnswIndex.build(base, 4, 40)
    index.save(f"{tmp_path}/g")
    rows = lambda i: sorted(map(tuple, i.search(queries, 5, 20).collect()))
    assert rows(index) == rows(HnswIndex.load(spark, f"{tmp_path}/g"))
