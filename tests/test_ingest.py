"""Sections, chunks, numbers and embeddings of documents."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vektorium.ingest import embed as E
from vektorium.ingest import text as T
from vektorium.sources import files


@pytest.mark.parametrize(
    "text,want",
    [
        ("front\n1 Introduction\nalpha\n2.1 Methods\nbeta\n", [("introduction", "alpha"), ("methods", "beta")]),
        ("IV. RESULTS\nx\n(2) related work\ny", [("results", "x"), ("related work", "y")]),
        ("no heading here", [("body", "no heading here")]),
        ("Conclusion\n\nReferences\n", [("body", "Conclusion\n\nReferences")]),
        ("abstract\n \nResults\nz", [("results", "z")]),
        ("", []),
        (None, []),
        (" \n ", []),
    ],
)
def test_sections(text, want):
    assert T.sections_of(text) == want


def test_abstract_comes_first():
    assert T.sections_of("Results\nz", "short") == [("abstract", "short"), ("results", "z")]
    assert T.sections_of("Abstract\nown\nResults\nz", "short") == [("abstract", "own"), ("results", "z")]


@pytest.mark.parametrize(
    "text,size,want",
    [
        ("a" * 10, 10, ["a" * 10]),
        ("a" * 11, 10, ["a" * 10, "a"]),
        ("abc. efg hijk", 10, ["abc.", "efg hijk"]),
        ("aaaaaa. bb. cc", 10, ["aaaaaa.", "bb. cc"]),
        ("一二三四五六。七八九十", 10, ["一二三四五六。", "七八九十"]),
        ("😀" * 12, 10, ["😀" * 10, "😀" * 2]),
        ("   \n ", 10, []),
        (None, 10, []),
        ("." + " " * 10 + "b", 5, [".", "b"]),
    ],
)
def test_chunks(text, size, want):
    assert T.chunks_of(text, size) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. !\n。", max_size=200), st.integers(1, 30))
def test_chunks_keep_all_but_space(text, size):
    got = T.chunks_of(text, size)
    assert all(0 < len(c) <= size and c == c.strip() for c in got)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(got)) == squeeze(text)


def docs(spark):
    rows = [(10, "a", "T", "one. " * 30, None), (11, "b", None, "", None), (12, None, "U", "two", "1 Results\nfull text\nConclusion\nend")]
    return spark.createDataFrame(rows, "doc_id long, id string, title string, abstract string, full_text string")


def test_numbers(spark):
    got = sorted(E.chunked(docs(spark), size=60).collect(), key=lambda r: r["row"])
    assert [r["row"] for r in got] == list(range(len(got)))
    assert [(r["doc_idx"], r["chunk_index"]) for r in got] == [(0, 0), (0, 1), (0, 2), (2, 0)]  # document 1 has no text and keeps its number
    assert got[-1]["embed_text"] == "U\n[SECTION: abstract]\ntwo"
    assert E.chunked(docs(spark), max_docs=1).select("doc_idx").distinct().count() == 1
    full = sorted((r["doc_idx"], r["chunk_index"], r["section"]) for r in E.chunked(docs(spark), prefer_full=True).collect())
    assert full[-3:] == [(2, 0, "abstract"), (2, 1, "results"), (2, 2, "conclusion")]
    assert E.chunked(docs(spark).limit(0)).count() == 0


def test_numbering_follows_the_key_over_many_ranges(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1009 AS k", "id").repartition(7)
    got = T.numbered(df, "k", ["id"], "n", ranges=16).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1000))


def test_embeddings(spark, tmp_path):
    got = E.ingest(docs(spark), size=60).orderBy("row")
    for r in got.collect():
        assert len(r["embedding"]) == 64 and math.isclose(sum(v * v for v in r["embedding"]), 1, rel_tol=1e-5)
    files.write_vectors(got, str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v")).count() == got.count()
    files.write_rowmeta(got, str(tmp_path / "meta"))
    lines = [json.loads(x) for p in (tmp_path / "meta").glob("part-*") for x in p.read_text().splitlines()]
    assert {"row", "doc_idx", "id", "title", "section", "chunk_index"} == set(lines[0])


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title,abstract\n1,"a ""b""\nc",\n2,NA,null\n')
    got = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), ["id", "title", "abstract", "full_text"]).orderBy("id").collect()]
    assert got == [("1", 'a "b"\nc', "", ""), ("2", "NA", "null", "")]


def test_heading_lines():
    for line, name in (("Introduction", "introduction"), ("  2.1 Methods ", "methods"), ("IV. RESULTS", "results"), ("(3) related work", "related work"), ("3) Discussion", "discussion"), ("1: abstract", "abstract"), ("2 - references", "references"), ("( ii ) background", "background")):
        assert T.heading_of(line) == name, line
    for line in ("1.Introduction", "1Introduction", "Introduction to it", "the results", "", "4", "results.", "1.) introduction", "a. methods", ". methods", "related  work", "xiv"):
        assert T.heading_of(line) is None, line
