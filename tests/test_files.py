"""Binary files: written and read again, bytes made by hand, and files that are wrong."""

import struct

import numpy as np
import pytest

from tests.test_vectors import table
from vektorium.operators import evaluate, search, tables
from vektorium.sources import files


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(4).normal(size=(37, 5)).astype(np.float32)


def header(dtype=1, dim=5, count=37, version=1, magic=files.VECTOR_MAGIC):
    return struct.pack("<QIIIIQ", magic, version, dtype, dim, 0, count).ljust(64, b"\0")


def test_bytes_are_as_specified(spark, x, tmp_path):
    assert struct.pack("<Q", files.VECTOR_MAGIC)[:2] == b"1C"
    p = str(tmp_path / "a")
    files.write_vectors(table(spark, x).repartition(4), p)
    assert open(p, "rb").read() == header() + x.tobytes()
    files.write_vectors(table(spark, x), p, layout="short")
    assert open(p, "rb").read() == struct.pack("<III", 37, 0, 5) + x.tobytes()
    files.write_vectors(table(spark, x), p, dtype="float16")
    assert open(p, "rb").read() == header(2) + x.astype("<f2").tobytes()
    q = tables.quantize_int8(table(spark, x))
    files.write_vectors(q, p, dtype="int8")
    want = q.orderBy("vec_id").collect()
    assert open(p, "rb").read() == header(3) + np.array([r["codes"] for r in want], np.int8).tobytes() + np.array([r["scale"] for r in want], "<f4").tobytes()
    assert [f.name for f in tmp_path.iterdir()] == ["a"]


@pytest.mark.parametrize("layout,dtype", [("wide", "float32"), ("short", "float32"), ("wide", "float16"), ("wide", "int8")])
def test_round_trip(spark, x, tmp_path, monkeypatch, layout, dtype):
    p = str(tmp_path / "a")
    base = table(spark, x)
    src = tables.quantize_int8(base) if dtype == "int8" else base
    files.write_vectors(src, p, layout, dtype)
    back = files.read_vectors(spark, p)
    if dtype == "int8":
        key = lambda r: (r["vec_id"], list(r["codes"]), r["scale"])
        assert sorted(map(key, back.collect())) == sorted(map(key, src.collect()))
    else:
        got = np.array([r["embedding"] for r in back.orderBy("vec_id").collect()], np.float32)
        assert (got == (x.astype(np.float16) if dtype == "float16" else x)).all()


@pytest.mark.parametrize(
    "raw",
    [b"", b"\0" * 11, header(magic=1) + b"\0" * 740, header(version=2) + b"\0" * 740, header(dtype=9) + b"\0" * 740, header(dim=0), header(count=0), header() + b"\0" * 739, header() + b"\0" * 741, header(3) + b"\0" * 185, struct.pack("<III", 2, 0, 2) + b"\0" * 15],
)
def test_wrong_files_are_refused(tmp_path, raw):
    (tmp_path / "bad").write_bytes(raw)
    with pytest.raises(ValueError):
        files.vector_layout(str(tmp_path / "bad"))


def test_wrong_tables_are_refused(spark, x, tmp_path):
    p = str(tmp_path / "a")
    for bad in (table(spark, x, list(range(1, 38))), table(spark, [[1, 2], [1, 2, 3]]), table(spark, x).limit(0)):
        with pytest.raises(Exception):
            files.write_vectors(bad, p)
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(Exception):
        files.write_vectors(table(spark, x), p, layout="short", dtype="float16")


def test_truth_files(spark, x, tmp_path):
    base = table(spark, x)
    q = base.where("vec_id < 6").selectExpr("vec_id AS query_id", "embedding AS q")
    truth = evaluate.build_ground_truth(base, q, 4)
    p = str(tmp_path / "t")
    files.write_truth(truth, p, 5, 37)
    raw = open(p, "rb").read()
    assert struct.unpack_from("<QIIIIQQ", raw) == (files.TRUTH_MAGIC, 1, 1, 4, 5, 6, 37) and len(raw) == 64 + 4 * 4 * 6
    back = files.read_truth(spark, p, k=4, dim=5, queries=6, base_rows=37)
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id").collect()))
    assert key(back) == key(truth)
    with pytest.raises(ValueError):
        files.read_truth(spark, p, k=5)
    open(p, "ab").write(b"x")
    with pytest.raises(ValueError):
        files.read_truth(spark, p)
    with pytest.raises(ValueError):
        files.write_truth(truth.where("rank < 4 OR query_id > 0"), p, 5, 37)


def test_row_access(spark, x):
    assert [r["vec_id"] for r in tables.row_at(table(spark, x), [3, 99]).collect()] == [3]
    assert search.search_first_query(table(spark, x), table(spark, x).selectExpr("vec_id AS query_id", "embedding AS q"), 1, "l2").first()["vec_id"] == 0
