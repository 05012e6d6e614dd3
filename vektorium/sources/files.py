"""Binary files of vectors and of ground truth as a Spark data source.

``spark.read.format("vectors")`` reads both layouts of vector files (told apart by the header and
the size of the file), in ranges of rows, one task for each range:

- *wide*: a header of 64 bytes, then rows of float32, float16 or int8; int8 has a float32 scale
  for each row after all rows.
- *short*: a header of 12 bytes (count, 0, dimensions as unsigned 32-bit), then rows of float32.

``spark.read.format("truth")`` reads ground-truth files: a header of 64 bytes and Q * k unsigned
32-bit ids, best first. Paths must be on a file system that driver and executors mount alike;
tables in object stores are better kept as Parquet, the engine's native format.

Rows have a fixed size, so tasks write their ranges of rows to their places in one file beside the
target, whose header is written first; a task that runs again writes the same bytes again. The commit
checks that the ranges cover all ids and renames the file into place; nothing passes through the driver.
"""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# fixed values of the file formats: magic numbers (little-endian unsigned 64-bit), version, type tags
VECTOR_MAGIC = 0x4E56444256454331
TRUTH_MAGIC = 0x4E56444247543031
VERSION = 1
TYPES = {1: "float32", 2: "float16", 3: "int8"}
METRIC_DOT = 1
HEADER = 64

_NUMPY = {"float32": "<f4", "float16": "<f2", "int8": "i1"}
_SCHEMAS = {"float32": "vec_id long, embedding array<float>", "float16": "vec_id long, bits binary, embedding array<float>", "int8": "vec_id long, codes array<tinyint>, scale float"}
CHUNK = 8 << 20


@dataclass(frozen=True)
class Layout:
    dtype: str
    dim: int
    count: int
    start: int

    @property
    def row_bytes(self) -> int:
        return self.dim * np.dtype(_NUMPY[self.dtype]).itemsize


def vector_layout(path: str) -> Layout:
    """The layout of a vector file; raises ValueError if the header or the size is wrong."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(HEADER)
    if len(head) == HEADER:
        magic, version, tag, dim, _, count = struct.unpack_from("<QIIIIQ", head)
        if magic == VECTOR_MAGIC and version == VERSION and tag in TYPES and dim and count:
            out = Layout(TYPES[tag], dim, count, HEADER)
            want = HEADER + count * (out.row_bytes + 4 * (out.dtype == "int8"))
            if size != want:
                raise ValueError(f"{path} has {size} bytes, its header says {want}")
            return out
    if len(head) >= 12:
        count, _, dim = struct.unpack_from("<III", head)
        if count and dim and size == 12 + 4 * count * dim:
            return Layout("float32", dim, count, 12)
    raise ValueError(f"{path} is no vector file")


@dataclass(frozen=True)
class TruthLayout:
    metric: int
    k: int
    dim: int
    queries: int
    rows: int


def truth_layout(path: str) -> TruthLayout:
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(HEADER)
    if len(head) < HEADER:
        raise ValueError(f"{path} is no truth file")
    magic, version, metric, k, dim, queries, rows = struct.unpack_from("<QIIIIQQ", head)
    if magic != TRUTH_MAGIC or version != VERSION or size != HEADER + 4 * k * queries:
        raise ValueError(f"{path} is no truth file, or its size does not fit its header")
    return TruthLayout(metric, k, dim, queries, rows)


@dataclass
class Rows(InputPartition):
    first: int
    end: int


def _ranges(n: int, row_bytes: int) -> list[Rows]:
    step = max(1, CHUNK // max(1, row_bytes))
    return [Rows(a, min(n, a + step)) for a in range(0, n, step)]


class _VectorReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.layout = path, vector_layout(path)

    def partitions(self):
        return _ranges(self.layout.count, self.layout.row_bytes)

    def read(self, rows):
        lay, n = self.layout, rows.end - rows.first
        with open(self.path, "rb") as f:
            f.seek(lay.start + rows.first * lay.row_bytes)
            x = np.frombuffer(f.read(n * lay.row_bytes), _NUMPY[lay.dtype]).reshape(n, lay.dim)
            if lay.dtype == "int8":
                f.seek(lay.start + lay.count * lay.row_bytes + 4 * rows.first)
                scale = np.frombuffer(f.read(4 * n), "<f4")
        ids = pa.array(np.arange(rows.first, rows.end))
        lists = lambda v, kind: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(v).ravel()), lay.dim).cast(pa.list_(kind))
        if lay.dtype == "float32":
            cols = {"vec_id": ids, "embedding": lists(x, pa.float32())}
        elif lay.dtype == "float16":
            cols = {"vec_id": ids, "bits": pa.array([r.tobytes() for r in x], pa.binary()), "embedding": lists(x.astype(np.float32), pa.float32())}
        else:
            cols = {"vec_id": ids, "codes": lists(x, pa.int8()), "scale": pa.array(scale)}
        yield pa.RecordBatch.from_pydict(cols)


class _TruthReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.layout = path, truth_layout(path)

    def partitions(self):
        return _ranges(self.layout.queries, 4 * self.layout.k)

    def read(self, rows):
        k, n = self.layout.k, rows.end - rows.first
        with open(self.path, "rb") as f:
            f.seek(HEADER + 4 * k * rows.first)
            ids = np.frombuffer(f.read(4 * k * n), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(np.arange(rows.first, rows.end), k)), "rank": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), "vec_id": pa.array(ids)})


@dataclass
class Part(WriterCommitMessage):
    first: int
    rows: int


class _VectorWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.format, self.dtype = options["path"], options.get("layout", "wide"), options.get("dtype", "float32")
        if self.dtype not in _NUMPY or self.format not in ("wide", "short") or (self.format == "short" and self.dtype != "float32"):
            raise ValueError("layout is 'wide' or 'short', dtype float32, float16 or int8; short files hold float32 only")
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")

        # the driver makes the file; tasks get this object with its name
        self.rows, self.dim = int(options["rows"]), int(options["dim"])
        if self.format == "short" and self.rows >= 1 << 32:
            raise ValueError("short files hold fewer than 2**32 rows")
        self.made = f"{self.path}.{uuid.uuid4().hex}"
        if self.format == "short":
            head = struct.pack("<III", self.rows, 0, self.dim)
        else:
            head = struct.pack("<QIIIIQ", VECTOR_MAGIC, VERSION, {v: k for k, v in TYPES.items()}[self.dtype], self.dim, 0, self.rows).ljust(HEADER, b"\0")
        self.start, self.row_bytes = len(head), self.dim * np.dtype(_NUMPY[self.dtype]).itemsize
        with open(self.made, "wb") as f:
            f.write(head)
            f.truncate(self.start + self.rows * (self.row_bytes + 4 * (self.dtype == "int8")))

    def write(self, batches):
        first, n = -1, 0
        with open(self.made, "r+b") as f:
            for b in batches:
                ids = b.column(b.schema.get_field_index("vec_id")).to_numpy()
                if not len(ids):
                    continue
                first = int(ids[0]) if n == 0 else first
                if (ids != np.arange(first + n, first + n + len(ids))).any() or first < 0 or first + n + len(ids) > self.rows:
                    raise ValueError("ids must be 0, 1, ... and go up by one inside a part")
                col = b.column(b.schema.get_field_index("codes" if self.dtype == "int8" else "embedding"))
                if col.null_count or (np.diff(col.offsets.to_numpy()) != self.dim).any():
                    raise ValueError("a vector is null or of another length")
                f.seek(self.start + (first + n) * self.row_bytes)
                f.write(col.flatten().to_numpy(zero_copy_only=False).astype(_NUMPY[self.dtype]).tobytes())
                if self.dtype == "int8":
                    f.seek(self.start + self.rows * self.row_bytes + 4 * (first + n))
                    f.write(b.column(b.schema.get_field_index("scale")).to_numpy().astype("<f4").tobytes())
                n += len(ids)
        return Part(first, n)

    def commit(self, messages):
        at = 0
        for p in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first):
            if p.first != at:
                self.abort(messages)
                raise ValueError(f"ids must be 0, 1, ...; {at} is missing or repeated")
            at += p.rows
        if at != self.rows:
            self.abort(messages)
            raise ValueError(f"{at} rows were written, not {self.rows}")
        os.replace(self.made, self.path)

    def abort(self, messages):
        if os.path.exists(self.made):
            os.remove(self.made)


class VectorFiles(DataSource):
    """format("vectors")"""

    @classmethod
    def name(cls):
        return "vectors"

    def schema(self):
        return _SCHEMAS[vector_layout(self.options["path"]).dtype]

    def reader(self, schema):
        return _VectorReader(self.options["path"])

    def writer(self, schema, overwrite):
        return _VectorWriter(dict(self.options), overwrite)


class TruthFiles(DataSource):
    """format("truth")"""

    @classmethod
    def name(cls):
        return "truth"

    def schema(self):
        return "query_id long, rank int, vec_id long"

    def reader(self, schema):
        return _TruthReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFiles)
    spark.dataSource.register(TruthFiles)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("vectors").load(path)


def write_vectors(df: DataFrame, path: str, layout: str = "wide", dtype: str = "float32") -> None:
    """Write (vec_id, embedding), or (vec_id, codes, scale) for int8; ids must be 0..n-1. Sorted by range, so parts follow one another."""
    register(df.sparkSession)
    cols = ["vec_id", "codes", "scale"] if dtype == "int8" else ["vec_id", "embedding"]
    rows = df.select(*cols).repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    n, dim = df.agg(F.count("*"), F.max(F.size(cols[1]))).first()
    if not n or not dim or dim < 1:
        raise ValueError("nothing to write")
    rows.write.format("vectors").mode("overwrite").options(layout=layout, dtype=dtype, rows=n, dim=dim).save(path)


def write_truth(truth: DataFrame, path: str, dim: int, base_rows: int, metric: int = METRIC_DOT) -> None:
    """Write (query_id, rank, vec_id) with query ids 0..Q-1 and ranks 1..k for each."""
    n, queries, k, top = truth.agg(F.count("*"), F.countDistinct("query_id"), F.max("rank"), F.max("query_id")).first()
    if not n or n != queries * k or top != queries - 1:
        raise ValueError("every query 0..Q-1 needs ranks 1..k")
    made = f"{path}.{uuid.uuid4().hex}"
    with open(made, "wb") as f:
        f.write(struct.pack("<QIIIIQQ", TRUTH_MAGIC, VERSION, metric, k, dim, queries, base_rows).ljust(HEADER, b"\0"))
        f.truncate(HEADER + 4 * n)

    def put(batches):
        done = 0
        with open(made, "r+b") as f:
            for b in batches:
                place = b.column(0).to_numpy() * k + b.column(1).to_numpy() - 1
                ids = b.column(2).to_numpy().astype("<u4")
                cuts = [0, *(np.flatnonzero(np.diff(place) != 1) + 1).tolist(), len(place)]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    if lo < hi:
                        f.seek(HEADER + 4 * int(place[lo]))
                        f.write(ids[lo:hi].tobytes())
                done += len(place)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([done], pa.int64())})

    rows = truth.select(F.col("query_id").cast("long"), F.col("rank").cast("long"), F.col("vec_id").cast("long"))
    done = rows.repartitionByRange("query_id").sortWithinPartitions("query_id", "rank").mapInArrow(put, "rows long").agg(F.sum("rows")).first()[0]
    if done != n:
        os.remove(made)
        raise ValueError(f"{done} rows were written, not {n}")
    os.replace(made, path)


def read_truth(spark: SparkSession, path: str, k: int | None = None, dim: int | None = None, queries: int | None = None, base_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id); raises if the header does not have the values that are asked for."""
    lay = truth_layout(path)
    for name, want, have in (("k", k, lay.k), ("dim", dim, lay.dim), ("queries", queries, lay.queries), ("rows", base_rows, lay.rows)):
        if want is not None and want != have:
            raise ValueError(f"{path}: {name} is {have}, not {want}")
    register(spark)
    return spark.read.format("truth").load(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Documents from CSV: named string columns; missing values are empty strings; quoted line ends are allowed."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", None).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string"), F.lit("")).alias(c) for c in columns])


def write_rowmeta(meta: DataFrame, path: str) -> None:
    """JSON lines of (row, doc_idx, id, title, section, chunk_index)."""
    meta.select("row", "doc_idx", "id", "title", "section", "chunk_index").write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
