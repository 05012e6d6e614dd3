"""Operators on tables of vectors: slices, samples, checks and typed storage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, vector


def slice_first(base: DataFrame, n: int, id_col: str = "vec_id") -> DataFrame:
    """The rows with ids below n: the filter reaches the scan, and reruns agree."""
    return base.where(F.col(id_col) < n)


def sample_random(base: DataFrame, n: int, seed: int = 42, id_col: str = "vec_id") -> DataFrame:
    """n distinct rows (all, if there are fewer) in the order of a seeded digest of the id."""
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")))
    return base.withColumn("_order", key).orderBy("_order", id_col).limit(n).drop("_order")


def row_at(base: DataFrame, ids: list[int], id_col: str = "vec_id") -> DataFrame:
    """Typed row access by id; unknown ids give no row."""
    return base.where(F.col(id_col).isin(ids))


def preview(base: DataFrame, n: int = 3, dims: int = 8, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, dim, value): the first components of the first vectors."""
    return base.where(F.col(id_col) < n).select(id_col, F.posexplode(F.slice(vec, 1, dims)).alias("dim", "value"))


def check_vectors(base: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, dim, norm, finite) of every row; a null vector has dim -1, norm null and is not finite."""
    bad = F.col(vec).isNull() | F.coalesce(vector.has_nonfinite(vec), F.lit(True))
    return base.select(id_col, F.coalesce(F.size(vec), F.lit(-1)).alias("dim"), vector.norm(vec).alias("norm"), (~bad).alias("finite"))


def require_sound(base: DataFrame, vec: str = "embedding") -> int:
    """The common dimension; raises if the table is empty, or a vector is null, of another length or not finite."""
    bad = F.col(vec).isNull() | F.coalesce(vector.has_nonfinite(vec), F.lit(True))
    n, wrong, low, high = base.agg(F.count("*"), F.sum(bad.cast("int")), F.min(F.size(vec)), F.max(F.size(vec))).first()
    if not n:
        raise ValueError("the table has no vectors")
    if wrong or low != high:
        raise ValueError(f"{wrong} vectors are null or not finite; lengths go from {low} to {high}")
    return low


def quantize_int8(base: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, codes array<tinyint>, scale float)."""
    scaled = base.select(id_col, F.col(vec).alias("_v"), vector.int8_scale(vec).alias("scale"))
    return scaled.select(id_col, vector.int8_codes("_v", "scale").alias("codes"), "scale")


def dequantize_int8(base: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, embedding array<float>) of (id, codes, scale)."""
    return base.select(id_col, vector.int8_decode("codes", "scale").alias("embedding"))


def to_float16(base: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, bits binary): little-endian half-precision components."""

    def run(batches):
        for b in batches:
            x = kernels.to_half(kernels.matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], [id_col, "bits"])

    return base.select(id_col, vec).mapInArrow(run, f"{id_col} {dict(base.dtypes)[id_col]}, bits binary")


def from_float16(base: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, embedding array<float>) of (id, bits)."""

    def run(batches):
        for b in batches:
            rows = [np.frombuffer(x, "<f2").astype(np.float32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], [id_col, "embedding"])

    return base.select(id_col, "bits").mapInArrow(run, f"{id_col} {dict(base.dtypes)[id_col]}, embedding array<float>")


def storage_bytes(base: DataFrame, vec: str = "embedding") -> DataFrame:
    """(dtype, rows, dim, bytes) for each storage type."""
    stats = base.agg(F.count("*").alias("rows"), F.max(F.size(vec)).cast("long").alias("dim"))
    kinds = F.array(*[F.struct(F.lit(d).alias("dtype"), vector.payload_bytes(F.col("dim"), d).alias("row_bytes")) for d in vector.DTYPES])
    return stats.select("rows", "dim", F.explode(kinds).alias("k")).select("k.dtype", "rows", "dim", (F.col("k.row_bytes") * F.col("rows")).alias("bytes"))
